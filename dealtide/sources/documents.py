"""Leaflet documents: one JSON text per retailer, read once into typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import unnest
from .document_store import read_documents

# Columns of a parsed document.
DOC_COLUMNS = [
    "slug", "raw", "is_json", "is_valid", "retailer", "scraped_at", "source_urls", "methods", "folders", "deals",
]


def read_folder_docs(spark: SparkSession, path: str, layout: str = "files") -> DataFrame:
    """The raw documents of a folder: slug and text.

    ``layout`` is ``files`` for one JSON file per retailer, named by its slug, or ``written`` for what ``write_folder_docs`` leaves.
    """
    if layout == "written":
        return read_documents(spark, path)
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.json")
    slug = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
    return files.select(slug.alias("slug"), F.col("value").alias("raw"))


def _text(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "string")


def _is(value: Column, path: str, *kinds: str) -> Column:
    """Is the value at ``path`` of one of the JSON ``kinds``?"""
    kind = F.schema_of_variant(F.try_variant_get(value, path, "variant"))
    return F.coalesce(F.regexp_replace(kind, r"\(.*", "").isin(*kinds), F.lit(False))


NUMBERS = ("BIGINT", "DOUBLE", "DECIMAL", "FLOAT", "INT")


def _page(page: Column) -> Column:
    return F.struct(
        F.try_variant_get(page, "$.pageNumber", "int").alias("page_number"),
        _text(page, "$.imageUrl").alias("image_url"),
        F.try_variant_get(page, "$.deals", "array<variant>").alias("deals"),
    )


def _folder(folder: Column) -> Column:
    """A leaflet with its fields; ``pages`` is null where it is not an array."""
    count = F.when(_is(folder, "$.pageCount", *NUMBERS), F.try_variant_get(folder, "$.pageCount", "double"))
    return F.struct(
        _text(folder, "$.id").alias("id"),
        _text(folder, "$.retailerSlug").alias("retailer_slug"),
        F.when(_is(folder, "$.title", "STRING"), _text(folder, "$.title")).alias("title"),
        _text(folder, "$.validFrom").alias("valid_from"),
        _text(folder, "$.validUntil").alias("valid_until"),
        count.alias("page_count"),
        _text(folder, "$.thumbnailUrl").alias("thumbnail_url"),
        F.transform(F.try_variant_get(folder, "$.pages", "array<variant>"), _page).alias("pages"),
        _text(folder, "$.embedUrl").alias("embed_url"),
        _text(folder, "$.pdfUrl").alias("pdf_url"),
        F.when(_is(folder, "$.contentSource", "STRING"), _text(folder, "$.contentSource")).alias("content_source"),
        F.when(_is(folder, "$.scrapedAt", "STRING"), _text(folder, "$.scrapedAt")).alias("scraped_at"),
    )


def deal_of(deal: Column) -> Column:
    """A deal with its fields; of an image list the first one is taken."""
    return F.struct(
        _text(deal, "$.id").alias("id"),
        _text(deal, "$.product").alias("product"),
        F.try_variant_get(deal, "$.originalPrice", "double").alias("original_price"),
        F.try_variant_get(deal, "$.promoPrice", "double").alias("promo_price"),
        _text(deal, "$.discount").alias("discount"),
        _text(deal, "$.description").alias("description"),
        _text(deal, "$.category").alias("category"),
        F.coalesce(_text(deal, "$.imageUrl[0]"), _text(deal, "$.imageUrl")).alias("image_url"),
        _text(deal, "$.affiliateUrl").alias("affiliate_url"),
        _text(deal, "$.validFrom").alias("valid_from"),
        _text(deal, "$.validUntil").alias("valid_until"),
        _text(deal, "$.retailerSlug").alias("retailer_slug"),
    )


def parse_docs(raws: DataFrame) -> DataFrame:
    """Documents with their leaflets and deals as arrays of structs.

    A text that is not JSON gives ``is_json`` false and nothing else; ``is_valid`` asks for an array of
    folders. The text is parsed once, into a variant that all fields are read from.
    """
    parsed = raws.withColumn("_doc", F.try_parse_json("raw"))
    doc = F.col("_doc")
    folders = F.try_variant_get(doc, "$.folders", "array<variant>")
    return parsed.select(
        *raws.columns,
        doc.isNotNull().alias("is_json"),
        folders.isNotNull().alias("is_valid"),
        F.when(_is(doc, "$.retailer", "STRING"), _text(doc, "$.retailer")).alias("retailer"),
        F.when(_is(doc, "$.scrapedAt", "STRING"), _text(doc, "$.scrapedAt")).alias("scraped_at"),
        F.try_variant_get(doc, "$.sourceUrls", "array<string>").alias("source_urls"),
        F.try_variant_get(doc, "$.methods", "array<string>").alias("methods"),
        F.transform(folders, _folder).alias("folders"),
        F.transform(F.try_variant_get(doc, "$.deals", "array<variant>"), deal_of).alias("deals"),
    )


def folders_of(docs: DataFrame) -> DataFrame:
    """One row per leaflet with its place in the document; none for documents without leaflets."""
    return unnest(docs, ["slug"], F.col("folders"), "folder", "pos").select("slug", "pos", "folder.*")


def deals_of(docs: DataFrame) -> DataFrame:
    """One row per deal with its place in the document."""
    return unnest(docs, [F.col("slug").alias("doc_slug")], F.col("deals"), "deal", "pos").select(
        "doc_slug", "pos", "deal.*"
    )
