"""From captures to product history: which stage's deals of a retailer count, its document, its product rows.

A retailer is harvested stage by stage: deals of its pages (primary), of the text of its leaflet, of the text of its pages. The first
stage with any deals counts; of page text only the first page that has some. A bot challenge ends a stage's pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import week_dates
from ..params import clock
from .deals import PAGE_TEXT_STAGE, deduplicate_deals, least_stage

PRIMARY, LEAFLET_TEXT, PAGE_TEXT = 0, 1, PAGE_TEXT_STAGE
#: What a deal says, and what it is without a source that says it.
FIELDS = {
    "id": "string", "product": "string", "original_price": "double", "promo_price": "double", "discount": "string", "description": "string",
    "category": "string", "image_url": "string", "affiliate_url": "string",
}


def stage_deals(deals: DataFrame, stage: int, method: str, page_no: str | None = None, rank: int = 0) -> DataFrame:
    """``deals`` of one extractor as rows of a harvest: retailer_slug, stage, method, page_no, rank, pos and the ``FIELDS``.

    ``page_no`` names the column with the place of the page in the visit; ``rank`` orders extractors within a page. The
    place of a deal within a page is the number its id ends in.
    """
    fields = [(F.col(c) if c in deals.columns else F.lit(None).cast(kind)).alias(c) for c, kind in FIELDS.items()]
    page = F.col(page_no).cast("bigint") if page_no else F.lit(0).cast("bigint")
    return deals.select(
        "retailer_slug", F.lit(stage).alias("stage"), F.lit(method).alias("method"), page.alias("page_no"), F.lit(rank).alias("rank"),
        F.regexp_extract("id", r"(\d+)\z", 1).try_cast("int").alias("pos"), *fields,
    )


def before_challenges(deals: DataFrame, visits: DataFrame) -> DataFrame:
    """``deals`` of the pages that come before the first challenged one of their retailer and stage.

    ``visits``: retailer_slug, stage, page_no, challenged. The stops are a row per retailer and stage.
    """
    stops = visits.filter("challenged").groupBy("retailer_slug", "stage").agg(F.min("page_no").alias("_stop"))
    return deals.join(stops, ["retailer_slug", "stage"], "left").filter("_stop IS NULL OR page_no < _stop").drop("_stop")


def harvested(deals: DataFrame, visits: DataFrame, as_of) -> DataFrame:
    """The deals that count, each key once, with their validity and time: the harvest of all retailers.

    ``deals``: the union of ``stage_deals`` of all stages. Of equal deals the first in the order of page, extractor and place stays.
    Valid is the week of ``as_of``.
    """
    order = ["page_no", "rank", "pos", "id", "original_price", "discount"]
    unique = deduplicate_deals(least_stage(before_challenges(deals, visits)), order)
    now = clock(as_of)
    week = week_dates(now)
    return unique.select("*", week["valid_from"].alias("valid_from"), week["valid_until"].alias("valid_until"), now.alias("scraped_at"))


def _methods(deals: DataFrame) -> DataFrame:
    """(retailer_slug, methods): what gave deals, in the order of its first deal."""
    first = deals.groupBy("retailer_slug", "method").agg(F.min(F.struct("page_no", "rank")).alias("at"))
    listed = F.array_sort(F.collect_list(F.struct("at", "method")))
    return first.groupBy("retailer_slug").agg(F.transform(listed, lambda m: m["method"]).alias("methods"))


def _sources(visits: DataFrame) -> DataFrame:
    """(retailer_slug, source_urls): the pages visited, in order, each once."""
    first = visits.filter("url IS NOT NULL").groupBy("retailer_slug", "url").agg(F.min(F.struct("stage", "page_no")).alias("at"))
    listed = F.array_sort(F.collect_list(F.struct("at", "url")))
    return first.groupBy("retailer_slug").agg(F.transform(listed, lambda u: u["url"]).alias("source_urls"))


def harvest_products(deals: DataFrame, visits: DataFrame, folders: DataFrame, retailers: DataFrame, vertical: str) -> DataFrame:
    """``harvested`` deals as the deals ``product_rows`` takes, with the facts of their document.

    ``visits`` also has url; ``folders``: retailer_slug, title, one row per retailer or none; ``retailers``: slug, name. ``seq`` is the
    order within a retailer.
    """
    method = _methods(deals).select("retailer_slug", F.get("methods", F.lit(0)).alias("source_method"))
    source = _sources(visits).select("retailer_slug", F.get("source_urls", F.lit(0)).alias("source_url"))
    named = retailers.select(F.col("slug").alias("retailer_slug"), F.col("name").alias("retailer_name"))
    title = folders.select("retailer_slug", F.col("title").alias("folder_title"))
    facts = method.join(source, "retailer_slug", "left").join(title, "retailer_slug", "left").join(named, "retailer_slug", "left")
    # no deal key is there twice, so the order only has to be a fixed one
    seq = (F.col("page_no") * 1024 + F.col("rank")) * 1048576 + F.coalesce("pos", F.lit(0))
    return deals.withColumn("seq", seq).withColumn("vertical", F.lit(vertical)).join(facts, "retailer_slug", "left")


def harvest_documents(deals: DataFrame, folders: DataFrame, visits: DataFrame, as_of) -> DataFrame:
    """(slug, raw, folders, deals): the documents of a harvest, as JSON text and as arrays; a retailer without both has none.

    ``folders``: leaflet rows (retailer_slug, id, title, …). A document is one row, so its deals and leaflets meet in it.
    """
    shown = F.struct(
        "id", "product", F.col("original_price").alias("originalPrice"), F.col("promo_price").alias("promoPrice"), "discount", "description",
        "category", F.col("image_url").alias("imageUrl"), F.col("affiliate_url").alias("affiliateUrl"),
        F.date_format("valid_from", "yyyy-MM-dd").alias("validFrom"), F.date_format("valid_until", "yyyy-MM-dd").alias("validUntil"),
        F.col("retailer_slug").alias("retailerSlug"),
    )
    placed = F.array_sort(F.collect_list(F.struct("page_no", "rank", "pos", "id", "product", shown.alias("deal"))))
    own = deals.groupBy("retailer_slug").agg(F.transform(placed, lambda d: d["deal"]).alias("deals"))
    page = F.transform("pages", lambda p: F.struct(p["page_number"].alias("pageNumber"), p["image_url"].alias("imageUrl"), F.array().cast("array<string>").alias("deals")))
    leaflet = F.struct(
        "id", F.col("retailer_slug").alias("retailerSlug"), "title", F.date_format("valid_from", "yyyy-MM-dd").alias("validFrom"),
        F.date_format("valid_until", "yyyy-MM-dd").alias("validUntil"), F.col("page_count").alias("pageCount"), F.col("thumbnail_url").alias("thumbnailUrl"),
        page.alias("pages"), F.col("embed_url").alias("embedUrl"), F.col("pdf_url").alias("pdfUrl"), F.col("content_source").alias("contentSource"),
        F.date_format("scraped_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("scrapedAt"),
    )
    held = folders.groupBy("retailer_slug").agg(
        F.array_sort(F.collect_list(leaflet)).alias("folders"), F.array_sort(F.collect_set("content_source")).alias("folder_methods"),
    )
    joined = held.join(own, "retailer_slug", "full").join(_methods(deals), "retailer_slug", "left").join(_sources(visits), "retailer_slug", "left")
    listed = lambda name: F.coalesce(name, F.array().cast("array<string>"))
    document = joined.select(
        F.col("retailer_slug").alias("retailer"), F.coalesce("folders", F.array().cast(held.schema["folders"].dataType)).alias("folders"),
        F.coalesce("deals", F.array().cast(own.schema["deals"].dataType)).alias("deals"),
        F.date_format(clock(as_of), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("scrapedAt"), listed("source_urls").alias("sourceUrls"),
        F.array_distinct(F.concat(listed("folder_methods"), listed("methods"))).alias("methods"),
    )
    return document.select(F.col("retailer").alias("slug"), F.to_json(F.struct("*")).alias("raw"), "folders", "deals")
