"""Deal lists: first-wins deduplication, fallback between extraction stages, quality rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import unnest
from ..functions.text import present, strip


def deal_key(product: str = "product") -> list[Column]:
    """Same deal: product text without case and outer blanks, promo price, retailer."""
    return [strip(F.lower(F.col(product))), F.col("promo_price"), F.col("retailer_slug")]


def deduplicate_deals(deals: DataFrame, order: list[str]) -> DataFrame:
    """The first deal of every key in the order of ``order``.

    Spark cuts each map partition to one row per key before the shuffle (window group limit), so
    copies of one deal, however many, do not meet in one task.
    """
    first = Window.partitionBy(*deal_key()).orderBy(*order)
    return deals.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") == 1).drop("_n")


PAGE_TEXT_STAGE = 2


def least_stage(deals: DataFrame) -> DataFrame:
    """The rows of ``deals`` (retailer_slug, stage, page_no, …) that are of the least stage of their retailer, of page text those of its least page.

    Each row is computed and moved once: Spark drops what cannot be of the least stage in each map partition before
    the shuffle (window group limit).
    """
    page = F.when(F.col("stage") == PAGE_TEXT_STAGE, F.col("page_no"))
    first = Window.partitionBy("retailer_slug").orderBy("stage", page)
    return deals.withColumn("_rank", F.rank().over(first)).filter("_rank = 1").drop("_rank")


def without_deals(rows: DataFrame, done: DataFrame) -> DataFrame:
    """``rows`` of retailers that are not in ``done`` (retailer_slug): what a later stage still has to look at.

    Rows without a retailer stay. Later stages of a retailer with deals count for nothing, so they need not be extracted.
    """
    return rows.join(done.select("retailer_slug"), "retailer_slug", "left_anti").select(*rows.columns)


def extraction_fallback(primary: DataFrame, pdf_text: DataFrame, page_text: DataFrame) -> DataFrame:
    """All primary deals; text of the pdf only for retailers without any; page text only for those still
    without, and of it only the first page that has deals.

    Every stage has retailer_slug, method, page_no and columns of deals, which are all kept; what a stage lacks is null.
    """
    stages = [frame.withColumn("stage", F.lit(n)) for n, frame in enumerate((primary, pdf_text, page_text))]
    return least_stage(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), stages)).drop("stage")


def extraction_methods(deals: DataFrame, rank: dict[str, int]) -> DataFrame:
    """The methods that gave deals per retailer, in the order they are tried."""
    place = F.create_map(*[F.lit(v) for pair in rank.items() for v in pair])
    used = F.collect_set(F.struct(F.try_element_at(place, F.col("method")).alias("place"), "method"))
    names = F.transform(F.array_sort(used), lambda m: m["method"])
    return deals.groupBy("retailer_slug").agg(names.alias("methods"))


def deal_violations(deals: DataFrame, slug: str = "doc_slug") -> DataFrame:
    """One row per broken rule: retailer, deal id, rule.

    ``slug`` names the column with the retailer the deal was found under.
    """
    price_rules = []
    for name in ("promo_price", "original_price"):
        price_rules.append((f"{name}_negative", F.col(name) < 0))
    rules: list[tuple[str, Column]] = [
        ("product_missing", ~F.coalesce(present(F.col("product")), F.lit(False))),
        ("valid_from_missing", F.col("valid_from").isNull()),
        ("valid_until_missing", F.col("valid_until").isNull()),
        ("retailer_mismatch", ~F.col("retailer_slug").eqNullSafe(F.col(slug))),
        *price_rules,
        ("promo_above_original", F.col("promo_price") > F.col("original_price")),
        ("image_url_shape", present(F.col("image_url")) & ~F.col("image_url").rlike(r"^(?:https?://|/)")),
        ("id_missing", F.col("id").isNull()),
    ]
    broken = F.array(*[F.when(test, F.lit(name)) for name, test in rules])
    return unnest(deals, [F.col(slug).alias("slug"), "id"], broken, "rule").drop("_n")


def duplicate_deals(deals: DataFrame) -> DataFrame:
    """Deal keys that occur more than once, with the number of copies; one row per key."""
    product, price, retailer = deal_key()
    return (
        deals.groupBy(product.alias("product_key"), price.alias("promo_price"), retailer.alias("retailer_slug"))
        .agg(F.count(F.lit(1)).alias("copies"))
        .filter(F.col("copies") > 1)
    )
