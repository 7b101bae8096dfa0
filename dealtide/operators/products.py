"""Product history: rows from deals, upsert by key, and the queries over the history."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import iso_week, iso_week_year
from ..functions.promo import infer_promo_type
from ..functions.text import ascii_fold
from ..params import clamp_int, instant, time_literal

KEY = ["retailer_slug", "product_name", "promo_key", "valid_from", "valid_until", "vertical"]
# Set by the first insert of a key and never changed after.
KEPT = ["id", "retailer_name", "affiliate_url", "promo_price", "created_at"]
# Replaced by every later batch that holds the key.
UPDATED = [
    "description", "category", "image_url", "original_price", "discount_label", "promo_type",
    "scraped_at", "source_method", "source_url", "folder_title", "updated_at",
]
PARTITIONS = ["year", "week_number"]
COLUMNS = [
    "id", "retailer_slug", "retailer_name", "vertical", "product_name", "description", "category", "image_url",
    "affiliate_url", "original_price", "promo_price", "discount_label", "promo_type", "valid_from", "valid_until",
    "week_number", "year", "scraped_at", "source_method", "source_url", "folder_title", "created_at", "updated_at",
]
REQUIRED = ["retailer_slug", "retailer_name", "vertical", "product_name", "valid_from", "valid_until", "scraped_at"]


def _promo_key() -> Column:
    # No promo price and a promo price of -1 count as the same key.
    return F.coalesce(F.col("promo_price"), F.lit(-1.0))


def _with_missing(frame: DataFrame, columns: dict[str, str]) -> DataFrame:
    absent = {name: F.lit(None).cast(kind) for name, kind in columns.items() if name not in frame.columns}
    return frame.withColumns(absent) if absent else frame


#: A product key as two numbers, which a merge moves in place of the id's 32 digits.
HALVES = ["_key_a", "_key_b"]


def _halves() -> dict[str, Column]:
    key = F.struct(*[F.col(c) for c in KEY if c != "promo_key"], _promo_key().alias("promo_key"))
    return {name: F.xxhash64(F.lit(n), key) for n, name in enumerate(HALVES)}


def id_of(halves: list[Column]) -> Column:
    """The id made of the two halves of a key."""
    return F.lower(F.concat(*[F.lpad(F.hex(half), 16, "0") for half in halves]))


def product_id() -> Column:
    """The id of a product key: 128 bits of hash over its parts as a struct, so no part runs into the next."""
    return id_of(list(_halves().values()))


def keyed_rows(deals: DataFrame, as_of: datetime | str) -> DataFrame:
    """``product_rows`` without the promotion type, which ``upsert_products`` finds for the rows it keeps."""
    full = _with_missing(
        deals,
        {
            "retailer_name": "string", "image_url": "string", "affiliate_url": "string", "source_method": "string",
            "source_url": "string", "folder_title": "string", "description": "string", "category": "string", "discount": "string",
        },
    )
    day = F.col("valid_from").cast("date")
    stamp = time_literal(deals, "scraped_at", as_of)
    rows = full.select(
        "retailer_slug",
        F.coalesce("retailer_name", "retailer_slug").alias("retailer_name"),
        "vertical",
        F.col("product").alias("product_name"),
        "description",
        "category",
        "image_url",
        "affiliate_url",
        "original_price",
        "promo_price",
        F.col("discount").alias("discount_label"),
        day.alias("valid_from"),
        F.col("valid_until").cast("date").alias("valid_until"),
        iso_week(day).alias("week_number"),
        iso_week_year(day).alias("year"),
        "scraped_at",
        "source_method",
        "source_url",
        "folder_title",
        stamp.alias("created_at"),
        stamp.alias("updated_at"),
        "seq",
    )
    rows = rows.dropna(subset=REQUIRED).withColumn("id", product_id())
    return rows.select(*[c for c in COLUMNS if c != "promo_type"], "seq")


def _promo_type() -> Column:
    return infer_promo_type(F.col("discount_label"), F.col("product_name"), F.col("promo_price"))


def product_rows(deals: DataFrame, as_of: datetime | str) -> DataFrame:
    """Deals as product rows, with promotion type, ISO week and a key-derived id.

    ``deals``: retailer_slug, product, prices, discount, validity, vertical, scraped_at and ``seq`` (the
    order in which they were found); other columns are taken when present. Rows without a required
    value are left out, as a failing insert is. The id depends on the key alone, so a task that is run
    again gives the same id.
    """
    return keyed_rows(deals, as_of).withColumn("promo_type", _promo_type()).select(*COLUMNS, "seq")


def accepted_rows(rows: DataFrame) -> DataFrame:
    """How many rows of a batch the upsert takes, per retailer."""
    return rows.groupBy("retailer_slug").agg(F.count(F.lit(1)).alias("accepted"))


def first_and_last(rows: DataFrame, first: list, last: list, by: tuple[str, ...] = ("id",)) -> DataFrame:
    """One row per id, or other columns ``by``: the kept columns of its first row by ``first``, the other ones of its last row by ``last``.

    Spark cuts each map partition to one row per id before the shuffle (window group limit), so copies of one product,
    however many, do not meet in one task. Both sides come out dealt and sorted by id, so their join moves nothing.
    """
    by_id = Window.partitionBy(*by)

    def one(frame: DataFrame, order: list) -> DataFrame:
        return frame.withColumn("_n", F.row_number().over(by_id.orderBy(*order))).filter("_n = 1").drop("_n")

    opening = one(rows, first).select(*by, *[c for c in KEPT if c != "id"])
    return one(rows, last).drop(*[c for c in KEPT if c != "id"]).join(opening, list(by))


def merged_rows(batch: DataFrame) -> DataFrame:
    """``batch`` (product rows with ``seq``) as a history of its own, one row per key, dealt by the columns ``HALVES``, which it has besides ``COLUMNS``.

    The first row of a key by ``seq`` gives the kept columns, the last one the updated columns; rows of one ``seq`` stand in the
    order of a hash. Rows may come without a promotion type; then only those kept are given one. What follows from
    other columns is not moved: the id, the week, a name equal to the slug, and of the first row's price all but whether there is one.
    """
    tie = F.hash(*[c for c in COLUMNS if c not in ("id", "promo_type", *PARTITIONS)])
    price = F.col("promo_price")
    rows = _with_missing(batch, {"promo_type": "string"}).withColumns({**_halves(), "_tie": tie, "_price": price}).drop("id", *PARTITIONS)
    rows = rows.withColumns({"retailer_name": F.nullif("retailer_name", "retailer_slug"), "promo_price": price.isNotNull()})
    merged = first_and_last(rows, ["seq", "_tie"], [F.desc("seq"), F.desc("_tie")], tuple(HALVES))
    found = infer_promo_type(F.col("discount_label"), F.col("product_name"), F.col("_price"))
    made = {
        "promo_type": F.coalesce("promo_type", found), "retailer_name": F.coalesce("retailer_name", "retailer_slug"), "id": id_of([F.col(h) for h in HALVES]),
        "promo_price": F.when(F.col("promo_price"), F.coalesce("_price", F.lit(-1.0))),  # rows of a key have one price, but for none and -1
        "week_number": iso_week(F.col("valid_from")), "year": iso_week_year(F.col("valid_from")),
    }
    return merged.withColumns(made).select(*COLUMNS, *HALVES)


def upsert_products(existing: DataFrame | None, batch: DataFrame) -> DataFrame:
    """``existing``, which holds a product key once, after inserting ``batch`` (product rows with ``seq``) in order of ``seq``.

    The batch is merged by itself and then joined by key; a history from ``merged_rows`` is not moved again for it.
    """
    new = merged_rows(batch)
    if existing is None:
        return new.select(*COLUMNS)
    stored = existing.withColumn("promo_type", F.coalesce("promo_type", _promo_type()))
    stored = stored if set(HALVES) <= set(stored.columns) else stored.withColumns(_halves())
    old = stored.select(*HALVES, F.lit(True).alias("_is_old"), *[F.col(c).alias(f"_old_{c}") for c in COLUMNS])
    both = old.join(new.select(*HALVES, F.lit(True).alias("_is_new"), *[F.col(c).alias(f"_new_{c}") for c in COLUMNS]), HALVES, "full")

    def of(side: str, other: str, column: str) -> Column:
        return F.when(F.col(f"_is_{side}"), F.col(f"_{side}_{column}")).otherwise(F.col(f"_{other}_{column}")).alias(column)

    return both.select(*[of("old", "new", c) if c in KEPT else of("new", "old", c) for c in COLUMNS])


def _top(found: DataFrame, order: list, limit, default: int) -> DataFrame:
    """``found`` in ``order``: the first ``limit`` rows, all of them if it is None."""
    ordered = found.orderBy(*order)
    return ordered if limit is None else ordered.limit(clamp_int(limit, default, 1))


def products_by_retailer(products: DataFrame, slug: str, week=None, year=None, limit=500) -> DataFrame:
    found = products.filter(F.col("retailer_slug") == slug)
    order = [F.desc("scraped_at"), "product_name", "id"]
    if week and year:
        found = found.filter((F.col("week_number") == week) & (F.col("year") == year))
        order = ["product_name", "id"]
    return _top(found, order, limit, 500)


def products_by_week(products: DataFrame, week: int, year: int, vertical=None, limit=1000) -> DataFrame:
    found = products.filter((F.col("week_number") == week) & (F.col("year") == year))
    if vertical:
        found = found.filter(F.col("vertical") == vertical)
    return _top(found, ["retailer_slug", "product_name", "id"], limit, 1000)


def _scraped_since(products: DataFrame, as_of, days) -> Column:
    moment = instant(as_of) - timedelta(days=clamp_int(days, 30, 1))
    return F.col("scraped_at") >= time_literal(products, "scraped_at", moment)


def in_category(products: DataFrame, category: str, as_of, days=30) -> Column:
    """Whether a row is of ``category``, compared without the case of A-Z, and was scraped in the last ``days``."""
    return (ascii_fold(F.col("category")) == ascii_fold(F.lit(category))) & _scraped_since(products, as_of, days)


def products_by_category(products: DataFrame, category: str, as_of, days=30, limit=500) -> DataFrame:
    """Category compared without the case of A-Z; cheapest first, unpriced before all."""
    found = products.filter(in_category(products, category, as_of, days))
    return _top(found, [F.col("promo_price").asc_nulls_first(), "product_name", "id"], limit, 500)


def product_stats(products: DataFrame, as_of, days=30, approximate: bool = False) -> DataFrame:
    """Totals of the recent history. ``approximate`` trades exact distinct counts for sketches."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return products.filter(_scraped_since(products, as_of, days)).agg(
        F.count(F.lit(1)).alias("total"),
        distinct(F.col("retailer_slug")).alias("retailers"),
        distinct(F.col("category")).alias("categories"),
        F.max("scraped_at").alias("latest_scrape"),
    )


def search_products(products: DataFrame, text: str, as_of, vertical=None, limit=100) -> DataFrame:
    """Products still valid whose name or description holds ``text``; ``%`` and ``_`` in it are wildcards."""
    pattern = ascii_fold(F.lit(f"%{text}%"))
    no_escape = F.lit("\x01")

    def holds(column: str) -> Column:
        return F.like(ascii_fold(F.col(column)), pattern, no_escape)

    found = products.filter(F.col("valid_until") >= time_literal(products, "valid_until", as_of))
    found = found.filter(holds("product_name") | holds("description"))
    if vertical:
        found = found.filter(F.col("vertical") == vertical)
    return _top(found, [F.col("promo_price").asc_nulls_first(), "product_name", "id"], limit, 100)
