"""Retailer catalog lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog_data import CATEGORY_LABELS, CITIES


def retailers_for_vertical(retailers: DataFrame, vertical: str) -> DataFrame:
    return retailers.filter(F.array_contains("verticals", vertical))


def retailer_by_slug(retailers: DataFrame, slug: str) -> DataFrame:
    return retailers.filter(F.col("slug") == slug)


def retailer_by_slug_for_vertical(retailers: DataFrame, slug: str, vertical: str) -> DataFrame:
    return retailers_for_vertical(retailer_by_slug(retailers, slug), vertical)


def retailers_by_category(retailers: DataFrame, category: str) -> DataFrame:
    return retailers.filter(F.col("category") == category)


def all_retailer_slugs(retailers: DataFrame) -> DataFrame:
    return retailers.select("slug").distinct()


def slugs_for_vertical(retailers: DataFrame, vertical: str) -> DataFrame:
    return retailers_for_vertical(retailers, vertical).select("slug")


def configs_for_vertical(configs: DataFrame, retailers: DataFrame, vertical: str) -> DataFrame:
    """Crawl configurations of the retailers of one vertical."""
    return configs.join(slugs_for_vertical(retailers, vertical), "slug", "left_semi")


def vertical_retailer_pairs(retailers: DataFrame) -> DataFrame:
    """Every (vertical, retailer) pair but those of the general vertical."""
    pairs = retailers.select(F.explode("verticals").alias("vertical"), "slug")
    return pairs.filter(F.col("vertical") != "general")


def retailers_per_vertical(retailers: DataFrame) -> DataFrame:
    return vertical_retailer_pairs(retailers).groupBy("vertical").agg(F.count(F.lit(1)).alias("retailers"))


def _lookup(key: Column, table: dict[str, Column]) -> Column:
    parts = [part for name, value in table.items() for part in (F.lit(name), value)]
    return F.try_element_at(F.create_map(*parts), key)


def category_label(category: Column) -> Column:
    """Display label of a category; a category without one shows as it is."""
    return F.coalesce(_lookup(category, {k: F.lit(v) for k, v in CATEGORY_LABELS.items()}), category)


def city_location(city: Column) -> Column:
    """Coordinates of a preset city as a struct, null for others."""
    return _lookup(
        city, {key: F.struct(F.lit(lat).alias("lat"), F.lit(lng).alias("lng")) for key, _, lat, lng in CITIES}
    )
