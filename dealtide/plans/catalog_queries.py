"""Catalog lookups and nearest stores over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geo import haversine_km as haversine
from ..operators import catalog as cat
from ..operators import proximity as near
from .registry import query

# Kilometres between (a.lat, a.lng) and (b.lat, b.lng), in SQL.
KM_SQL = """(2 * 6371.0::DOUBLE * atan2(
    sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2)),
    sqrt(1 - (pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2)))))"""


@query("retailers_for_vertical", "SELECT slug, name, category FROM retailers WHERE list_contains(verticals, 'electro')")
def retailers_for_vertical(t):
    return cat.retailers_for_vertical(t.retailers, "electro").select("slug", "name", "category")


@query("retailer_by_slug", "SELECT slug, name, category, website FROM retailers WHERE slug = 's7'")
def retailer_by_slug(t):
    return cat.retailer_by_slug(t.retailers, "s7").select("slug", "name", "category", "website")


@query(
    "retailer_by_slug_for_vertical",
    """SELECT r.slug, r.name FROM retailers r WHERE r.slug = 's3' AND list_contains(r.verticals, 'beauty')
       UNION ALL SELECT r.slug, r.name FROM retailers r WHERE r.slug = 's5' AND list_contains(r.verticals, 'beauty')
       UNION ALL SELECT r.slug, r.name FROM retailers r WHERE r.slug = 's2' AND list_contains(r.verticals, 'beauty')""",
)
def retailer_by_slug_for_vertical(t):
    r = t.retailers
    found = [cat.retailer_by_slug_for_vertical(r, slug, "beauty").select("slug", "name") for slug in ("s3", "s5", "s2")]
    return found[0].unionAll(found[1]).unionAll(found[2])


@query("retailers_by_category", "SELECT slug, name FROM retailers WHERE category = 'drogist'")
def retailers_by_category(t):
    return cat.retailers_by_category(t.retailers, "drogist").select("slug", "name")


@query("all_retailer_slugs", "SELECT DISTINCT slug FROM retailers")
def all_retailer_slugs(t):
    return cat.all_retailer_slugs(t.retailers)


@query("slugs_for_vertical", "SELECT slug FROM retailers WHERE list_contains(verticals, 'pet')")
def slugs_for_vertical(t):
    return cat.slugs_for_vertical(t.retailers, "pet")


@query(
    "configs_for_vertical",
    """SELECT c.slug, c.name FROM crawl_configs c
       WHERE EXISTS (SELECT 1 FROM retailers r WHERE r.slug = c.slug AND list_contains(r.verticals, 'pet'))""",
)
def configs_for_vertical(t):
    return cat.configs_for_vertical(t.crawl_configs, t.retailers, "pet").select("slug", "name")


@query(
    "vertical_retailer_pairs",
    "SELECT vertical, slug FROM (SELECT unnest(verticals) AS vertical, slug FROM retailers) WHERE vertical <> 'general'",
)
def vertical_retailer_pairs(t):
    return cat.vertical_retailer_pairs(t.retailers)


@query(
    "retailers_per_vertical",
    """SELECT vertical, count(*) AS retailers FROM (SELECT unnest(verticals) AS vertical, slug FROM retailers)
       WHERE vertical <> 'general' GROUP BY vertical""",
)
def retailers_per_vertical(t):
    return cat.retailers_per_vertical(t.retailers)


@query(
    "category_label",
    """SELECT slug, CASE category WHEN 'supermarkt' THEN 'Supermarkten' WHEN 'discounter' THEN 'Discounters' WHEN 'drogist' THEN 'Drogisterijen'
         WHEN 'electronica' THEN 'Elektronicazaken' ELSE category END AS label FROM retailers""",
)
def category_label(t):
    return t.retailers.select("slug", cat.category_label(F.col("category")).alias("label"))


CITY_SQL = """CASE c_custkey % 8 WHEN 0 THEN 'antwerpen' WHEN 1 THEN 'brussel' WHEN 2 THEN 'gent' WHEN 3 THEN 'leuven'
    WHEN 4 THEN 'hasselt' WHEN 5 THEN 'luik' WHEN 6 THEN 'Gent' END"""


@query(
    "city_location",
    f"""SELECT c_custkey AS user_id, {CITY_SQL} AS city, l.lat, l.lng FROM customer LEFT JOIN (VALUES ('antwerpen', 51.2194::DOUBLE, 4.4025::DOUBLE),
         ('brussel', 50.8503::DOUBLE, 4.3517::DOUBLE), ('gent', 51.0543::DOUBLE, 3.7174::DOUBLE), ('leuven', 50.8798::DOUBLE, 4.7005::DOUBLE),
         ('hasselt', 50.9307::DOUBLE, 5.3325::DOUBLE), ('luik', 50.6326::DOUBLE, 5.5797::DOUBLE)) l(city, lat, lng) ON l.city = {CITY_SQL}""",
)
def city_location(t):
    named = t.customer.select(F.col("c_custkey").alias("user_id"), F.expr(CITY_SQL).alias("city"))
    place = cat.city_location(F.col("city"))
    return named.select("user_id", "city", place["lat"].alias("lat"), place["lng"].alias("lng"))


@query(
    "haversine_km",
    f"""SELECT a.user_id, b.id AS store_id, round({KM_SQL}, 6) AS km FROM user_locations a JOIN stores b ON b.id = 'st' || CAST(a.user_id - 1 AS VARCHAR)""",
)
def haversine_km(t):
    a, b = t.user_locations.alias("a"), t.stores.alias("b")
    pairs = a.join(b, F.col("b.id") == F.concat(F.lit("st"), (F.col("a.user_id") - 1).cast("string")))
    km = haversine(F.col("a.lat"), F.col("a.lng"), F.col("b.lat"), F.col("b.lng"))
    return pairs.select("a.user_id", F.col("b.id").alias("store_id"), F.round(km, 6).alias("km"))


NEAREST_SQL = f"""SELECT a.user_id, a.retailer_slug, min(round({KM_SQL}, 6)) AS distance_km
    FROM store_requests a LEFT JOIN stores b ON b.retailer_slug = a.retailer_slug GROUP BY ALL"""


@query("nearest_store_distance", NEAREST_SQL)
def nearest_store_distance(t):
    found = near.nearest_store_distance(t.store_requests, t.stores)
    return found.withColumn("distance_km", F.round("distance_km", 6))


@query(
    "nearest_stores",
    f"""SELECT user_id, store_id, round(km, 6) AS distance_km, rank FROM (
          SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY km, store_id) AS INTEGER) AS rank
          FROM (SELECT a.user_id, b.id AS store_id, {KM_SQL} AS km FROM user_locations a CROSS JOIN stores b)) WHERE rank <= 3""",
)
def nearest_stores(t):
    found = near.nearest_stores(t.user_locations, t.stores, 3)
    return found.withColumn("distance_km", F.round("distance_km", 6))


ORDERED_SQL = f"""SELECT d.user_id, d.retailer_slug, r.name, r.category, d.distance_km,
    CAST(row_number() OVER (PARTITION BY user_id ORDER BY d.distance_km NULLS LAST,
      CASE WHEN d.distance_km IS NULL THEN r.name END NULLS FIRST, d.retailer_slug) AS INTEGER) AS position
  FROM ({NEAREST_SQL}) d JOIN retailers r ON r.slug = d.retailer_slug"""


@query("retailers_by_proximity", ORDERED_SQL)
def retailers_by_proximity(t):
    found = near.retailers_by_proximity(t.store_requests, t.retailers, t.stores)
    return found.withColumn("distance_km", F.round("distance_km", 6))


@query("category_sections", f"SELECT * FROM ({ORDERED_SQL}) WHERE category IN ('supermarkt', 'discounter')")
def category_sections(t):
    ordered = near.retailers_by_proximity(t.store_requests, t.retailers, t.stores)
    both = near.category_section(ordered, "supermarkt").unionAll(near.category_section(ordered, "discounter"))
    return both.withColumn("distance_km", F.round("distance_km", 6))
