"""Nearest stores without comparing every point with every store.

The globe is cut into square cells at several depths; each depth quarters the side
(360 degrees / 4**depth). Stores are counted per cell once, with the bounding box of
each cell's stores. For a point the deepest own cell that holds at least k stores gives an upper
bound for the distance of its k-th neighbour: no store of that cell is farther than the far edge of
its bounding box. Only the cells that the circle of this radius touches are then joined, at the
deepest depth whose cells are as large as the circle's half extent, so a point meets at most nine
cells. Both joins are equi-joins on (group, depth, cell): they shuffle by cell, a crowded retailer is
spread over its cells, places with many users are searched once, and the result is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_KM, KM_PER_DEGREE, haversine_km
from ..functions.skew import SALTS, salt_of, salted_join

DEPTHS = list(range(11))  # 360 degrees down to about 0.0003 degrees, some 40 m
WIDE_DEPTH = 5  # cells of about 0.35 degrees and more
# Slack against rounding in the bound; it only ever adds candidates.
SLACK = 1.000001


def _side(depth: int) -> float:
    return 360.0 / 4**depth


def _row(lat: Column, depth: Column) -> Column:
    return F.floor((lat + 90.0) / (F.lit(360.0) / F.pow(F.lit(4.0), depth))).cast("long")


def _column(lng: Column, depth: Column) -> Column:
    return F.floor((lng + 180.0) / (F.lit(360.0) / F.pow(F.lit(4.0), depth))).cast("long")


def _wrap(column: Column, depth: Column) -> Column:
    return F.pmod(column, F.pow(F.lit(4.0), depth).cast("long"))


def _by_cell(stores: DataFrame) -> DataFrame:
    """Each store once per depth with its cell."""
    spread = stores.withColumn("depth", F.explode(F.array(*[F.lit(d) for d in DEPTHS])))
    return spread.withColumn("cell_row", _row(F.col("lat"), F.col("depth"))).withColumn(
        "cell_col", _wrap(_column(F.col("lng"), F.col("depth")), F.col("depth"))
    )


def _bounds(points: DataFrame, cells: DataFrame, by: list[str], k: int) -> DataFrame:
    """``points`` with ``reach_km``: no k-th neighbour is farther. Points of a group without stores go."""
    held = cells.groupBy(*by, "depth", "cell_row", "cell_col").agg(
        F.count(F.lit(1)).alias("held"),
        F.min("lat").alias("lat_low"),
        F.max("lat").alias("lat_high"),
        F.min("lng").alias("lng_low"),
        F.max("lng").alias("lng_high"),
    )
    # The whole globe (depth 0) counts however few stores there are: then all of them are neighbours.
    held = held.filter((F.col("held") >= k) | (F.col("depth") == 0))
    # Wide cells hold a country's worth of points each, so their few rows are repeated per salt.
    wide = F.col("depth") <= WIDE_DEPTH
    every = F.array(*[F.lit(n) for n in range(SALTS)])
    held = held.withColumn("salt", F.explode(F.when(wide, every).otherwise(F.array(F.lit(0)))))
    probes = (
        points.withColumn("depth", F.explode(F.array(*[F.lit(d) for d in DEPTHS])))
        .withColumn("cell_row", _row(F.col("p_lat"), F.col("depth")))
        .withColumn("cell_col", _wrap(_column(F.col("p_lng"), F.col("depth")), F.col("depth")))
        .withColumn("salt", F.when(wide, salt_of("p_lat", "p_lng")).otherwise(0))
    )
    north_south = F.greatest(F.abs(F.col("p_lat") - F.col("lat_low")), F.abs(F.col("p_lat") - F.col("lat_high")))
    east_west = F.greatest(F.abs(F.col("p_lng") - F.col("lng_low")), F.abs(F.col("p_lng") - F.col("lng_high")))
    narrowest = F.when(
        F.col("lat_low") * F.col("lat_high") > 0,
        F.cos(F.radians(F.least(F.abs("lat_low"), F.abs("lat_high")))),
    ).otherwise(1.0)
    # Along the point's meridian, then along a parallel: never shorter than the great circle.
    reach = (north_south + east_west * narrowest) * KM_PER_DEGREE * SLACK + 1e-6
    reach = F.when((F.col("depth") == 0) & (F.col("held") < k), F.lit(EARTH_KM * 4)).otherwise(reach)
    return (
        probes.join(held, [*by, "depth", "cell_row", "cell_col", "salt"])
        .groupBy(*by, "p_lat", "p_lng")
        .agg(F.min(reach).alias("reach_km"))
    )


def _search_cells(bounded: DataFrame) -> DataFrame:
    """Each point once per cell its circle may touch (at most 3 x 3)."""
    angle = F.col("reach_km") / EARTH_KM
    lat_span = F.degrees(angle)
    cosine = F.cos(F.radians(F.col("p_lat")))
    # Half width in longitude of a circle on the sphere; all longitudes when it covers a pole.
    lng_span = F.when(
        (F.abs(F.col("p_lat")) + lat_span < 89.9) & (F.sin(angle) < cosine * 0.999999),
        F.degrees(F.asin(F.sin(angle) / cosine)),
    ).otherwise(180.0)
    span = F.greatest(lat_span, lng_span)
    depth = F.greatest(*[F.when(span <= _side(d), d).otherwise(0) for d in DEPTHS])
    spread = bounded.withColumn("lat_span", lat_span).withColumn("lng_span", lng_span).withColumn("depth", depth)
    rows = F.sequence(
        _row(F.col("p_lat") - F.col("lat_span"), F.col("depth")),
        _row(F.col("p_lat") + F.col("lat_span"), F.col("depth")),
    )
    columns = F.array_distinct(
        F.transform(
            F.sequence(
                _column(F.col("p_lng") - F.col("lng_span"), F.col("depth")),
                _column(F.col("p_lng") + F.col("lng_span"), F.col("depth")),
            ),
            lambda c: _wrap(c, F.col("depth")),
        )
    )
    whole = F.col("depth") == 0
    zero = F.array(F.lit(0).cast("long"))
    return (
        spread.withColumn("cell_row", F.explode(F.when(whole, zero).otherwise(rows)))
        .withColumn("cell_col", F.explode(F.when(whole, zero).otherwise(columns)))
        .drop("lat_span", "lng_span")
    )


def near_pairs(points: DataFrame, stores: DataFrame, k: int, by: list[str]) -> DataFrame:
    """All (point, store) pairs within each point's bound: its k nearest stores are among them.

    ``points``: p_lat, p_lng and the ``by`` columns, each place once, so that a place where many users
    are costs no more than any other; ``stores``: lat, lng and the ``by`` columns.
    """
    cells = _by_cell(stores)
    targets = _search_cells(_bounds(points, cells, by, k))
    pairs = targets.join(cells, [*by, "depth", "cell_row", "cell_col"]).withColumn(
        "distance_km", haversine_km(F.col("p_lat"), F.col("p_lng"), F.col("lat"), F.col("lng"))
    )
    return pairs.filter(F.col("distance_km") <= F.col("reach_km"))


def nearest_store_distance(requests: DataFrame, stores: DataFrame) -> DataFrame:
    """Distance from each user to the nearest store of the requested retailer, null if it has none.

    ``requests``: user_id, lat, lng, retailer_slug; a pair is answered once. Stores of one retailer at
    one place are taken together first.
    """
    asked = requests.select("user_id", "lat", "lng", "retailer_slug").distinct()
    points = asked.select(F.col("lat").alias("p_lat"), F.col("lng").alias("p_lng"), "retailer_slug").distinct()
    places = stores.select("retailer_slug", "lat", "lng").distinct()
    best = (
        near_pairs(points, places, 1, ["retailer_slug"])
        .groupBy("retailer_slug", F.col("p_lat").alias("lat"), F.col("p_lng").alias("lng"))
        .agg(F.min("distance_km").alias("distance_km"))
    )
    return salted_join(asked, best, ["retailer_slug", "lat", "lng"], ["user_id"], "left").select(
        "user_id", "retailer_slug", "distance_km"
    )


def nearest_stores(users: DataFrame, stores: DataFrame, k: int) -> DataFrame:
    """The k nearest stores of each user, ranked; none when k is not positive."""
    k = max(0, k)
    if k == 0:
        no_store = F.lit(None).cast(stores.schema["id"].dataType)
        return users.filter(F.lit(False)).select(
            "user_id", no_store.alias("store_id"), F.lit(0.0).alias("distance_km"), F.lit(0).alias("rank")
        )
    points = users.select(F.col("lat").alias("p_lat"), F.col("lng").alias("p_lng")).distinct()
    # stores at one place are equally far from everyone, so only its k first ids can be among the k nearest
    at_place = F.row_number().over(Window.partitionBy("lat", "lng").orderBy("id"))
    places = stores.select("id", "lat", "lng").withColumn("_n", at_place).filter(F.col("_n") <= k).drop("_n")
    pairs = near_pairs(points, places, k, [])
    order = Window.partitionBy("p_lat", "p_lng").orderBy("distance_km", "id")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    listed = ranked.select(
        F.col("p_lat").alias("lat"), F.col("p_lng").alias("lng"), F.col("id").alias("store_id"), "distance_km", "rank"
    )
    located = users.select("user_id", "lat", "lng")
    return salted_join(located, listed, ["lat", "lng"], ["user_id"]).select("user_id", "store_id", "distance_km", "rank")


def retailers_by_proximity(requests: DataFrame, retailers: DataFrame, stores: DataFrame) -> DataFrame:
    """Each user's requested retailers in display order: by distance, then those without a store by name."""
    known = retailers.select(F.col("slug").alias("retailer_slug"), "name", "category")
    near = nearest_store_distance(requests, stores).join(known, "retailer_slug")
    far_last = F.col("distance_km").asc_nulls_last()
    by_name = F.when(F.col("distance_km").isNull(), F.col("name"))
    order = Window.partitionBy("user_id").orderBy(far_last, by_name, "retailer_slug")
    return near.withColumn("position", F.row_number().over(order)).select(
        "user_id", "retailer_slug", "name", "category", "distance_km", "position"
    )


def category_section(ordered: DataFrame, category: str) -> DataFrame:
    """One category of an ordered list; positions, and so the order, are kept."""
    return ordered.filter(F.col("category") == category)


def requests_at(retailers: DataFrame, user_id: int, lat: float, lng: float) -> DataFrame:
    """One located user asking about every retailer of a catalog."""
    return retailers.select(
        F.lit(user_id).alias("user_id"), F.lit(float(lat)).alias("lat"), F.lit(float(lng)).alias("lng"),
        F.col("slug").alias("retailer_slug"),
    )
