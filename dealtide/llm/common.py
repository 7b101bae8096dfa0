"""Helpers of the training-data operators: words, shared tables, single evaluation, ranks without one-task windows."""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..params import shared_folder

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def shared(spark: SparkSession) -> str:
    """The folder all executors share; a session without one (as in tests) gets the warehouse's."""
    return shared_folder(spark, spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/shared").rstrip("/")


def settled(frame: DataFrame) -> DataFrame:
    """``frame`` written once as parquet into the shared folder and read back.

    It cuts the lineage, survives lost executors, and what several branches read is computed once. The files stay
    until the shared folder is cleared, as the returned frame may be read at any time.
    """
    path = f"{shared(frame.sparkSession)}/llm/{uuid.uuid4().hex}"
    schema = frame.schema
    gc.collect()  # first the frames that Python still holds, then
    frame.sparkSession._jvm.System.gc()  # lets Spark's cleaner drop the shuffle files of earlier steps
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(schema).parquet(path)


def released(spark: SparkSession) -> None:
    """Give Spark's cleaner the time to drop the shuffle files of frames no longer in use, after a step that wrote many."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def once(frame: DataFrame, **columns: Column) -> DataFrame:
    """``frame`` with ``columns``, each computed exactly once per row however often it is used above.

    A generator of one element keeps the optimizer from copying the expressions into their uses, which would be
    computed per array element inside lambda functions.
    """
    made = F.struct(*[column.alias(name) for name, column in columns.items()])
    kept = [c for c in frame.columns if c not in columns]
    return frame.select(*kept, F.explode(F.array(made)).alias("_made")).select(*kept, *[F.col("_made")[n].alias(n) for n in columns])


def words_of(text: Column) -> Column:
    """The words of a text as an array; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranked(frame: DataFrame, group: list[str], order: list[str | Column], bucket: Column, name: str, size: Column | None = None) -> DataFrame:
    """``frame`` with ``name``: what precedes a row within its group, by number of rows or by the sum of ``size``.

    ``bucket`` is an integer that never falls along ``order`` within a group. Counts per bucket are summed up first, so
    a group is ranked by as many tasks as it has buckets and no task sees a whole group.
    """
    amount = F.lit(1).cast("long") if size is None else size
    rows = once(frame, _bucket=bucket, _amount=amount)
    totals = rows.groupBy(*group, "_bucket").agg(F.sum("_amount").alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*[F.col(g).alias(f"_g{n}") for n, g in enumerate(group)], F.col("_bucket").alias("_b"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    match = rows["_bucket"] == starts["_b"]
    for n, g in enumerate(group):
        match = match & rows[g].eqNullSafe(starts[f"_g{n}"])
    inner = Window.partitionBy(*group, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_inner", F.coalesce(F.sum("_amount").over(inner), F.lit(0)))
    match = placed["_bucket"] == starts["_b"]
    for n, g in enumerate(group):
        match = match & placed[g].eqNullSafe(starts[f"_g{n}"])
    return placed.join(starts, match).select(*frame.columns, (F.col("_start") + F.col("_inner")).cast("long").alias(name))


def split_points(frame: DataFrame, column: str, count: int) -> list:
    """At most ``count`` ascending values of ``column`` that cut its rows into parts of about equal numbers."""
    probes = [n / count for n in range(1, count)]
    found = frame.agg(F.percentile_approx(column, probes, max(10_000, 10 * count)).alias("v")).first()["v"] if probes else None
    return sorted(set(found or []))


def range_bucket(value: Column, points: list) -> Column:
    """How many of the ascending ``points`` are at or below ``value``: 0 for null. Looked up in two levels."""
    if not points:
        return F.lit(0)
    step = max(1, int(len(points) ** 0.5))
    coarse = [points[n : n + step] for n in range(0, len(points), step)]
    heads = F.array(*[F.lit(c[0]) for c in coarse])
    blocks = F.array(*[F.array(*[F.lit(p) for p in c]) for c in coarse])
    at = F.size(F.filter(heads, lambda p: p <= value))
    inside = F.size(F.filter(F.element_at(blocks, F.greatest(at, F.lit(1))), lambda p: p <= value))
    return F.when(value.isNull() | (at == 0), F.lit(0)).otherwise((at - 1) * step + inside).cast("int")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Distributed union-find: (node, component) for every node of ``edges`` (a, b); the component is its least node.

    Alternates the two star steps of Kiveris et al. (Connected Components in MapReduce and Beyond, 2014): each node links
    its greater neighbours to its least one, then its lesser ones. A node's least neighbour is a partial aggregate
    and the rest is a join, so no neighbour list is collected and a hub with a third of all edges is no hot task.
    Every round is written to the shared folder.
    """
    def least(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("m"))

    def both(pairs: DataFrame) -> DataFrame:
        return pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def state(pairs: DataFrame):
        row = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        return row["n"], row["h"]

    now = settled(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = state(now)
    for _ in range(rounds if seen[0] else 0):
        two = both(now)
        large = two.join(least(two), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = settled(large)
        low = least(large)
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").union(low.select("a", F.col("m").alias("b")))
        now = settled(small.distinct())
        found = state(now)
        if found == seen:
            break
        seen = found
    else:
        if seen[0]:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    labels = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def star_links(entries: DataFrame, verified: Callable[[DataFrame], DataFrame], possible: Column | None = None, few: int = 0, sketches: DataFrame | None = None, close: Column | None = None, fetched: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """Verified pairs (a, b) that connect all similar nodes among those that share an index entry (sig, sid, n).

    Entries of at most ``few`` nodes are done first and at once, every node with every other, and then left out.
    Nodes already connected are not compared. In each entry all nodes are first compared with its least one, then those of
    another component with up to eight of the entry's least component. What is in another component after that is
    compared with every node of the entry. So a large group of near copies costs its size, and no link is lost.
    ``verified`` keeps the similar pairs; ``possible`` is a cheap condition on what is known of two nodes, ``n`` and ``m``.
    For the last comparison ``sketches`` (sid, n) may tell more of a node, with a condition ``close`` that every similar pair meets.
    ``fetched``, if ``few`` is given, is told once, before anything is verified, which nodes (sid) may be asked for.
    """
    possible = F.lit(True) if possible is None else possible
    edges = None
    if few:
        counted = entries.withColumn("members", F.count("*").over(Window.partitionBy("sig")))
        small = counted.filter(F.col("members") <= few).select("sig", "sid", "n")
        pairs = small.join(small.select("sig", F.col("sid").alias("other"), F.col("n").alias("m")), "sig").filter(possible & (F.col("sid") < F.col("other")))
        pairs = settled(pairs.select(F.col("sid").alias("a"), F.col("other").alias("b")).distinct())
        entries = settled(counted.filter(F.col("members") > few).select("sig", "sid", "n"))
        if fetched:
            fetched(pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).union(entries.select("sid")).distinct())
        edges = settled(verified(pairs))
        released(entries.sparkSession)
        if entries.isEmpty():
            return edges
    for leaders in (1, 8, 0):
        if edges is None or leaders == 1:
            rows = entries.withColumn("label", F.col("sid"))
        else:
            rows = entries.join(settled(components(edges)).withColumnRenamed("node", "sid"), "sid", "left")
            rows = rows.select("sig", "sid", "n", F.coalesce("component", "sid").alias("label"))
        main = rows.groupBy("sig").agg(F.min("label").alias("main"), F.max("label").alias("most")).filter("main <> most").select("sig", "main")
        rows = rows.join(main, "sig")
        if leaders != 1:
            if not leaders and sketches is not None:
                rows = rows.drop("n").join(sketches, "sid").select("sig", "sid", "n", "label", "main")
                possible = close
            rows = settled(rows)
            released(entries.sparkSession)
            if rows.isEmpty():
                break
        others = rows.filter("label <> main").select("sig", "sid", "n", "label")
        if leaders:
            slot = F.pmod(F.xxhash64("sid", F.lit(leaders)), F.lit(leaders))
            heads = rows.filter("label = main").groupBy("sig", slot.alias("slot")).agg(F.min(F.struct("sid", "n")).alias("h"))
            heads = heads.select("sig", F.col("h.sid").alias("other"), F.col("h.n").alias("m"), F.lit(None).cast("long").alias("other_label"))
        else:
            heads = rows.select("sig", F.col("sid").alias("other"), F.col("n").alias("m"), F.col("label").alias("other_label"))
        pairs = others.join(heads, "sig").filter(possible & ~F.col("label").eqNullSafe(F.col("other_label")) & (F.col("sid") != F.col("other")))
        new = verified(pairs.select(F.least("sid", "other").alias("a"), F.greatest("sid", "other").alias("b")).distinct())
        edges = settled(new if edges is None else edges.union(new))
        released(entries.sparkSession)
    return edges


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text")))


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


Query = Callable[[SparkSession, str], DataFrame]
