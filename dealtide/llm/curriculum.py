"""Mixing sources to target weights along a curriculum that changes over time. DataFrame operations only.

Every source has a share of the mix (its target in words) and a schedule: its weight at time 0 and at time 1 of the
training, linear in between. The integral of the schedule is the source's cumulative demand; a document that follows
``c`` words of its own source is due when that demand reaches ``c``. Documents are range-sorted by that position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, once, partitions, ranked, settled, word_count
from .registry import query

#: A source is repeated at most so often.
REPEATS = 3


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeats: int = REPEATS) -> DataFrame:
    """Words to take from each source: (source, source_size, target, early, late), by water filling.

    ``sizes`` holds a row per source, never per document, so the windows over all of it see only sources. Sources in
    order of code points, null last, weigh ``weights`` in turn. The total of all sizes is shared by weight; a source
    stops at ``repeats`` times its size and the excess is shared anew. Sources stop in order of size per weight, so
    the stopped ones are a prefix of that order. Odd sources fade out along the training, even ones fade in.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(by_name) - 1
    weighed = sizes.withColumn("rank", rank)
    weighed = weighed.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    weighed = weighed.withColumn("most", F.col("source_size") * float(repeats)).withColumn("level", F.col("most") / F.col("weight"))
    order = Window.orderBy("level", "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    filled = weighed.select(
        "*", F.sum("source_size").over(whole).alias("_all"), F.coalesce(F.sum("most").over(before), F.lit(0.0)).alias("_full"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("_open"),
    )
    # the level all open sources would reach if this one and the later ones were open; the first that holds it sets it
    filled = filled.withColumn("_each", (F.col("_all") - F.col("_full")) / F.col("_open"))
    line = F.min(F.when(F.col("_each") <= F.col("level"), F.struct("level", "rank", F.col("_each").alias("each")))).over(whole)["each"]
    target = F.least(F.col("most"), F.coalesce(line, F.col("level")) * F.col("weight"))
    early = F.when(F.col("rank") % 2 == 0, F.lit(1.5)).otherwise(F.lit(0.5))
    return filled.select("source", "source_size", target.alias("target"), early.alias("early"), (F.lit(2.0) - early).alias("late"))


def due(demand: Column, target: Column, early: Column, late: Column) -> Column:
    """The time in [0, 1] at which the integral of the schedule reaches ``demand`` words.

    The weight ``early + (late - early) t``, scaled to the target, integrates to a quadratic; this is its root in the form
    that stays exact when early and late are equal.
    """
    share = F.when(target > 0, F.least(demand / target, F.lit(1.0))).otherwise(F.lit(0.0))
    area = share * (early + late) / 2
    return 2 * area / (early + F.sqrt(early * early + 2 * (late - early) * area))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeats: int = REPEATS, seed: int = 7) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, position, passes, row_key) for every row of ``docs`` (doc_id, text, source).

    A source's documents stand in an order shuffled by a hash of their ids, the stream is read up to ``repeats`` times, and
    it ends at the target: ``taken`` is what of a document lies before that end over all passes, so at most one document of
    a source is cut. ``position`` is when its first pass is due, null if nothing is taken;
    ``passes`` lists when each pass is due. ``row_key`` is a hash of all columns. Null texts have size 0. A
    null source is a source. Repeated rows each count. Equal inputs give equal results. Prefix sums run over (source, hash
    bucket), so a source with a third of all rows is spread over all tasks.
    """
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64(*docs.columns).alias("row_key"))
    rows = once(rows, size=F.col("size"), row_key=F.col("row_key"), _key=F.xxhash64("doc_id", F.lit(seed)))
    plan = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, repeats)
    buckets = 4 * partitions(docs.sparkSession)
    bucket = F.shiftright((F.shiftright("_key", 32) + F.lit(2**31)) * F.lit(buckets), 32).cast("int")  # the high bits, evenly cut
    placed = ranked(rows, ["source"], ["_key", "doc_id", "size"], bucket, "_before", F.col("size"))
    plan = plan.withColumnRenamed("source", "_source")
    joined = placed.join(plan, placed["source"].eqNullSafe(plan["_source"]))
    end = F.floor(F.col("target")).cast("long")
    taken = sum(
        (F.least(F.greatest(end - (F.col("source_size") * n + F.col("_before")), F.lit(0).cast("long")), F.col("size")) for n in range(repeats)),
        F.lit(0).cast("long"),
    )
    joined = joined.withColumn("taken", taken)
    position = F.when(F.col("taken") > 0, due(F.col("_before").cast("double"), F.col("target"), F.col("early"), F.col("late")))
    again = [due(F.col("source_size") * n + F.col("_before"), F.col("target"), F.col("early"), F.col("late")) for n in range(repeats)]
    passes = F.filter(F.array(*[F.when(end > F.col("source_size") * n + F.col("_before"), at) for n, at in enumerate(again)]), lambda at: at.isNotNull())
    passes = F.when(F.col("taken") > 0, passes).otherwise(F.array().cast("array<double>"))
    return joined.select("doc_id", "source", "size", "source_size", "target", "taken", position.alias("position"), passes.alias("passes"), "row_key")


def in_order(mixed: DataFrame) -> DataFrame:
    """``mixed`` range-sorted by position, what is not taken last."""
    order = [F.col("position").asc_nulls_last(), F.col("doc_id")]
    return mixed.repartitionByRange(partitions(mixed.sparkSession), *order).sortWithinPartitions(*order)


def taken_rows(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeats: int = REPEATS) -> DataFrame:
    """The rows of ``docs``, with all their columns, once for each pass that takes any of their words, range-sorted by training position.

    A document the end of its source's stream cuts is kept whole. Equal rows stand together.
    """
    mixed = settled(mix(docs, weights, repeats).select("row_key", "passes"))
    # of equal rows each has passes of its own; together they are what one row of the key stands for
    mixed = mixed.groupBy("row_key").agg(F.flatten(F.collect_list("passes")).alias("passes"))
    passes = mixed.select(F.col("row_key").alias("_key"), F.explode("passes").alias("_at"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.xxhash64(*docs.columns).alias("_own"))  # no name of the input can clash
    rows = rows.dropDuplicates(["_own"]).join(passes, F.col("_own") == F.col("_key")).select("_row", "_at")
    order = [F.col("_at"), F.col("_row.doc_id")]
    return rows.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order).select("_row.*")


@query("op7_curriculum_mix")
def op7(spark, sf_dir):
    mixed = in_order(mix(documents(spark, sf_dir, "doc_id", "text", "source")))
    return mixed.select("doc_id", "size", "source_size", F.col("target"), "taken", "position")
