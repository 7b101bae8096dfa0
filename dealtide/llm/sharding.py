"""Sharding by balanced label propagation: linked documents move together, shard sizes stay one apart at most."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, once, partitions, range_bucket, ranked, settled
from .registry import query

SHARDS = 24
_PARTS = 256


def links_of(nodes: DataFrame) -> DataFrame:
    """A star per group of equal ``digest``: (a, b) from each member to the group's least node. Null digests link nothing."""
    groups = nodes.filter(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("node").alias("b"), F.count("*").alias("n")).filter("n > 1")
    return nodes.join(groups, "digest").filter("node <> b").select(F.col("node").alias("a"), "b")


def propagate(labels: DataFrame, links: DataFrame, room: int, rounds: int) -> DataFrame:
    """``labels`` (node, shard) of the linked nodes after moves along ``links`` (a, b), until no node asks for a shard with room.

    A node asks for the shard most of its neighbours are in, if that beats its own; in each round a half of the nodes, another by
    hash each time, may move. Votes are partial counts, so a hub is no hot task. A shard takes what its quota ``room`` leaves:
    requests are counted by hash part, and of the part that fits in part the first ones are let in. Unlinked documents count
    against no quota here, as they can later go anywhere without cutting a link. Moves left after ``rounds`` are an error.
    """
    both = settled(links.union(links.select("b", "a")))
    now = settled(labels)
    for n in range(rounds):
        around = now.select(F.col("node").alias("b"), F.col("shard").alias("near"))
        votes = both.join(around, "b").groupBy("a", "near").agg(F.count("*").alias("votes"))
        own = now.select(F.col("node").alias("a"), "shard")
        asked = votes.join(own, "a").groupBy("a", "shard").agg(
            F.max(F.struct("votes", (-F.col("near")).alias("near"))).alias("best"), F.coalesce(F.max(F.when(F.col("near") == F.col("shard"), F.col("votes"))), F.lit(0)).alias("here"),
        )
        wants = settled(asked.filter(F.col("best.votes") > F.col("here")).select("a", (-F.col("best.near")).alias("to")))
        loads = {r["shard"]: r["n"] for r in now.groupBy("shard").agg(F.count("*").alias("n")).collect()}  # a row per shard
        left = {r["to"]: room - loads.get(r["to"], 0) for r in wants.select("to").distinct().collect()}
        left = {to: free for to, free in left.items() if free > 0}
        if not left:
            return now
        free = F.element_at(F.create_map(*[F.lit(v) for pair in left.items() for v in pair]), F.col("to"))
        wants = wants.filter(F.col("to").isin(list(left)) & (F.pmod(F.xxhash64("a", F.lit(-1 - n)), F.lit(2)) == 0)).withColumn("part", F.pmod(F.xxhash64("a", F.lit(n)), F.lit(_PARTS)))
        counts = wants.groupBy("to", "part").agg(F.count("*").alias("n"))  # shards x parts rows at most
        before = Window.partitionBy("to").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        fit = counts.withColumn("open", free - F.coalesce(F.sum("n").over(before), F.lit(0))).filter("open > 0").select("to", "part", "open")
        place = F.row_number().over(Window.partitionBy("to", "part").orderBy("a"))
        moves = wants.join(fit, ["to", "part"]).withColumn("place", place).filter(F.col("place") <= F.col("open")).select(F.col("a").alias("node"), "to")
        now = settled(now.join(moves, "node", "left").select("node", F.coalesce("to", "shard").cast("int").alias("shard")))
    raise RuntimeError(f"moves are left after {rounds} rounds of propagation")


def sharded(docs: DataFrame, shards: int = SHARDS, rounds: int = 200, links: DataFrame | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row of ``docs`` (doc_id, text).

    ``links`` (a, b) names linked nodes; without it equal texts are linked. Null texts have size 8 and link nothing; repeated
    rows are documents of their own. Shard counts differ by at most one: nodes beyond a shard's share leave it,
    unlinked ones first, and fill the shards below theirs. Slots number a shard from 0. Ranks are prefix sums over hash
    parts, so no task holds a whole shard.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    nodes = docs.select(
        "doc_id", (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
        F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.monotonically_increasing_id().alias("node"),
    )
    nodes = settled(nodes)
    links = settled(links_of(nodes) if links is None else links)
    total = nodes.count()
    start = F.pmod(F.xxhash64("doc_id", F.col("digest")), F.lit(shards)).cast("int")
    linked = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    labels = nodes.join(linked, "node", "left_semi").select("node", start.alias("shard"))
    placed = propagate(labels, links, total // shards, rounds)
    placed = placed.withColumn("tied", F.lit(True))
    rows = nodes.withColumn("start", start).drop("digest").join(placed, "node", "left")
    rows = rows.select("doc_id", "size", "text_crc32", "node", F.coalesce("shard", "start").alias("at"), F.coalesce("tied", F.lit(False)).alias("tied"))
    rows = settled(once(rows, key=F.xxhash64("node", F.lit(1))))
    parts = max(_PARTS, partitions(docs.sparkSession) * 4 // shards + 1)
    part = F.when(F.col("tied"), F.lit(0)).otherwise(F.lit(parts)) + F.shiftright((F.shiftright("key", 32) + F.lit(2**31)) * F.lit(parts), 32).cast("int")
    seated = ranked(rows, ["at"], [F.desc("tied"), F.col("key"), F.col("node")], part, "rank")
    loads = {r["at"]: r["n"] for r in rows.groupBy("at").agg(F.count("*").alias("n")).collect()}  # a row per shard
    share = [total // shards + (n < total % shards) for n in range(shards)]
    over, offsets, free, firsts = 0, [], [], []
    for n in range(shards):
        offsets.append(over - share[n])
        over += max(0, loads.get(n, 0) - share[n])
    gap = 0
    for n in range(shards):
        if loads.get(n, 0) < share[n]:
            free.append(n)
            firsts.append(gap)
            gap += share[n] - loads.get(n, 0)
    longs = lambda values: F.array(*[F.lit(v).cast("long") for v in values])
    seated = once(seated, place=F.when(F.col("rank") >= F.get(longs(share), F.col("at")), F.col("rank") + F.get(longs(offsets), F.col("at"))))
    seated = once(seated, gap=F.when(F.col("place").isNotNull(), range_bucket(F.col("place"), firsts) - 1))
    to = F.get(longs(free or [0]), F.col("gap")).cast("int")
    taken = F.get(longs([loads.get(n, 0) for n in free] or [0]), F.col("gap")) + F.col("place") - F.get(longs(firsts or [0]), F.col("gap"))
    return seated.select(
        "doc_id", "size", "text_crc32", F.coalesce(to, F.col("at")).cast("int").alias("shard"), F.coalesce(taken, F.col("rank")).cast("long").alias("slot"),
    )


@query("op5_balanced_sharding")
def op5(spark, sf_dir):
    return sharded(documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
