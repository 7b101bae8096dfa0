"""Fuzzy line dedup by MinHash over character shingles. DataFrame operations only.

The distinct shingles of a line are hashed once and sorted, so that they lie on a circle in an order that is random but the same for all lines. A
band is the run of shingles that follows a fixed point of the circle: two lines have it in common if the first ones there, of both lines, are
common. Short lines have a run from each of their shingles, which misses no pair. Runs index the lines; lines that share one are
verified by the exact Jaccard likeness of their shingle sets, and union-find joins what is similar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, documents, once, released, settled, star_links
from .registry import query

#: Characters of a shingle; a shorter line is one shingle.
SHINGLE = 5
PERCENT = 80
#: Points of the circle from which a run is a band, and shingles of a run. A pair at the threshold shares a band with probability 0.999.
BANDS, ROWS = 18, 5
#: Distinct shingles up to which a line has runs from each of them, from which on it has bands, and shingles of such a run. Similar lines
#: differ in size by a quarter at most, so both are done alike. Of similar lines' shingles four in a row are common somewhere, for those that are not are a fifth at most.
ALL, SOME, SHORT_ROWS = 40, 32, 4
#: The shingles that follow so many points are kept as four bits each, of lines of more than SKETCHED shingles; so many may differ for a pair to be
#: verified. At the threshold more differ with probability 0.0001, at a likeness of 0.3 nearly always.
POINTS, SKETCHED, DIFFER = 32, 60, 14
#: Most bands are shared by a few lines that met by chance. Up to so many are compared with one another at once.
FEW = 16


def points(line: Column) -> Column:
    """Four bytes a character, so that a shingle is cut out by its place."""
    return F.encode(line, "UTF-32")


def lines_of(docs: DataFrame) -> DataFrame:
    """(rk, doc_id, line_no, line) of every line with a visible character."""
    rows = docs.select("rk", "doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    return rows.filter(F.btrim("line", F.lit(" \t\n\x0b\x0c\r")) != "")


def circles(lines: DataFrame, size: int) -> DataFrame:
    """(sid, s) of the lines (sid, line), each sid once: the hashes of its distinct shingles, in order."""
    lines = lines.groupBy("sid").agg(F.first("line").alias("line"))
    rows = once(lines, body=points(F.col("line"))).select("sid", "body")
    rows = once(rows, s=shingle_set("body", size)).select("sid", "s")
    return once(rows, s=F.sort_array("s"))


def signatures(lines: DataFrame, size: int) -> DataFrame:
    """(sid, n, ring, at) of the lines (sid, line): the circle from its start to some way beyond its end, and where on it the first shingle
    after each point lies; ``n`` holds four bits of each of those, null for short lines."""
    step = (1 << 64) // POINTS
    marks = F.array(*[F.lit(n * step - (1 << 63)) for n in range(POINTS)])
    merged = once(circles(lines, size), _all=F.sort_array(F.concat("s", marks)))
    # how many shingles lie before a point: its place in the merged order less the points before it; past the last shingle comes the first
    is_mark = lambda i: F.get("_all", i).bitwiseAND(F.lit(step - 1)) == 0
    places = F.filter(F.sequence(F.lit(0), F.size("_all") - 1), is_mark)
    rows = once(merged, _places=places, ring=F.concat("s", F.slice("s", 1, max(ROWS, SHORT_ROWS)))).select("sid", "ring", "_places")
    rows = once(rows, at=F.transform("_places", lambda i, n: i - n)).select("sid", "ring", "at")

    def packed(first: int) -> Column:
        nibble = lambda at: F.get("ring", at).bitwiseAND(F.lit(15).cast("long"))
        return F.aggregate(F.slice("at", first + 1, POINTS // 2), F.lit(0).cast("long"), lambda found, at: F.shiftleft(found, 4).bitwiseOR(nibble(at)))

    count = shingles()
    return rows.select("sid", F.when(count > SKETCHED, F.struct(packed(0).alias("low"), packed(POINTS // 2).alias("high"))).alias("n"), "ring", "at")


def shingles() -> Column:
    """How many shingles lie on a ``ring``, which goes on with its first ones, all of them if they are fewer."""
    return F.when(F.size("ring") < 2 * max(ROWS, SHORT_ROWS), (F.size("ring") / 2).cast("int")).otherwise(F.size("ring") - max(ROWS, SHORT_ROWS))


def firsts() -> Column:
    """Where on its ring the runs of a line start, and whether they are those of a short line."""
    count, none = shingles(), F.array().cast("array<struct<first:int,short:boolean>>")
    place = lambda first, short: F.struct(first.alias("first"), F.lit(short).alias("short"))
    every = F.when(count <= ALL, F.transform(F.sequence(F.lit(0), count - 1), lambda n: place(n, True))).otherwise(none)
    chosen = F.when(count >= SOME, F.array(*[place(F.get("at", F.lit(n * POINTS // BANDS)), False) for n in range(BANDS)])).otherwise(none)
    return F.concat(every, chosen)


def key() -> Column:
    """The key of a run: its shingles are picked one by one, as a slice would copy the ring."""
    run = lambda length: F.xxhash64(*[F.get("ring", F.col("first") + n) for n in range(length)])
    return F.when(F.col("short"), run(SHORT_ROWS)).otherwise(run(ROWS))


def gathered(signed: DataFrame) -> DataFrame:
    """(sig, sid, low, high) of ``signatures``: a row per band that several lines share, without a sketch, and one per line with its sketch.

    All go through one exchange, so that signatures are neither stored nor made twice.
    """
    group = Window.partitionBy("sig")
    own = F.when(F.col("n").isNotNull(), F.array(F.struct(F.lit(-1).alias("first"), F.lit(False).alias("short")))).otherwise(F.array().cast("array<struct<first:int,short:boolean>>"))
    rows = signed.select("sid", "n", "ring", F.explode(F.concat(firsts(), own)).alias("_to")).select("sid", "n", "ring", "_to.first", "_to.short")
    sketch = [F.when(F.col("first") < 0, F.col(f"n.{part}")).alias(part) for part in ("low", "high")]
    rows = rows.select(F.when(F.col("first") < 0, F.xxhash64("sid")).otherwise(key()).alias("sig"), "sid", *sketch)
    rows = rows.withColumn("least", F.min("sid").over(group)).withColumn("most", F.max("sid").over(group))
    return rows.filter("least <> most OR low IS NOT NULL").select("sig", "sid", "low", "high")


def with_sketches(rows: DataFrame) -> DataFrame:
    """(sig, sid, n) of the bands in what ``gathered`` returns."""
    sketches = rows.filter("low IS NOT NULL").select("sid", F.struct("low", "high").alias("n"))
    return rows.filter("low IS NULL").select("sig", "sid").distinct().join(sketches, "sid", "left").select("sig", "sid", "n")  # two points may have one run


def shared_bands(signed: DataFrame) -> DataFrame:
    """(sig, sid, n) of ``signatures``, a row per band that several lines share. Sketches are fetched for these rows only."""
    return with_sketches(gathered(signed))


def banded(lines: DataFrame, size: int) -> DataFrame:
    """(sig, sid, n) of the lines (sid, line), a row per band."""
    rows = signatures(lines, size).select("sid", "n", "ring", F.explode(firsts()).alias("_to")).select("sid", "n", "ring", "_to.first", "_to.short")
    return rows.select(key().alias("sig"), "sid", "n").distinct()


def differing(a: str, b: str) -> Column:
    """In how many of their values two sketches differ; null if there are not two."""
    total = F.lit(0)
    for part in ("low", "high"):
        x = F.col(f"{a}.{part}").bitwiseXOR(F.col(f"{b}.{part}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        total = total + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    return total


def shingle_set(line: str, size: int) -> Column:
    """The distinct shingles of a line as hashes; ``line`` names its points, which are bound once: a column would be copied for every shingle."""
    places = F.sequence(F.lit(1), F.greatest(F.octet_length(line) - 4 * size, F.lit(0)) + 1, F.lit(4))
    hashed = F.transform(F.array(F.col(line)), lambda body: F.transform(places, lambda at: F.xxhash64(F.substring(body, at, F.lit(4 * size)))))
    return F.array_distinct(F.get(hashed, F.lit(0)))


def similar(pairs: DataFrame, numbered: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose lines (sid, line in ``numbered``, which may repeat) have shingle sets alike to ``percent``.

    Only lines of a pair are fetched, and sets are built where a pair is looked at.
    """
    pairs = settled(pairs)
    asked = pairs.select(F.col("a").alias("sid")).union(pairs.select(F.col("b").alias("sid"))).distinct()
    texts = settled(numbered.join(asked, "sid", "left_semi").distinct())
    left = texts.select(F.col("sid").alias("a"), F.col("line").alias("la"))
    right = texts.select(F.col("sid").alias("b"), F.col("line").alias("lb"))
    both = once(pairs.join(left, "a").join(right, "b"), la=points(F.col("la")), lb=points(F.col("lb")))
    both = once(both.select("a", "b", "la", "lb"), sa=shingle_set("la", size), sb=shingle_set("lb", size))
    both = once(both.select("a", "b", "sa", "sb"), common=F.size(F.array_intersect("sa", "sb")))
    return both.filter(100 * F.col("common") >= percent * (F.size("sa") + F.size("sb") - F.col("common"))).select("a", "b")


def deduplicated(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` (doc_id, text, any others) with ``text`` less its dropped lines, and ``n_lines`` and ``n_dropped`` in columns _n_lines and _n_dropped.

    Equal lines and lines whose shingle sets have a Jaccard likeness of ``percent`` or more form components, over all
    documents; the first line of a component by doc_id (null first) and place is kept, the others go. Lines are told
    apart by 64-bit hashes. Blank lines stay and are not counted. A document may lose all its lines; its row stays, with
    an empty text. Null texts stay null. Equal rows lose the same lines. Other columns are returned as they are, whatever their names;
    only input columns _n_lines and _n_dropped give way.
    """
    columns = [c for c in docs.columns if c not in ("_n_lines", "_n_dropped")]
    others = [c for c in columns if c not in ("doc_id", "text")]
    held = F.struct(*others) if others else F.lit(None)
    docs = once(docs.select("doc_id", "text", held.alias("_other")), _row=F.xxhash64("doc_id", "text"))
    lines = lines_of(docs.select(F.col("_row").alias("rk"), "doc_id", "text"))
    placed = settled(lines.select("rk", "doc_id", "line_no", F.xxhash64("line").alias("sid")))
    numbered = lines.select(F.xxhash64("line").alias("sid"), "line")
    found = settled(gathered(signatures(numbered, size)))
    released(docs.sparkSession)
    entries = settled(with_sketches(found))
    asked: list[DataFrame] = []

    def fetched(sids: DataFrame) -> None:
        asked[:] = [settled(numbered.join(sids, "sid", "left_semi").groupBy("sid").agg(F.first("line").alias("line")))]
        released(docs.sparkSession)

    possible = F.coalesce(differing("n", "m") <= DIFFER, F.lit(True))
    labels = settled(components(star_links(entries, lambda pairs: similar(pairs, asked[0], size, percent), possible, FEW, fetched=fetched)))
    known = placed.join(labels, placed["sid"] == labels["node"], "left").select("rk", "doc_id", "line_no", F.coalesce("component", "sid").alias("component"))
    known = settled(known)
    first = known.groupBy("component").agg(F.min(F.struct("doc_id", "line_no", "rk")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("component", "first")
    drops = known.join(first, "component").filter(~F.struct("doc_id", "line_no", "rk").eqNullSafe(F.col("first")))
    drops = drops.groupBy("rk").agg(F.collect_set("line_no").alias("_drops")).withColumnRenamed("rk", "_rk")
    rows_ = docs.join(drops, docs["_row"] == drops["_rk"], "left").drop("_rk")
    rows_ = once(rows_, _lines=F.split("text", "\n"))
    rows_ = once(rows_, _kept=F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.coalesce("_drops", F.array().cast("array<int>"))))
    text = F.array_join(F.transform("_kept", lambda n: F.get(F.col("_lines"), n)), "\n")
    visible = F.size(F.filter("_lines", lambda line: F.btrim(line, F.lit(" \t\n\x0b\x0c\r")) != ""))
    own = {"text": F.when(F.col("_drops").isNull(), F.col("text")).otherwise(text), "_n_lines": F.when(F.col("text").isNull(), F.lit(0)).otherwise(visible), "_n_dropped": F.coalesce(F.size("_drops"), F.lit(0))}
    made = rows_.select("doc_id", "_other", *[value.alias(f"_made_{c}") for c, value in own.items()])
    kept = [F.col("_made_text").alias(c) if c == "text" else F.col(c) if c == "doc_id" else F.col("_other")[c].alias(c) for c in columns]
    return made.select(*kept, *[F.col(f"_made_{c}").cast("long").alias(c) for c in ("_n_lines", "_n_dropped")])


@query("op8_fuzzy_line_dedup")
def op8(spark, sf_dir):
    return deduplicated(documents(spark, sf_dir)).select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), "text")
