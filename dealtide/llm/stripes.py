"""Source divergence audit by in-mapper stripes.

Each partition folds whole documents into a hash map from term to its stripe: document frequency, and occurrences per
source (the stripes pattern of Lin and Dyer, Data-Intensive Text Processing with MapReduce, 2010). A map over a bound of
bytes is spilled as rows. Stripes of equal key are merged after one shuffle by (language, term), and each
merged stripe, laid beside the totals of its language, gives its summands of every divergence.

Divergence of two distributions p and q over the kept terms is the sum of (p - q)^2 / (p + q), with add-two smoothing, all in
integers of a billionth.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.skew import salted_join
from .common import documents, settled
from .registry import query

#: A term is kept if that many documents of its language hold it; terms listed per group; one in parts.
LEAST_DOCS, TOP, ONE = 10, 10, 1_000_000_000
#: Bytes of stripes a partition holds before it spills, with what an entry of either map takes beside the term.
HELD, STRIPE_BYTES, CELL_BYTES = 96 << 20, 400, 100
#: Numbers of a block of (stripes, sources) worked on at a time.
BLOCK = 1 << 19
TERM = re.compile(rb"[a-z\x80-\xff]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
TERMS_OF = "lang string, term string, docs long, sources array<string>, counts array<long>"


def folded(docs: DataFrame, held_bytes: int = HELD) -> DataFrame:
    """(lang, term, docs, sources, counts): the stripes of each partition of ``docs`` (text, lang, source).

    Nulls are empty strings. A row without a term lists the sources met in its language, so that groups without any
    term are known.
    """
    source = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])

    def rows(held: dict[str, dict], met: dict[str, set]) -> pa.RecordBatch:
        found = [(lang, None, 0, list(names), [0] * len(names)) for lang, names in met.items()]
        found += [(lang, term, docs, list(by), list(by.values())) for lang, terms in held.items() for term, (docs, by) in terms.items()]
        lang, term, seen, sources, counts = zip(*found)
        return pa.RecordBatch.from_arrays(
            [pa.array(lang, pa.string()), pa.array(term, pa.binary()).cast(pa.string()), pa.array(seen, pa.int64()), pa.array(sources, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int64()))],
            ["lang", "term", "docs", "sources", "counts"],
        )

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, met, size = {}, {}, 0
        for batch in batches:
            texts = batch.column(2).cast(pa.large_string()).cast(pa.large_binary())
            for lang, name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts):
                met.setdefault(lang, set()).add(name)
                terms = held.setdefault(lang, {})
                for term, n in Counter(TERM.findall(text.as_py().translate(LOWER))).items():
                    stripe = terms.get(term)
                    if stripe is None:
                        terms[term] = [1, {name: n}]
                        size += len(term) + STRIPE_BYTES
                        continue
                    stripe[0] += 1
                    by = stripe[1]
                    if name in by:
                        by[name] += n
                    else:
                        by[name] = n
                        size += CELL_BYTES
                if size > held_bytes:
                    yield rows(held, met)
                    held, met, size = {}, {}, 0
        if met:
            yield rows(held, met)

    return source.mapInArrow(fold, TERMS_OF)


def merged(stripes: DataFrame) -> DataFrame:
    """(lang, term, docs, cells): one stripe per key, cells (source, n). Sources of a language bound a stripe's length.

    One shuffle by (lang, term): of each key a task reads one row per partition and spill, and sums them as they come.
    """
    dealt = stripes.repartition("lang", "term")
    cells = dealt.select("lang", "term", "docs", F.posexplode(F.arrays_zip("sources", "counts")).alias("at", "cell"))
    cells = cells.select("lang", "term", F.when(F.col("at") == 0, F.col("docs")).otherwise(F.lit(0)).alias("docs"), "cell.sources", "cell.counts")
    summed = cells.groupBy("lang", "term", "sources").agg(F.sum("docs").alias("docs"), F.sum("counts").alias("n"))
    return summed.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct(F.col("sources").alias("source"), "n")).alias("cells"))


def totals(stripes: DataFrame, least: int) -> DataFrame:
    """(lang, kept, total, sources): a row per language with its kept terms, their occurrences, and (source, total) of every group."""
    groups = stripes.filter("term IS NULL").select("lang", F.explode("cells").alias("c")).select("lang", "c.source", F.lit(0).cast("long").alias("n"))
    kept = stripes.filter(F.col("term").isNotNull() & (F.col("docs") >= least))
    cells = kept.select("lang", F.explode("cells").alias("c")).select("lang", "c.source", "c.n")
    by_group = groups.unionAll(cells).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    by_lang = by_group.groupBy("lang").agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("groups"))
    counted = kept.groupBy("lang").agg(F.count("*").alias("kept")).withColumnRenamed("lang", "_lang")
    return by_lang.join(counted, by_lang["lang"] == counted["_lang"], "left").select("lang", F.coalesce("kept", F.lit(0)).alias("kept"), "total", "groups")


def parts_of(counts: np.ndarray, total, kept: int) -> np.ndarray:
    """1 + floor(ONE * (count + 2) / (total + 2 * kept)), exact also beyond 64 bits; ``total`` a number or one per column."""
    if counts.size and int(counts.max()) + 2 > (2**63 - 1) // ONE:
        wide = (counts.astype(object) + 2) * ONE // (np.asarray(total).astype(object) + 2 * kept) + 1
        return wide.astype(np.int64)
    return (counts + 2) * ONE // (np.asarray(total, np.int64) + 2 * kept) + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)); both are at most ONE + 1, so the square has 64 bits."""
    gap = p - q
    return gap * gap // (p + q)


def emitted(stripes: DataFrame, language: DataFrame, least: int, top: int) -> DataFrame:
    """(lang, source, part, item, value): what the kept stripes give, summed within each block of them.

    ``pair``: of each two sources of a language, the lesser first, the summands. ``term``: of each group the terms it holds
    beyond its language's share that are among the block's first ``top``, ties included.
    """
    kept = stripes.filter(F.col("term").isNotNull() & (F.col("docs") >= least)).select("lang", "term", "cells")
    rows = salted_join(kept, language, ["lang"], ["term"]).select("lang", "term", "cells", "kept", "total", "groups")

    def block(lang: str, terms: list, cells: list, kept: int, total: int, groups: list) -> Iterator[tuple]:
        names = [g["source"] for g in groups]
        place = {name: k for k, name in enumerate(names)}
        counts = np.zeros((len(terms), len(names)), np.int64)
        for row, held in zip(counts, cells):
            for cell in held:
                row[place[cell["source"]]] = cell["n"]
        p = parts_of(counts, [g["n"] for g in groups], kept)
        q = parts_of(counts.sum(axis=1), total, kept)
        value = np.where((counts > 0) & (p > q[:, None]), apart(p, q[:, None]), -1)
        for k, name in enumerate(names):
            own = value[:, k]
            bar = max(0, np.partition(own, -top)[-top] if len(own) > top else 0)
            yield from ((lang, name, "term", terms[t], int(own[t])) for t in np.flatnonzero(own >= bar))
            for j, v in enumerate(apart(p[:, k + 1 :], p[:, k : k + 1]).sum(axis=0).tolist()):
                yield lang, name, "pair", names[k + 1 + j], v

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, sizes = batch.column(0).to_pylist(), [len(g) for g in batch.column(5)]
            by_lang: dict[str, list[int]] = {}
            for k, lang in enumerate(langs):
                by_lang.setdefault(lang, []).append(k)
            for lang, at in by_lang.items():
                step = max(1, BLOCK // sizes[at[0]])
                first = {c: batch.column(n)[at[0]].as_py() for n, c in ((3, "kept"), (4, "total"), (5, "groups"))}
                for start in range(0, len(at), step):
                    some = batch.take(pa.array(at[start : start + step]))
                    found = list(block(lang, some.column(1).to_pylist(), some.column(2).to_pylist(), **first))
                    if found:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, kind) for c, kind in zip(zip(*found), (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()))],
                            ["lang", "source", "part", "item", "value"],
                        )

    return rows.mapInArrow(run, "lang string, source string, part string, item string, value long")


def divergences(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP, held_bytes: int = HELD) -> DataFrame:
    """(lang, source, part, item, value, rank) of ``docs`` (text, lang, source).

    ``pair`` lists every other source of the group's language, ``term`` the ``top`` terms the group holds beyond its language's
    share; ranks by value descending, then item. Null text, lang and source are empty strings; every row counts, repeated
    ones too. Languages without kept terms have pairs of value 0; a group alone in its language has none. No rows give no rows.
    """
    stripes = settled(merged(folded(docs, held_bytes)))
    language = settled(totals(stripes, least))
    found = settled(emitted(stripes, language, least, top))
    half = found.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    # without kept terms no stripe speaks for the pairs
    bare = language.filter("kept = 0").select("lang", F.explode("groups.source").alias("source"), "groups")
    bare = bare.select("lang", "source", F.explode("groups.source").alias("item"), F.lit(0).cast("long").alias("value")).filter("source < item")
    half = half.unionByName(bare)
    pairs = half.unionByName(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order)
    terms = found.filter("part = 'term'").select("lang", "source", "item", "value").withColumn("rank", rank).filter(F.col("rank") <= top)
    pairs = pairs.withColumn("rank", rank)
    named = lambda frame, part: frame.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return named(pairs, "pair").unionByName(named(terms, "term"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row_no, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (
  SELECT row_no, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
),
kept AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT row_no) >= 10),
groups AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(term) AS v FROM (SELECT DISTINCT lang FROM d) LEFT JOIN kept USING (lang) GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
cell AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n FROM groups g JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source)::HUGEINT + 2 * v) AS p FROM cell JOIN v USING (lang)),
sums AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM cell GROUP BY ALL),
q AS (SELECT lang, term, 1 + (1000000000 * (n + 2)) // (sum(n) OVER (PARTITION BY lang)::HUGEINT + 2 * v) AS q FROM sums JOIN v USING (lang)),
pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)), 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL
),
term AS (SELECT p.lang, p.source, p.term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pair
UNION ALL
SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM term) WHERE rank <= 10
"""


@query("op13_source_divergence", SQL)
def op13(spark, sf_dir):
    return divergences(documents(spark, sf_dir, "text", "lang", "source"))
