"""Results that earlier versions had only in part."""

from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from dealtide.llm import fingerprints, fuzzy_lines, ngram_join, sharding

from . import brute
from .conftest import table


def test_bands_find_pairs_at_the_threshold(spark):
    """Short lines with a likeness of 0.8 to 0.81: at least 0.995 of the pairs share a band."""
    random = np.random.default_rng(11)
    letters, rows = np.array(list("abcdefghijklmnopqrstuvwxyz")), []
    while len(rows) < 6000:
        line = "".join(random.choice(letters, 40))  # 36 shingles; 4 of them lost at either end leave 32 of 40
        rows += [(len(rows), line), (len(rows) + 1, line[4:] + "".join(random.choice(letters, 4)))]
    a, b = ({rows[k][1][n : n + 5] for n in range(36)} for k in (0, 1))
    assert 0.8 <= len(a & b) / len(a | b) <= 0.81
    entries = fuzzy_lines.banded(table(spark, rows, "sid long, line string"), 5).withColumn("pair", F.shiftright("sid", 1))
    met = entries.groupBy("pair", "sig").agg(F.countDistinct("sid").alias("n")).filter("n = 2").select("pair").distinct().count()
    assert met >= 0.995 * 3000


def test_equal_texts_are_never_cut_while_there_is_room(spark):
    rows = [(n, f"text {n // 2}" if n < 3000 else f"alone {n}") for n in range(12000)]
    found = sharding.sharded(table(spark, rows, "doc_id long, text string"), shards=4).collect()
    shards = defaultdict(set)
    for r in found:
        shards[rows[r["doc_id"]][1]].add(r["shard"])
    assert all(len(s) == 1 for s in shards.values())


def test_null_id_ahead_of_an_equal_text(spark):
    words = [f"w{n}" for n in range(100)]
    text, near = " ".join(words), " ".join(words[:-2])
    frame = table(spark, [(None, text), (1, text), (2, near)], "doc_id long, text string").coalesce(1)
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in ngram_join.joined(frame).collect())
    assert got == [(0, 0), (1, 1), (2, 1)] and brute.jaccard_components([(1, text), (2, near)])[1][2] == 1


def test_fingerprints_feel_edits_without_blanks_and_of_short_texts(spark):
    random = np.random.default_rng(12)
    text = "".join(chr(0x4E00 + n) for n in random.integers(0, 3000, 2000))
    short = "".join(chr(97 + n) for n in random.integers(0, 26, 27))
    frame = table(spark, [(0, text), (1, "x" + text), (2, short)], "doc_id long, text string")
    f = [r["f"] for r in fingerprints.fingerprinted(frame, "text", "f").orderBy("doc_id").collect()]
    assert sum(a == b for a, b in zip(f[0], f[1])) > 0.9 * 64
    assert len(set(f[2])) > 20  # ten k-mers have 45 pairs
