"""Entries of few nodes are done at once and are in no later round."""

import numpy as np
from pyspark.sql import functions as F

from dealtide.llm import common, fuzzy_lines

from . import brute
from .conftest import table


def kept(monkeypatch):
    held, keep = [], common.settled
    monkeypatch.setattr(common, "settled", lambda frame: held.append(keep(frame)) or held[-1])
    return held


def test_lines_that_met_by_chance_are_in_no_later_round(spark, monkeypatch):
    """Lines alike to a half share bands and are not similar: their entries were carried through every round."""
    rng = np.random.default_rng(3)
    rows = []
    for n in range(60):
        first, second = ("".join(rng.choice(list("abcdefghij"), 40)) for _ in range(2))
        rows += [(4 * n, first + second), (4 * n + 1, first + second[::-1]), (4 * n + 2, second + first[::-1]), (4 * n + 3, first + second + "x")]
    held = kept(monkeypatch)
    docs = table(spark, rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["text"]) for r in fuzzy_lines.deduplicated(docs).collect())
    assert got == brute.fuzzy_lines(rows, size=5)
    assert not [f for f in held if "main" in f.columns and not f.isEmpty()]


def test_entries_of_few_and_of_many_nodes_link_the_same(spark):
    rng = np.random.default_rng(5)
    rows = {(int(s), int(n)) for s, n in zip(rng.integers(0, 12, 400), rng.integers(0, 60, 400))} | {(100 + k, n) for k in range(20) for n in (k, k + 1)}
    entries = spark.createDataFrame(sorted(rows), "sig long, sid long").withColumn("n", F.lit(0))
    alike = lambda pairs: pairs.filter(F.pmod(F.xxhash64("a", "b"), F.lit(9)) == 0)
    labels = [sorted(map(tuple, common.components(common.star_links(entries, alike, few=few)).collect())) for few in (0, 2, 16, 100)]
    assert labels[0] and labels.count(labels[0]) == 4
