"""Large groups of sets that are not alike are told apart by sketches."""

import numpy as np
from pyspark.sql import functions as F

from dealtide.llm import ngram_join

from . import brute
from .conftest import table


def families(count=40, words=150, changed=36):
    """Texts that each replace another part of one text, so that they share tokens and few are similar."""
    rng = np.random.default_rng(7)
    base = [f"w{n}" for n in rng.permutation(words)]
    rows = []
    for n in range(count):
        text = list(base)
        for at in rng.choice(words, changed // 4, replace=False):
            text[at] = f"x{at}y{rng.integers(3)}"
        rows.append((n, " ".join(text)))
    return rows + [(count + n, rows[n][1] + " end") for n in range(0, count, 5)]


def test_sketches_lose_no_similar_pair_and_drop_others(spark):
    rows = families()
    found = [(n, sorted(brute.shingles(t, 4))) for n, t in rows]
    names = {s: k for k, s in enumerate(sorted({s for _, some in found for s in some}))}
    hashed = ngram_join.mixed(np.arange(1, len(names) + 1, dtype=np.uint64)) & ngram_join._TOKEN
    sets = spark.createDataFrame([(n, len(some), [int(hashed[names[s]].view(np.int64)) for s in some]) for n, some in found], "sid long, n long, tokens array<long>")
    marked = ngram_join.sketches(sets)
    both = marked.join(marked.select(F.col("sid").alias("other"), F.col("n").alias("m")), F.col("sid") < F.col("other"))
    left = {(r["sid"], r["other"]) for r in both.filter(ngram_join.close(85)).select("sid", "other").collect()}
    by = {n: set(some) for n, some in found}
    true = {(a, b) for a in by for b in by if a < b and 100 * len(by[a] & by[b]) >= 85 * len(by[a] | by[b])}
    assert true <= left and len(left) < len(by) * (len(by) - 1) / 8


def test_large_groups_not_alike_are_not_paired_in_the_join(spark, monkeypatch):
    """The last comparison went through every pair of a group whose sizes allow likeness."""
    rows, asked, look = families(), [], ngram_join.verified
    monkeypatch.setattr(ngram_join, "verified", lambda pairs, *rest: asked.append(pairs.count()) or look(pairs, *rest))
    docs = table(spark, rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"]) for r in ngram_join.joined(docs).collect())
    assert got == sorted((i, c) for i, _, c in brute.jaccard_components(rows, 4, 85))
    assert len(asked) < 3 or asked[2] < len(rows)
