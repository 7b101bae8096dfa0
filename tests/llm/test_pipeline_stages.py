"""Stages of the pipeline against brute force."""

import numpy as np

import corpus_pipeline

from . import brute
from .conftest import SMALL, table


def test_near_duplicates_stage(spark, odd, rows):
    """Word 5-grams and 0.8, on odd documents and on one with a passage replaced, between 0.8 and 0.85 on 4-grams."""
    words = [f"w{n}" for n in np.random.default_rng(8).permutation(200)]
    texts = [" ".join(words), " ".join(words[:90] + [f"x{n}" for n in range(15)] + words[105:])]
    sets = [brute.shingles(t, 4) for t in texts]
    assert 0.8 <= len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 0.85
    more = [(2000 + n, t) for n, t in enumerate(texts)]
    docs = odd.select("doc_id", "text").union(table(spark, more, "doc_id long, text string"))
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SMALL).collect()}
    assert kept == {i for i, _, c in brute.jaccard_components(rows + more, 5, 80) if i == c} and 2001 not in kept


def test_line_dedup_stage_on_short_lines(spark):
    """A short line with one letter or number replaced goes; every pair is compared on 5-character shingles."""
    lines = ["Alle Rechte vorbehalten, Copyright der Musterfirma 2019 in Bonn", "Alle Rechte vorbehalten, Copyright der Musterfirma 2018 in Bonn", "Eine ganz andere Zeile, die bleibt, wie sie ist"]
    rows = [(n, line) for n, line in enumerate(lines)]
    docs = table(spark, [(n, t, "de", "z", len(t)) for n, t in rows])
    got = sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.line_dedup(spark, docs, SMALL).collect())
    assert got == brute.fuzzy_lines(rows, size=5) and got[1] == (1, "")
