"""Lines that are not similar hardly meet, and each text is fetched once."""

import numpy as np
from pyspark.sql import functions as F

from dealtide.llm import common, fuzzy_lines

from . import brute
from .conftest import table


def test_lines_alike_to_a_half_hardly_share_a_band(spark):
    """Bands of three least hashes were shared by seven in ten of such pairs, runs of five shingles by four in ten."""
    rng = np.random.default_rng(9)
    letters, rows = np.array(list("abcdefghijklmnopqrstuvwxyz")), []
    for n in range(300):
        common_part = "".join(rng.choice(letters, 140))
        rows += [(2 * n + k, common_part + "".join(rng.choice(letters, 70))) for k in range(2)]
    entries = fuzzy_lines.banded(table(spark, rows, "sid long, line string"), 5).withColumn("pair", F.shiftright("sid", 1))
    met = entries.groupBy("pair", "sig").agg(F.countDistinct("sid").alias("n")).filter("n = 2").select("pair").distinct().count()
    assert met < 0.55 * 300


def test_short_lines_miss_no_pair(spark):
    rng = np.random.default_rng(10)
    rows = []
    for n in range(0, 800, 2):
        size = int(rng.integers(5, 42))
        line = "".join(rng.choice(list("abcdefgh"), size))
        at = int(rng.integers(0, size))
        rows += [(n, line), (n + 1, line[:at] + "#" * int(rng.integers(0, 2)) + line[at + 1 :])]
    docs = table(spark, rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["text"]) for r in fuzzy_lines.deduplicated(docs).select("doc_id", "text").collect())
    assert got == brute.fuzzy_lines(rows)


def test_texts_are_fetched_once(spark, monkeypatch):
    """Every round of comparisons went through all lines again."""
    rows = [(n, f"een regel die in heel veel documenten staat, met slechts een klein verschil erin {n:02d}") for n in range(40)]
    told, links = [], common.star_links
    monkeypatch.setattr(fuzzy_lines, "star_links", lambda *a, fetched, **k: links(*a, fetched=lambda sids: told.append(sids.count()) or fetched(sids), **k))
    got = fuzzy_lines.deduplicated(table(spark, rows, "doc_id long, text string")).filter("_n_dropped = 0").count()
    assert (got, told) == (1, [40])
