"""Spelling variants, license scans and source divergences against plain statements of their results."""

import random

import numpy as np
import pytest

from dealtide.llm import licenses, spelling, stripes
from dealtide.llm.registry import ORACLES

from . import brute
from .conftest import table


def variants(seed, count=120):
    """Words with their misspellings, some far more frequent than others, in upper and lower case and with letters beyond ASCII."""
    rng = random.Random(seed)
    letters = "abé"
    words = []
    for _ in range(count):
        word = "".join(rng.choice(letters) for _ in range(rng.choice([5, 6, 7, 12])))
        words += [word] * rng.choice([1, 5, 6, 30, 160])
        for _ in range(rng.randrange(4)):
            at, kind = rng.randrange(len(word) + 1), rng.randrange(3)
            other = word[:at] + rng.choice(letters) * (kind < 2) + word[at + (kind > 0) :]
            words += [other] * rng.choice([4, 5, 9, 26])
    rng.shuffle(words)
    return [(n, " ".join(w.upper() if rng.random() < 0.1 and w.isascii() else w for w in words[n::40])) for n in range(40)]


def spelled(spark, rows, **settings):
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return sorted((tuple(r) for r in spelling.grouped(frame, **settings).collect()), key=lambda r: r[0])


@pytest.mark.parametrize("seed", [1, 2])
def test_spelling_against_brute_force(spark, seed):
    rows = variants(seed)
    got = spelled(spark, rows, dropped=7, wide=3)  # letters are lost often, nodes are dealt to many parts
    assert got == brute.spelling(rows, dropped=7)
    assert any(r[1] for r in got) and any(r[4] > 3 for r in got)


def test_spelling_of_odd_documents(odd, rows):
    got = sorted((tuple(r) for r in spelling.grouped(odd).collect()), key=lambda r: r[0])
    assert got == brute.spelling(rows) and len(got) > 50


def test_spelling_edges(spark, none):
    assert spelling.grouped(none).count() == 0
    assert spelling.grouped(none).columns == ["word", "form", "root", "n", "n_near", "form_n"]
    long = "".join("abcdefghij"[k * k % 10] for k in range(700))
    texts = [long] * 30 + [long[:350] + long[351:]] * 6 + [long + "x"] * 5 + ["abcdef"] * 5 + ["abcdefg"] * 4 + [None, "", "12 345", "abcdef" + "z" * 6]
    rows = [(None if n % 9 == 0 else n, t) for n, t in enumerate(texts)]
    got = spelled(spark, rows, dropped=10**9)
    assert got == brute.spelling(rows, dropped=10**9)
    assert {r[0]: r[4] for r in got}[long] == 2 and {r[0]: r[2] for r in got}[long + "x"] == long


def test_a_chain_of_prefixes(spark):
    """Words along one path of the trie, each a node: as many rounds as words."""
    rows = [(n, " ".join(["a" * (6 + n)] * 5 * 5**n)) for n in range(4)]
    got = spelled(spark, rows, dropped=10**9)
    assert got == brute.spelling(rows, dropped=10**9) and got[0][2] == "a" * 9


MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE\nAUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER\nLIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,\nOUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE\nSOFTWARE."


def labels_of(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: (r.n_words, r.n_covered, [(s.start, s.end, s.label, s.base) for s in r.spans]) for r in licenses.scan(frame).collect()}


def test_license_texts(spark):
    holders = MIT.replace("AUTHORS OR COPYRIGHT HOLDERS", "Jane Doe, Ünïcode & Co")
    long_paragraph = MIT.replace("permission notice shall", "permission notice (including the next paragraph) shall")
    changed = MIT.replace("without restriction", "with restriction")
    many = MIT.replace("AUTHORS OR COPYRIGHT HOLDERS", "a b c d e f g h i j k l m")
    got = labels_of(spark, [MIT, holders, long_paragraph, changed, many, "x " + MIT + " y " + MIT, "Released under the MIT license. CC-BY-NC, cc by nc!", None, ""])
    n = len(brute.license_spans(MIT, [])[1:]) and brute.license_spans(MIT, [])[0]
    assert got[0] == (n, n, [(0, n, "mit", False)]) and len(got[1][2]) == len(got[2][2]) == 1
    assert got[3][2] == got[4][2] == []
    assert [s[:2] for s in got[5][2]] == [(1, 1 + n), (2 + n, 2 + 2 * n)] and got[5][1] == 2 * n
    assert got[6][2] == [(1, 5, "mit", True), (5, 8, "cc-by-nc", True), (8, 11, "cc-by-nc", True)]
    assert got[7] == got[8] == (0, 0, [])


def test_licenses_against_brute_force(spark, odd, rows):
    rng = random.Random(3)
    templates = [("one", "a b [c [d] {1-2}] a"), ("two", "a {0-3} b"), ("three", "b [a b] [c] {0-1} c"), ("four", "a")]
    phrases = {"b c": "base", "a a": "same"}
    texts = [(n, " ".join(rng.choice("abcd") for _ in range(rng.randrange(30)))) for n in range(80)] + [(900, None), (901, "")]
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_words, sorted((s.start, s.end, s.label) for s in r.spans), r.n_covered) for r in licenses.scan(frame, templates, phrases).collect()}
    everything = templates + [(label, phrase) for phrase, label in phrases.items()]
    for n, text in texts:
        size, spans = brute.license_spans(text, everything)
        covered = len({k for s, e, _ in spans for k in range(s, e)})
        assert got[n] == (size, spans, covered), text
    real = licenses.TEMPLATES + [(label, phrase) for phrase, label in licenses.PHRASES.items()]
    found = sorted((r.doc_id, r.n_words, sorted((s.start, s.end, s.label) for s in r.spans)) for r in licenses.scan(odd).collect())
    assert found == sorted((n, *brute.license_spans(text, real)) for n, text in rows)


def test_templates_must_begin_with_a_word():
    for wrong in ("[a] b", "{0-2} a", "", "a [b", "[a b]"):
        with pytest.raises((ValueError, IndexError)):
            licenses.Automaton("x", wrong)
    assert all(licenses.Automaton(label, template).first for label, template in licenses.TEMPLATES)


def listed(frame):
    return sorted(tuple(r) for r in frame.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("held", [stripes.HELD, 1])
def test_divergences_against_brute_force(odd, held):
    rows = [(r.text, r.lang, r.source) for r in odd.collect()]
    for least in (3, 10):
        assert listed(stripes.divergences(odd, least=least, held_bytes=held)) == brute.divergences(rows, least)


def test_divergence_edges(spark, none):
    assert listed(stripes.divergences(none)) == []
    rows = [("a b c", None, None), ("a B", None, "x"), (None, "en", "x"), ("", "en", None), ("a", "en", "y"), ("a a", None, "x"), ("Ünï", "de", "z"), ("a b c", None, None)]
    frame = table(spark, [(n, t, la, s, 0) for n, (t, la, s) in enumerate(rows)]).selectExpr("*", "1 AS term", "2 AS docs", "3 AS cells", "4 AS kept", "5 AS total")
    for least in (1, 2, 3, 10):
        assert listed(stripes.divergences(frame, least=least, top=2)) == brute.divergences(rows, least, 2)
    zero = [r for r in listed(stripes.divergences(frame)) if r[0] == "en"]
    assert len(zero) == 6 and {r[4] for r in zero} == {0}


def test_shares_are_exact_beyond_64_bits():
    counts = np.array([[0, 10**11], [7, 3 * 10**10]])
    totals = [9 * 10**11, 4 * 10**11]
    want = [[1 + 10**9 * (int(c) + 2) // (t + 2 * 5) for c, t in zip(row, totals)] for row in counts]
    assert stripes.parts_of(counts, totals, 5).tolist() == want


def test_new_queries_have_sql():
    assert {"op11_spelling_variants", "op12_license_scan", "op13_source_divergence"} <= set(ORACLES)


def test_rows_that_differ_in_another_column_stay(spark):
    from dealtide.llm import curriculum

    rows = [(1, "a b c d", "s", "en"), (1, "a b c d", "s", "de"), (1, "a b c d", "s", "de"), (2, "e f", "t", "fr")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").selectExpr("*", "1 AS _own", "2 AS _at", "3 AS _row", "4 AS _key")
    taken = curriculum.taken_rows(frame)
    assert taken.columns == frame.columns and {r.lang for r in taken.collect()} == {"en", "de", "fr"}
    assert {(r._own, r._at, r._row, r._key) for r in taken.collect()} == {(1, 2, 3, 4)}


def test_lines_with_clashing_columns(spark):
    from dealtide.llm import fuzzy_lines

    frame = spark.createDataFrame([(1, "one line\nother line here", "x"), (2, "one line\nmore", "y")], "doc_id long, text string, lang string")
    frame = frame.selectExpr("lang AS _row", "doc_id", "1 AS _lines", "text", "2 AS _kept", "3 AS _drops", "4 AS _n_lines", "5 AS _other", "6 AS sid")
    got = {r.doc_id: r for r in fuzzy_lines.deduplicated(frame).collect()}
    assert (got[2].text, got[2]._row, got[2]._lines, got[2]._kept, got[2]._drops, got[2]._n_lines, got[2]._other, got[2].sid) == ("more", "y", 1, 2, 3, 2, 5, 6)
    assert fuzzy_lines.deduplicated(frame.select("text", "doc_id")).columns == ["text", "doc_id", "_n_lines", "_n_dropped"]


def plain_cost(value, cost):
    """Every part of a value that may be a piece, and the least sum over all cuts."""
    from functools import lru_cache
    from math import log10
    from dealtide.llm import secrets

    def piece(part):
        found, low = [1.0] if len(part) == 1 else [], part.lower()
        if len(part) > 1 and (word := cost.word(part)) is not None:
            found.append(word)
        found += [c for kind, c in secrets.DATES if kind.fullmatch(low)]
        for unit in range(1, 9):
            times = len(low) // unit
            if times > 1 and low == low[:unit] * times:
                found.append(min(unit, cost.words.get(low[:unit], 99)) + log10(times))
        if len(low) > 2 and all(low[k : k + 2] in cost.next for k in range(len(low) - 1)):
            found.append(log10(94) + log10(len(low)))
        return min(found, default=None)

    @lru_cache(maxsize=None)
    def best(end):
        return min((best(s) + c for s in range(end) if (c := piece(value[s:end])) is not None), default=0.0)

    return best(len(value))


def test_guess_cost_is_the_least():
    from dealtide.llm import secrets

    cost, rng = secrets.GuessCost(), random.Random(11)
    parts = ["user", "Pass", "qwer", "1999", "20240131", "31.12.2001", "abab", "xyxyxy", "zz", "7", "!", "asdfgf", "wertyuser", "ADMIN", "é", "qwqwqw", "123123123"]
    values = ["password1", "adminadmin", "qwer2020", "aaaa1111", "letmein", "zxcvKey9", "wertyuser", "passwordpassword", "aaaaaaaaaaaa", "qwertyqwerty1", "abcabcab", "İstanbul", "x"] + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 6))) for _ in range(150)]
    values += ["".join(rng.choice("abqw12") for _ in range(rng.randrange(1, 16))) for _ in range(250)]
    for value in values:
        shown = value if len(value.lower()) == len(value) else value.lower()
        assert abs(cost(value) - plain_cost(shown, cost)) < 1e-9, value
    assert round(cost("wertyuser"), 2) == 3.52
    assert cost("qw" * 20_000) < 8 < cost("x7!Lp0@Rk2")  # long runs are cut in time that follows their length


