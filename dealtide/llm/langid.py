"""Language identification by rank-order profiles (Cavnar and Trenkle, 1994).

A language's profile lists its most frequent character n-grams by rank. A document's own list is compared with each
profile: every n-gram counts by how far its ranks differ, an absent one by the greatest difference; the least sum wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents
from .registry import query

#: N-grams of a profile, of a language or of a document.
PROFILE = 300
#: More languages than this are taken for an error in the column, as all profiles go to every task.
LANGUAGES = 1000
#: Below this likeness to the nearest language a text is in none of them.
LEAST = 0.03
NONE = "und"
_BLANK, _BITS, _CHUNK, _HELD = 1, 21, 1 << 20, 1 << 21


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.array([chr(n).isalpha() for n in range(0x110000)])


def grams(text: str) -> np.ndarray:
    """All 1- to 3-grams of the lower-cased words of a text as numbers; words are padded with one blank at either side."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(letters()[codes], codes, _BLANK).astype(np.int64)
    a, b = c[:-1], c[1:]
    two = ((a << _BITS) | b)[(a != _BLANK) | (b != _BLANK)]
    x, y, z = c[:-2], c[1:-1], c[2:]
    three = ((x << 2 * _BITS) | (y << _BITS) | z)[y != _BLANK]
    return np.concatenate([c[c != _BLANK], two, three])


def profile(found: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent numbers by falling count, ties by number."""
    values, counts = np.unique(found, return_counts=True)
    return values[np.argsort(-counts, kind="stable")[:size]]


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    values, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return values, np.bincount(where, np.concatenate([p[1] for p in parts])).astype(np.int64)


def learn(labelled: DataFrame, size: int = PROFILE) -> list[tuple[str, list[int]]]:
    """The profile of each language of ``labelled`` (text, lang), from all of its rows.

    Counts are summed per task, then per n-gram; only the ranked heads, ``size`` numbers a language, reach the driver.
    Rows without text or lang teach nothing.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def rows():
            for lang, (values, counts) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(values), pa.array(counts)], ["lang", "gram", "n"])

        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                texts: dict[str, list[str]] = {}
                for text, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    texts.setdefault(lang, []).append(text)
                for lang, some in texts.items():
                    new, joined, n = [], [], 0
                    for text in [*some, None]:
                        if joined and (text is None or n > _CHUNK):
                            new.append(np.unique(grams(" ".join(joined)), return_counts=True))
                            joined, n = [], 0
                        if text is not None:
                            joined.append(text)
                            n += len(text)
                    held[lang] = merged([*([held[lang]] if lang in held else []), *new])
            if sum(len(v) for v, _ in held.values()) > _HELD:
                yield from rows()
                held.clear()
        yield from rows()

    source = labelled.select("text", "lang").filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    totals = source.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = totals.withColumn("rank", rank).filter(F.col("rank") <= size).select("lang", "gram", "rank")
    rows = top.limit(size * LANGUAGES + 1).collect()
    if len(rows) > size * LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    found: dict[str, list[int]] = {}
    for row in sorted(rows, key=lambda r: (r["lang"], r["rank"])):
        found.setdefault(row["lang"], []).append(row["gram"])
    return sorted(found.items())


class Judge:
    """Profiles as sorted arrays, for look-up."""

    def __init__(self, profiles: list[tuple[str, list[int]]], size: int):
        self.size = size
        self.languages = [lang for lang, _ in profiles]
        self.tables = []
        for _, listed in profiles:
            order = np.argsort(np.array(listed, np.int64))
            self.tables.append((np.array(listed, np.int64)[order], order))

    def __call__(self, text: str | None) -> tuple[str, float]:
        found = grams(text) if text else np.zeros(0, np.int64)
        if not len(found) or not self.tables:
            return NONE, 0.0
        own = profile(found, self.size)
        ranks = np.arange(len(own))
        far = []
        for values, places in self.tables:
            at = np.minimum(np.searchsorted(values, own), len(values) - 1)
            far.append(int(np.where(values[at] == own, np.minimum(np.abs(places[at] - ranks), self.size), self.size).sum()))
        best = int(np.argmin(far))
        return self.languages[best], 1.0 - far[best] / (self.size * len(own))


def predict(docs: DataFrame, profiles: list[tuple[str, list[int]]], size: int = PROFILE) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of ``docs`` (doc_id, text), from the text alone.

    Null texts, texts without a letter, and all texts if nothing was learned are ``und`` with score 0. Of languages equally
    near the first by name wins. Repeated rows are each judged. No shuffle.
    """
    source = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(profiles, size)
        for batch in batches:
            found = [judge(text) for text in (t.as_py() for t in batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"]
            )

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def accepted(docs: DataFrame, profiles: list[tuple[str, list[int]]], size: int = PROFILE, least: float = LEAST) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text has a language and is at least ``least`` like it. No shuffle."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(profiles, size)
        for batch in batches:
            found = [judge(text) for text in (t.as_py() for t in batch.column(at))]
            yield batch.filter(pa.array([lang != NONE and score >= least for lang, score in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: Column) -> Column:
    """A fifth of the documents, never learned from; so are those without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def profiles_of(docs: DataFrame) -> list[tuple[str, list[int]]]:
    return learn(docs.filter(~held_out(F.col("doc_id"))))


@query("op2_language_id")
def op2(spark, sf_dir):
    profiles = profiles_of(documents(spark, sf_dir, "doc_id", "text", "lang"))
    found = predict(documents(spark, sf_dir), profiles)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
