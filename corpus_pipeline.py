"""A corpus pipeline of five stages, each by one of the training-data operators.

Every stage takes (spark, docs, sf_dir), with the columns of ``documents``, and returns a DataFrame; all but the last return
those columns. ``run`` writes each stage's result as parquet into the shared folder and reads it back for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealtide.llm import bpe, curriculum, fuzzy_lines, langid, ngram_join
from dealtide.llm.common import documents, settled

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are in some learned language; null texts and texts without letters go."""
    return langid.accepted(docs, langid.profiles_of(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the lines that repeat others; ``n_chars`` follows the text. No document goes."""
    found = fuzzy_lines.deduplicated(docs).drop("_n_lines", "_n_dropped")
    return found.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a Jaccard likeness of 0.8 of their word 5-grams the one of least doc_id. Documents without an id stay."""
    return ngram_join.representatives(docs, width=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per pass in which a document is taken, in the order of training positions."""
    return curriculum.taken_rows(docs)


def bpe_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row; null and empty texts have no ids, repeated rows stay, other columns are left out."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("bpe", bpe_round_trip),
]

#: Profiles, fuzzy links and BPE have no SQL; tests compare line dedup, near duplicates and BPE with plain statements of their results.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, *COLUMNS)
    for _, stage in STAGES:
        docs = settled(stage(spark, docs, sf_dir))
    return docs
