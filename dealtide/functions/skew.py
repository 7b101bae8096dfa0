"""Joins on keys of which one may hold a large part of all rows, and scans of which one task would do all the work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 8


def salt_of(*columns: str, salts: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int")


def spread(frame: DataFrame, *keys: str) -> DataFrame:
    """``frame`` dealt by its ``keys`` over as many tasks as the session shuffles into.

    For tables of few files or row groups whose rows are costly to work on: a scan has a task per split, and splits go by bytes.
    The number is stated, so that AQE, which goes by bytes too, does not join the parts again. Only columns in use are moved.
    """
    return frame.repartition(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], spread: list[str], how: str = "inner") -> DataFrame:
    """``big`` joined to ``small`` on ``keys``, with every key of ``big`` spread over several tasks.

    ``small`` is the reduced side (few rows per key); it is repeated once per salt, and rows of ``big`` take
    the salt of their ``spread`` columns. ``how``: inner, left, left_semi or left_anti.
    """
    salted = big.withColumn("_salt", salt_of(*spread))
    repeated = small.withColumn("_salt", F.explode(F.array(*[F.lit(n) for n in range(SALTS)])))
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")
