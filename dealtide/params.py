"""Argument handling shared by the operators: clamps, clocks and shared folders."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def clamp_int(value, default: int, low: int, high: int | None = None) -> int:
    """Floor ``value`` into [low, high], or to ``low`` at least without ``high``; anything that is not a finite number becomes ``default``."""
    try:
        number = float(value)
    except (TypeError, ValueError):
        return default
    if not math.isfinite(number):
        return default
    number = max(math.floor(number), low)
    return number if high is None else min(number, high)


def clamp_days(value, default: int) -> int:
    """A whole number of days, one at least. There is no upper bound: a caller who wants one passes it in ``value``."""
    return clamp_int(value, default, 1)


def instant(as_of: datetime | str) -> datetime:
    return as_of if isinstance(as_of, datetime) else datetime.fromisoformat(as_of)


def time_literal(like: DataFrame, column: str, moment: datetime | str) -> Column:
    """A constant of exactly the type of ``like[column]``.

    A literal of another timestamp type would put a cast on the column, and a cast column is not
    pushed into the parquet scan.
    """
    kind = like.schema[column].dataType
    moment = instant(moment)
    if isinstance(kind, T.DateType):
        return F.lit(moment.date())
    if isinstance(kind, T.StringType):
        return F.lit(moment.strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z")
    return F.lit(moment.strftime("%Y-%m-%d %H:%M:%S.%f")).cast(kind)


def since(like: DataFrame, column: str, as_of: datetime | str, days: int) -> Column:
    """``column >= as_of - days`` as a predicate the scan can use."""
    return F.col(column) >= time_literal(like, column, instant(as_of) - timedelta(days=days))


def day_since(like: DataFrame, column: str, as_of: datetime | str, days: int) -> Column:
    """The days that can hold moments of ``since``, as a predicate on a day partition column of dates or ISO strings."""
    day = (instant(as_of) - timedelta(days=days)).date()
    return F.col(column) >= (F.lit(day.isoformat()) if isinstance(like.schema[column].dataType, T.StringType) else F.lit(day))


def clock(as_of: datetime | str) -> Column:
    """``as_of`` as a zone-free timestamp: every rule of this library is evaluated in UTC."""
    return F.lit(instant(as_of).strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def shared_folder(spark: SparkSession, fallback: str | None = None) -> str:
    """The shared checkpoint folder the cluster names; ``fallback`` is used only where it names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder is None:
        folder = fallback
    if folder is None:
        raise ValueError("spark.checkpoint.dir is not set and no fallback folder was given")
    return folder


def settled(frame: DataFrame) -> DataFrame:
    """``frame`` computed once into the shared checkpoint folder, for results that several branches read.

    Without a checkpoint folder the frame is returned as it is and each branch computes it.
    """
    return frame.checkpoint() if frame.sparkSession.sparkContext.getCheckpointDir() else frame
