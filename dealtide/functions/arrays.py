"""Array helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unnest(frame: DataFrame, kept: list, array: Column, element: str, index: str = "_n") -> DataFrame:
    """One row per non-null element of ``array``, with its position.

    The outer form is used on purpose: for the plain one the optimizer adds a size test that computes
    the array a second time below the generator, which doubles the work of a costly array.
    """
    rows = frame.select(*kept, F.posexplode_outer(array).alias(index, element))
    return rows.filter(F.col(element).isNotNull())


def at_first(condition, array: Column) -> Column:
    """The first element that meets ``condition``, null when none does."""
    return F.get(F.filter(array, condition), F.lit(0))


def once(value: Column, use) -> Column:
    """``use`` of ``value``, which is computed once however often it is used: an array of one element holds it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
