"""Price parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE

EURO_PRICE = rf"€{SPACE}*(\d+[.,]\d{{2}})"
PLAIN_PRICE = r"\d+[.,]\d{2}"


def decimal_point(number: Column) -> Column:
    """``12,50`` or ``12.50`` as a double."""
    return F.replace(number, F.lit(","), F.lit(".")).cast("double")


def numbers_in(text: Column, pattern: str, group: int = 1) -> Column:
    """All numbers matched by ``pattern`` as an array of doubles."""
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), decimal_point)


def number_prefix(text: Column) -> Column:
    """The longest number at the start of ``text``, null if it does not start with one."""
    lead = F.regexp_extract(text, rf"^{SPACE}*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return F.nullif(lead, F.lit("")).try_cast("double")


def parse_price(text: Column) -> Column:
    """Keep digits and separators, read the first comma as the decimal point, parse the prefix.

    ``1.299,00`` reads as 1.299, as the rule demands.
    """
    kept = F.regexp_replace(text, r"[^\d.,]", "")
    comma = F.locate(",", kept)
    pointed = F.when(comma > 0, F.overlay(kept, F.lit("."), comma, F.lit(1))).otherwise(kept)
    return F.nullif(F.regexp_extract(pointed, r"^(\d+\.?\d*|\.\d+)", 1), F.lit("")).cast("double")
