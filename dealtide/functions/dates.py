"""ISO weeks, leaflet weeks and ages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_DAY = r"^\d{4}-\d{2}-\d{2}\z"


def iso_week(day: Column) -> Column:
    return F.weekofyear(day)


def iso_week_year(day: Column) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), day).cast("int")


def week_start(moment: Column) -> Column:
    """Monday of the week of ``moment``."""
    return F.trunc(moment.cast("date"), "week")


def week_dates(moment: Column) -> Column:
    monday = week_start(moment)
    return F.struct(monday.alias("valid_from"), F.date_add(monday, 6).alias("valid_until"))


def folder_id(slug: Column, moment: Column, suffix: str = "folder") -> Column:
    """``slug-YYYY-wN-suffix``: calendar year with ISO week, as the ids in use have it."""
    return F.concat_ws(
        "-", slug, F.year(moment).cast("string"), F.concat(F.lit("w"), iso_week(moment).cast("string")), F.lit(suffix)
    )


def iso_instant(text: Column) -> Column:
    """ISO date or date-time text as a zone-free UTC timestamp; month-first dates read as browsers do; else null."""
    zoned = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"), text).try_cast("timestamp")
    moment = F.to_utc_timestamp(zoned, F.current_timezone()).cast("timestamp_ntz")
    month_first = F.regexp_replace(text, r"^(\d{2})[-/](\d{2})[-/](\d{4})\z", "$3-$1-$2")
    day = F.when(month_first.rlike(ISO_DAY), month_first).try_cast("timestamp_ntz")
    return F.coalesce(day, moment)


def end_of_day(text: Column) -> Column:
    """23:59:59 of an ISO day; null if ``text`` is not one."""
    return F.when(text.rlike(ISO_DAY), F.concat(text, F.lit(" 23:59:59"))).try_cast("timestamp_ntz")


def hours_between(later: Column, earlier: Column) -> Column:
    """Fractional hours from ``earlier`` to ``later`` (both zone-free); negative if ``later`` comes first."""
    return F.timestamp_diff("MICROSECOND", earlier, later) / F.lit(3_600_000_000.0)


def format_age(hours: Column) -> Column:
    def nearest(value: Column) -> Column:
        return F.floor(value + F.lit(0.5)).cast("string")

    return (
        F.when(hours.isNull(), "unknown age")
        .when(hours < 1, F.concat(nearest(hours * 60), F.lit("m")))
        .when(hours < 24, F.concat(nearest(hours), F.lit("h")))
        .otherwise(F.concat(nearest(hours / 24), F.lit("d")))
    )
