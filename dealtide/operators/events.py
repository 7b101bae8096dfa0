"""Event analytics over the event table: counts, top lists, funnels and engagement.

Every operator filters on the event time first (the predicate reaches the scan and prunes day
partitions), aggregates once, and orders only the aggregate. The key breaks ties in every top list.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import present
from ..params import clamp_days, clamp_int, day_since, since

# The events the site sends.
ENGAGEMENT_EVENTS = [
    "folder_view", "folder_engaged_15s", "folder_scroll_50", "folder_scroll_90", "folder_page_turn",
]
ATTRIBUTION = "attribution_set"
OUTBOUND = "outbound_click"

EXPORT_COLUMNS = [
    "created_at", "event_name", "path", "retailer", "destination_url",
    "utm_source", "utm_medium", "utm_campaign", "utm_content",
]


def _window(events: DataFrame, as_of: datetime | str, days, default: int) -> DataFrame:
    """The events of the last ``days``; stored events are read from the day partitions that can hold them only."""
    days = clamp_days(days, default)
    if "event_date" in events.columns:
        events = events.filter(day_since(events, "event_date", as_of, days))
    return events.filter(since(events, "created_at", as_of, days))


def _count_if(condition: Column) -> Column:
    return F.count_if(condition)


def _n() -> Column:
    return F.count(F.lit(1))


def utm_only_metrics(events, event_name: str, as_of, limit=500, days=365) -> DataFrame:
    """Count, first and last time per post; the largest ``limit`` posts. Events without a post form a group."""
    kept = _window(events, as_of, days, 365).filter(F.col("event_name") == event_name)
    return (
        kept.groupBy("utm_content")
        .agg(_n().alias("count"), F.min("created_at").alias("first_seen_at"), F.max("created_at").alias("last_seen_at"))
        .orderBy(F.desc("count"), "utm_content")
        .limit(clamp_int(limit, 500, 1))
    )


def event_total_count(events, event_name: str, as_of, days=30) -> DataFrame:
    return _window(events, as_of, days, 30).filter(F.col("event_name") == event_name).agg(_n().alias("count"))


def event_count_for_utm(events, event_name: str, utm_content: str, as_of, days=30) -> DataFrame:
    kept = _window(events, as_of, days, 30)
    return kept.filter((F.col("event_name") == event_name) & (F.col("utm_content") == utm_content)).agg(
        _n().alias("count")
    )


def clicks_by_retailer_for_utm(events, utm_content: str, as_of, days=30, limit=200) -> DataFrame:
    kept = _window(events, as_of, days, 30)
    kept = kept.filter((F.col("event_name") == OUTBOUND) & (F.col("utm_content") == utm_content))
    return (
        kept.groupBy("retailer")
        .agg(_n().alias("count"), F.max("created_at").alias("last_seen_at"))
        .orderBy(F.desc("count"), "retailer")
        .limit(clamp_int(limit, 200, 1))
    )


def recent_events_for_utm(events, utm_content: str, as_of, days=30, limit=200) -> DataFrame:
    kept = _window(events, as_of, days, 30).filter(F.col("utm_content") == utm_content)
    return (
        kept.select("id", *EXPORT_COLUMNS)
        .orderBy(F.desc("created_at"), F.desc("id"))
        .limit(clamp_int(limit, 200, 1))
    )


def utm_content_metrics(events, event_name: str, as_of, limit=200, days=30) -> DataFrame:
    kept = _window(events, as_of, days, 30).filter(F.col("event_name") == event_name)
    return (
        kept.groupBy("utm_content", "retailer")
        .agg(_n().alias("count"), F.min("created_at").alias("first_seen_at"), F.max("created_at").alias("last_seen_at"))
        .orderBy(F.desc("count"), "utm_content", "retailer")
        .limit(clamp_int(limit, 200, 1))
    )


def retailer_metrics(events, event_name: str, as_of, limit=200, days=30) -> DataFrame:
    kept = _window(events, as_of, days, 30).filter(F.col("event_name") == event_name)
    return (
        kept.groupBy("retailer")
        .agg(_n().alias("count"), F.max("created_at").alias("last_seen_at"))
        .orderBy(F.desc("count"), "retailer")
        .limit(clamp_int(limit, 200, 1))
    )


def _daily(kept: DataFrame) -> DataFrame:
    day = F.date_format("created_at", "yyyy-MM-dd").alias("day")
    return kept.groupBy(day, "event_name").agg(_n().alias("count")).orderBy(F.desc("day"), "event_name")


def daily_metrics(events, as_of, days=30) -> DataFrame:
    """Count per UTC day and event name, newest day first."""
    return _daily(_window(events, as_of, days, 30))


def event_timeseries(events, as_of, days=60) -> DataFrame:
    return daily_metrics(events, as_of, clamp_days(days, 60))


def engagement_daily(events, as_of, days=30) -> DataFrame:
    """Daily counts of the engagement events only; filtered before the aggregate."""
    return _daily(_window(events, as_of, days, 30).filter(F.col("event_name").isin(ENGAGEMENT_EVENTS)))


def events_for_export(
    events, as_of, event_name=None, utm_content=None, retailer=None, days=30, limit=5000
) -> DataFrame:
    """Newest events, narrowed by each filter that is given."""
    kept = _window(events, as_of, days, 30)
    for column, value in (("event_name", event_name), ("utm_content", utm_content), ("retailer", retailer)):
        if value is not None:
            kept = kept.filter(F.col(column) == value)
    return (
        kept.select("id", *EXPORT_COLUMNS)
        .orderBy(F.desc("created_at"), F.desc("id"))
        .limit(clamp_int(limit, 5000, 1))
    )


def recent_events(events, limit=100) -> DataFrame:
    return (
        events.select("id", *EXPORT_COLUMNS)
        .orderBy(F.desc("created_at"), F.desc("id"))
        .limit(clamp_int(limit, 100, 1))
    )


def post_counts(kept: DataFrame, *by: str) -> DataFrame:
    """Attributions and outbound clicks per post, both sides of the funnel in one pass and one shuffle."""
    name = F.col("event_name")
    return (
        kept.filter(name.isin(ATTRIBUTION, OUTBOUND) & present(F.col("utm_content")))
        .groupBy("utm_content", *by)
        .agg(
            _count_if(name == ATTRIBUTION).alias("attribution_set_total"),
            _count_if(name == OUTBOUND).alias("outbound_click_total"),
        )
    )


def post_funnel(events, as_of, days=30) -> DataFrame:
    """Per post: attributions against outbound clicks, zero where a side is missing; most clicks first."""
    counts = post_counts(_window(events, as_of, days, 30))
    return counts.orderBy(F.desc("outbound_click_total"), "utm_content")


def post_detail(events, utm_content: str, as_of, days=30) -> DataFrame:
    """Totals of one post. The per-retailer and latest rows are B5 and B6 for the same post."""
    return (
        _window(events, as_of, days, 30)
        .filter((F.col("utm_content") == utm_content) & F.col("event_name").isin(ATTRIBUTION, OUTBOUND))
        .agg(
            _count_if(F.col("event_name") == ATTRIBUTION).alias("attribution_total"),
            _count_if(F.col("event_name") == OUTBOUND).alias("outbound_total"),
        )
        .select(F.lit(utm_content).alias("utm_content"), "attribution_total", "outbound_total")
    )


def engagement_by_retailer(events, as_of, days=30) -> DataFrame:
    """One column per engagement event, one row per retailer; one scan and one shuffle."""
    kept = _window(events, as_of, days, 30)
    kept = kept.filter(F.col("event_name").isin(ENGAGEMENT_EVENTS) & present(F.col("retailer")))
    counts = [_count_if(F.col("event_name") == name).alias(name) for name in ENGAGEMENT_EVENTS]
    return kept.groupBy("retailer").agg(*counts).orderBy(F.desc("folder_view"), "retailer")


def _per_view(column: str, factor: float = 1.0) -> Column:
    views = F.col("folder_view")
    return F.when(views > 0, F.col(column) * F.lit(factor) / views)


def engagement_rates(engagement: DataFrame) -> DataFrame:
    """Rates per view as plain ratios, null without views; rounding is left to the display."""
    return engagement.select(
        "retailer",
        "folder_view",
        _per_view("folder_engaged_15s", 100.0).alias("engaged_pct"),
        _per_view("folder_scroll_90", 100.0).alias("scroll90_pct"),
        _per_view("folder_page_turn").alias("turns_per_view"),
    )


def retailer_clicks_ranking(events, as_of, days=30) -> DataFrame:
    """Outbound clicks per named retailer, most first."""
    kept = _window(events, as_of, days, 30)
    kept = kept.filter((F.col("event_name") == OUTBOUND) & present(F.col("retailer")))
    return kept.groupBy("retailer").agg(_n().alias("outbound_click")).orderBy(F.desc("outbound_click"), "retailer")


def campaign_post_kpis(events, as_of, days=30) -> DataFrame:
    """Clicks per post and their ratio to attributions."""
    counts = post_counts(_window(events, as_of, days, 30))
    sets = F.col("attribution_set_total")
    return counts.select(
        "utm_content",
        "outbound_click_total",
        F.when(sets > 0, F.col("outbound_click_total") / sets).alias("click_ratio"),
    )


def campaign_retailer_kpis(events, as_of, days=30) -> DataFrame:
    """Engaged and deep-scroll shares of views per retailer."""
    return engagement_by_retailer(events, as_of, days).select(
        "retailer",
        _per_view("folder_engaged_15s").alias("engaged_share"),
        _per_view("folder_scroll_90").alias("scroll90_share"),
    )


def campaign_go_no_go(events, as_of, campaign: str, baseline: str, days=14) -> DataFrame:
    """Posts of ``campaign`` against the median clicks per post of ``baseline`` in the same period.

    The posts are counted once per side; the median comes back as a scalar subquery, so no join is run.
    """
    kept = _window(events, as_of, days, 14).filter(F.col("event_name").isin(ATTRIBUTION, OUTBOUND))
    posts = post_counts(kept.filter(F.col("utm_campaign").isin(campaign, baseline)), "utm_campaign")
    middle = posts.filter(F.col("utm_campaign") == baseline).agg(F.median("outbound_click_total")).scalar()
    rated = posts.filter(F.col("utm_campaign") == campaign).select(
        "utm_content", F.col("outbound_click_total").alias("clicks"), middle.alias("baseline_median")
    )
    return rated.withColumn("go", F.col("clicks") >= F.col("baseline_median"))
