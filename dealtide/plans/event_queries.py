"""Event analytics and revenue over the test events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events as ev
from ..operators import revenue as rv
from .registry import query
from .views import AS_OF

NOW = f"TIMESTAMP '{AS_OF}'"
POST = "post-7"


def _since(days: int) -> str:
    return f"created_at >= {NOW} - INTERVAL {days} DAY"


@query(
    "read_events",
    """SELECT id, created_at, event_name, path, retailer, destination_url, utm_source, utm_medium, utm_campaign, utm_content
       FROM sp_events""",
)
def read_events(t):
    return t.sp_events.select("id", *ev.EXPORT_COLUMNS)


@query(
    "utm_only_metrics",
    f"""SELECT utm_content, count(*) AS count, min(created_at) AS first_seen_at, max(created_at) AS last_seen_at
        FROM sp_events WHERE event_name = 'outbound_click' AND {_since(365)}
        GROUP BY utm_content ORDER BY count DESC, utm_content NULLS FIRST LIMIT 50""",
)
def utm_only_metrics(t):
    return ev.utm_only_metrics(t.sp_events, "outbound_click", AS_OF, limit=50)


@query(
    "event_total_count",
    f"SELECT count(*) AS count FROM sp_events WHERE event_name = 'attribution_set' AND {_since(30)}",
)
def event_total_count(t):
    return ev.event_total_count(t.sp_events, "attribution_set", AS_OF)


@query(
    "event_count_for_utm",
    f"""SELECT count(*) AS count FROM sp_events
        WHERE event_name = 'attribution_set' AND utm_content = '{POST}' AND {_since(30)}""",
)
def event_count_for_utm(t):
    return ev.event_count_for_utm(t.sp_events, "attribution_set", POST, AS_OF)


@query(
    "clicks_by_retailer_for_utm",
    f"""SELECT retailer, count(*) AS count, max(created_at) AS last_seen_at FROM sp_events
        WHERE event_name = 'outbound_click' AND utm_content = '{POST}' AND {_since(30)}
        GROUP BY retailer ORDER BY count DESC, retailer NULLS FIRST LIMIT 20""",
)
def clicks_by_retailer_for_utm(t):
    return ev.clicks_by_retailer_for_utm(t.sp_events, POST, AS_OF, limit=20)


@query(
    "recent_events_for_utm",
    f"""SELECT id, created_at, event_name, path, retailer, destination_url, utm_source, utm_medium, utm_campaign, utm_content
        FROM sp_events WHERE utm_content = '{POST}' AND {_since(30)} ORDER BY created_at DESC, id DESC LIMIT 200""",
)
def recent_events_for_utm(t):
    return ev.recent_events_for_utm(t.sp_events, POST, AS_OF)


@query(
    "utm_content_metrics",
    f"""SELECT utm_content, retailer, count(*) AS count, min(created_at) AS first_seen_at, max(created_at) AS last_seen_at
        FROM sp_events WHERE event_name = 'outbound_click' AND {_since(30)}
        GROUP BY utm_content, retailer
        ORDER BY count DESC, utm_content NULLS FIRST, retailer NULLS FIRST LIMIT 9999""",
)
def utm_content_metrics(t):
    return ev.utm_content_metrics(t.sp_events, "outbound_click", AS_OF, limit=9999)


@query(
    "retailer_metrics",
    f"""SELECT retailer, count(*) AS count, max(created_at) AS last_seen_at
        FROM sp_events WHERE event_name = 'folder_view' AND {_since(30)}
        GROUP BY retailer ORDER BY count DESC, retailer NULLS FIRST LIMIT 200""",
)
def retailer_metrics(t):
    return ev.retailer_metrics(t.sp_events, "folder_view", AS_OF)


DAILY_SQL = """SELECT strftime(created_at, '%Y-%m-%d') AS day, event_name, count(*) AS count
    FROM sp_events WHERE {filter} GROUP BY ALL"""


@query("daily_metrics", DAILY_SQL.format(filter=_since(14)))
def daily_metrics(t):
    return ev.daily_metrics(t.sp_events, AS_OF, days=14)


@query("event_timeseries", DAILY_SQL.format(filter=_since(60)))
def event_timeseries(t):
    return ev.event_timeseries(t.sp_events, AS_OF)


@query("engagement_daily", DAILY_SQL.format(filter=_since(30) + " AND event_name LIKE 'folder\\_%' ESCAPE '\\'"))
def engagement_daily(t):
    return ev.engagement_daily(t.sp_events, AS_OF)


@query(
    "events_for_export",
    f"""SELECT id, created_at, event_name, path, retailer, destination_url, utm_source, utm_medium, utm_campaign, utm_content
        FROM sp_events WHERE event_name = 'outbound_click' AND retailer = 's3' AND {_since(30)}
        ORDER BY created_at DESC, id DESC LIMIT 5000""",
)
def events_for_export(t):
    return ev.events_for_export(t.sp_events, AS_OF, event_name="outbound_click", retailer="s3")


@query(
    "recent_events",
    """SELECT id, created_at, event_name, path, retailer, destination_url, utm_source, utm_medium, utm_campaign, utm_content
       FROM sp_events ORDER BY created_at DESC, id DESC LIMIT 100""",
)
def recent_events(t):
    return ev.recent_events(t.sp_events)


@query(
    "post_funnel",
    f"""WITH a AS (SELECT utm_content, count(*) AS n FROM sp_events
          WHERE event_name = 'attribution_set' AND {_since(30)} AND utm_content <> '' GROUP BY 1),
        c AS (SELECT utm_content, count(*) AS n FROM sp_events
          WHERE event_name = 'outbound_click' AND {_since(30)} AND utm_content <> '' GROUP BY 1)
        SELECT coalesce(a.utm_content, c.utm_content) AS utm_content, coalesce(a.n, 0) AS attribution_set_total,
          coalesce(c.n, 0) AS outbound_click_total
        FROM a FULL OUTER JOIN c ON a.utm_content = c.utm_content""",
)
def post_funnel(t):
    return ev.post_funnel(t.sp_events, AS_OF)


@query(
    "post_detail",
    f"""SELECT '{POST}' AS utm_content,
          (SELECT count(*) FROM sp_events WHERE event_name = 'attribution_set' AND utm_content = '{POST}' AND {_since(30)}) AS attribution_total,
          (SELECT count(*) FROM sp_events WHERE event_name = 'outbound_click' AND utm_content = '{POST}' AND {_since(30)}) AS outbound_total""",
)
def post_detail(t):
    return ev.post_detail(t.sp_events, POST, AS_OF)


ENGAGEMENT_SQL = f"""SELECT retailer,
    count(*) FILTER (event_name = 'folder_view') AS folder_view,
    count(*) FILTER (event_name = 'folder_engaged_15s') AS folder_engaged_15s,
    count(*) FILTER (event_name = 'folder_scroll_50') AS folder_scroll_50,
    count(*) FILTER (event_name = 'folder_scroll_90') AS folder_scroll_90,
    count(*) FILTER (event_name = 'folder_page_turn') AS folder_page_turn
  FROM sp_events
  WHERE {_since(30)} AND retailer <> '' AND event_name IN
    ('folder_view', 'folder_engaged_15s', 'folder_scroll_50', 'folder_scroll_90', 'folder_page_turn')
  GROUP BY retailer"""


@query("engagement_by_retailer", ENGAGEMENT_SQL)
def engagement_by_retailer(t):
    return ev.engagement_by_retailer(t.sp_events, AS_OF)


@query(
    "engagement_rates",
    f"""WITH e AS ({ENGAGEMENT_SQL})
        SELECT retailer, folder_view,
          CASE WHEN folder_view > 0 THEN folder_engaged_15s * 100.0::DOUBLE / folder_view END AS engaged_pct,
          CASE WHEN folder_view > 0 THEN folder_scroll_90 * 100.0::DOUBLE / folder_view END AS scroll90_pct,
          CASE WHEN folder_view > 0 THEN folder_page_turn * 1.0::DOUBLE / folder_view END AS turns_per_view
        FROM e""",
)
def engagement_rates(t):
    return ev.engagement_rates(ev.engagement_by_retailer(t.sp_events, AS_OF))


@query(
    "retailer_clicks_ranking",
    f"""SELECT retailer, count(*) AS outbound_click FROM sp_events
        WHERE event_name = 'outbound_click' AND retailer <> '' AND {_since(30)} GROUP BY retailer""",
)
def retailer_clicks_ranking(t):
    return ev.retailer_clicks_ranking(t.sp_events, AS_OF)


@query(
    "campaign_post_kpis",
    f"""SELECT utm_content, count(*) FILTER (event_name = 'outbound_click') AS outbound_click_total,
          CASE WHEN count(*) FILTER (event_name = 'attribution_set') > 0 THEN
            count(*) FILTER (event_name = 'outbound_click')::DOUBLE / count(*) FILTER (event_name = 'attribution_set') END AS click_ratio
        FROM sp_events WHERE event_name IN ('outbound_click', 'attribution_set') AND utm_content <> '' AND {_since(30)}
        GROUP BY utm_content""",
)
def campaign_post_kpis(t):
    return ev.campaign_post_kpis(t.sp_events, AS_OF)


@query(
    "campaign_retailer_kpis",
    f"""WITH e AS ({ENGAGEMENT_SQL})
        SELECT retailer, CASE WHEN folder_view > 0 THEN folder_engaged_15s::DOUBLE / folder_view END AS engaged_share,
          CASE WHEN folder_view > 0 THEN folder_scroll_90::DOUBLE / folder_view END AS scroll90_share FROM e""",
)
def campaign_retailer_kpis(t):
    return ev.campaign_retailer_kpis(t.sp_events, AS_OF)


@query(
    "campaign_go_no_go",
    f"""WITH p AS (SELECT utm_campaign, utm_content, count(*) FILTER (event_name = 'outbound_click') AS clicks
          FROM sp_events WHERE event_name IN ('outbound_click', 'attribution_set') AND utm_content <> ''
            AND utm_campaign IN ('nl_border', 'be') AND {_since(14)} GROUP BY ALL),
        m AS (SELECT median(clicks) AS mid FROM p WHERE utm_campaign = 'be')
        SELECT utm_content, clicks, mid AS baseline_median, clicks >= mid AS go
        FROM p, m WHERE utm_campaign = 'nl_border'""",
)
def campaign_go_no_go(t):
    return ev.campaign_go_no_go(t.sp_events, AS_OF, "nl_border", "be", days=14)


# Traffic per retailer: views are visits, all engagement events are page views.
TRAFFIC_SQL = """SELECT retailer, count(*) FILTER (event_name = 'folder_view') AS visits, count(*) AS pageviews
  FROM sp_events WHERE retailer <> '' GROUP BY retailer"""
SCENARIO_SQL = """(VALUES ('conservative', 2.0::DOUBLE, 0.03::DOUBLE, 0.05::DOUBLE), ('base', 3.0::DOUBLE, 0.07::DOUBLE, 0.12::DOUBLE),
  ('optimistic', 5.0::DOUBLE, 0.12::DOUBLE, 0.25::DOUBLE)) s(scenario, rpm, ctr, epc)"""


def _traffic(t):
    return (
        t.sp_events.filter(F.col("retailer") != "")
        .groupBy("retailer")
        .agg(F.count_if(F.col("event_name") == "folder_view").alias("visits"), F.count(F.lit(1)).alias("pageviews"))
    )


@query(
    "ad_revenue",
    f"""WITH t AS ({TRAFFIC_SQL}) SELECT retailer, scenario, pageviews / 1000.0::DOUBLE * rpm AS ads FROM t, {SCENARIO_SQL}""",
)
def ad_revenue(t):
    rows = rv.with_scenarios(_traffic(t))
    return rows.select("retailer", "scenario", rv.ad_revenue(F.col("pageviews"), F.col("rpm")).alias("ads"))


@query(
    "affiliate_revenue_epc",
    f"""WITH t AS ({TRAFFIC_SQL}) SELECT retailer, scenario, visits * ctr * epc AS affiliate FROM t, {SCENARIO_SQL}""",
)
def affiliate_revenue_epc(t):
    rows = rv.with_scenarios(_traffic(t))
    income = rv.affiliate_revenue_epc(F.col("visits"), F.col("ctr"), F.col("epc"))
    return rows.select("retailer", "scenario", income.alias("affiliate"))


@query(
    "affiliate_revenue_conversion",
    f"""WITH t AS ({TRAFFIC_SQL}) SELECT retailer, scenario, visits * ctr * 0.02::DOUBLE * 4.5::DOUBLE AS affiliate FROM t, {SCENARIO_SQL}""",
)
def affiliate_revenue_conversion(t):
    rows = rv.with_scenarios(_traffic(t))
    income = rv.affiliate_revenue_conversion(F.col("visits"), F.col("ctr"), F.lit(0.02), F.lit(4.5))
    return rows.select("retailer", "scenario", income.alias("affiliate"))


@query(
    "combined_revenue",
    f"""WITH t AS ({TRAFFIC_SQL}) SELECT retailer, visits, pageviews, scenario, pageviews / 1000.0::DOUBLE * rpm AS ads,
          visits * ctr * epc AS affiliate, pageviews / 1000.0::DOUBLE * rpm + visits * ctr * epc AS total
        FROM t, {SCENARIO_SQL}""",
)
def combined_revenue(t):
    return rv.combined_revenue(_traffic(t))


@query(
    "revenue_sensitivity",
    f"""WITH t AS ({TRAFFIC_SQL}) SELECT retailer, visits, pageviews, scenario, input, step,
          CASE input WHEN 'rpm' THEN pageviews / 1000.0::DOUBLE * step WHEN 'pages_per_visit' THEN visits * step / 1000.0::DOUBLE * rpm
            WHEN 'ctr' THEN visits * step * epc ELSE visits * ctr * step END AS change
        FROM t, {SCENARIO_SQL}, (VALUES ('rpm', 1.0::DOUBLE), ('pages_per_visit', 1.0::DOUBLE), ('ctr', 0.03::DOUBLE), ('epc', 0.05::DOUBLE)) g(input, step)""",
)
def revenue_sensitivity(t):
    return rv.revenue_sensitivity(_traffic(t))
