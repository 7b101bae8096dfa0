"""Event ingestion from the test hits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ingest as ing
from .registry import query

# Hits with what the rules read from them, in SQL.
HITS_SQL = """cookies AS (SELECT *, [trim(c) FOR c IN string_split(cookie, ';')] AS crumbs FROM raw_hits),
  hits AS (SELECT *, coalesce(string_split([c FOR c IN crumbs IF starts_with(c, 'sp_cookie_consent=')][1], '=')[2] = 'accepted', false) AS consent,
      nullif(string_split([c FOR c IN crumbs IF starts_with(c, 'sp_attrib=')][1], '=')[2], '') AS attrib FROM cookies),
  decoded AS (SELECT *, CASE WHEN NOT regexp_matches(attrib, '%($|[^0-9A-Fa-f]|[0-9A-Fa-f]($|[^0-9A-Fa-f]))') THEN try_cast(url_decode(attrib) AS JSON) END AS attribution FROM hits),
  told AS (SELECT *, CASE WHEN json_type(attribution, '$.utm_source') = 'VARCHAR' THEN nullif(attribution ->> '$.utm_source', '') END AS c_source,
      CASE WHEN json_type(attribution, '$.utm_medium') = 'VARCHAR' THEN nullif(attribution ->> '$.utm_medium', '') END AS c_medium,
      CASE WHEN json_type(attribution, '$.utm_campaign') = 'VARCHAR' THEN nullif(attribution ->> '$.utm_campaign', '') END AS c_campaign,
      CASE WHEN json_type(attribution, '$.utm_content') = 'VARCHAR' THEN nullif(attribution ->> '$.utm_content', '') END AS c_content FROM decoded)"""


def _param(key: str) -> str:
    return f"nullif(url_decode(replace(regexp_extract(url, '[?&]{key}=([^&]*)', 1), '+', ' ')), '')"


@query("consent_gate", f"WITH {HITS_SQL} SELECT hit_id, cookie FROM hits WHERE consent")
def consent_gate(t):
    return ing.consent_gate(t.raw_hits).select("hit_id", "cookie")


@query(
    "parse_attribution_cookie",
    f"""WITH {HITS_SQL} SELECT hit_id, c_source AS utm_source, c_medium AS utm_medium, c_campaign AS utm_campaign, c_content AS utm_content FROM told""",
)
def parse_attribution_cookie(t):
    utm = ing.parse_attribution_cookie(ing.cookie_value(F.col("cookie"), ing.ATTRIBUTION_COOKIE))
    return t.raw_hits.select("hit_id", utm.alias("u")).select("hit_id", "u.*")


@query(
    "utm_from_url",
    f"SELECT hit_id, {', '.join(f'{_param(k)} AS {k}' for k in ing.UTM_URL_KEYS)} FROM raw_hits",
)
def utm_from_url(t):
    return t.raw_hits.select("hit_id", ing.utm_from_url(F.col("url")).alias("u")).select("hit_id", "u.*")


# The encoded payload of one parameter: quotes, colon and braces take three characters each.
ATTRIBUTION_SQL = f"""{HITS_SQL},
  landed AS (SELECT *, {', '.join(f'{_param(k)} AS {k}' for k in ing.UTM_URL_KEYS)} FROM told WHERE kind = 'attribution' AND consent),
  sized AS (SELECT *, '{{' || concat_ws(',', {', '.join(f"'\"{k}\":\"' || {k} || '\"'" for k in ing.UTM_URL_KEYS)}, '"first_seen_ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.') || '000Z"') || '}}' AS payload FROM landed),
  attribution AS (SELECT ts AS created_at, 'attribution_set' AS event_name, regexp_extract(url, '^https://[^/]*([^?]*)', 1) AS path, NULL::VARCHAR AS retailer, NULL::VARCHAR AS destination_url,
      utm_source, utm_medium, utm_campaign, utm_content, user_agent, referrer
    FROM sized WHERE coalesce(utm_source, utm_medium, utm_campaign, utm_content, utm_term) IS NOT NULL)"""


@query("attribution_events", f"WITH {ATTRIBUTION_SQL} SELECT * FROM attribution")
def attribution_events(t):
    return ing.attribution_events(t.raw_hits)


ENGAGEMENT_SQL = """bodies AS (SELECT *, try_cast(body AS JSON) AS doc FROM told WHERE kind = 'engagement' AND consent),
  engagement AS (SELECT ts AS created_at, doc ->> '$.event' AS event_name, CASE WHEN starts_with(doc ->> '$.path', '/folders/') THEN doc ->> '$.path' END AS path,
      doc ->> '$.retailer' AS retailer, NULL::VARCHAR AS destination_url, c_source AS utm_source, c_medium AS utm_medium, c_campaign AS utm_campaign, c_content AS utm_content, user_agent, referrer
    FROM bodies WHERE doc ->> '$.event' IN ('folder_view', 'folder_engaged_15s', 'folder_scroll_50', 'folder_scroll_90', 'folder_page_turn')
      AND json_type(doc, '$.retailer') = 'VARCHAR' AND (doc ->> '$.retailer') IN (SELECT slug FROM retailers))"""


@query("engagement_events", f"WITH {HITS_SQL}, {ENGAGEMENT_SQL} SELECT * FROM engagement")
def engagement_events(t):
    return ing.engagement_events(t.raw_hits, t.retailers)


LINK_SQL = """links AS (SELECT r.slug, r.website, coalesce(nullif(a.override_url, ''), a.base_url, '#') AS affiliate_url FROM retailers r LEFT JOIN affiliates a USING (slug))"""

OUTBOUND_SQL = f"""{LINK_SQL},
  goals AS (SELECT slug, CASE WHEN affiliate_url = '#' THEN website ELSE affiliate_url END AS goal FROM links),
  outbound AS (SELECT ts AS created_at, 'outbound_click' AS event_name, regexp_extract(url, '^https://[^/]*([^?]*)', 1) AS path, target AS retailer,
      goal || CASE WHEN regexp_full_match(goal, 'https?://[^/?#]*') THEN '/' ELSE '' END AS destination_url,
      c_source AS utm_source, c_medium AS utm_medium, c_campaign AS utm_campaign, c_content AS utm_content, user_agent, referrer
    FROM told JOIN goals ON goals.slug = target WHERE kind = 'outbound' AND consent AND regexp_matches(goal, '^https?:'))"""


@query("outbound_events", f"WITH {HITS_SQL}, {OUTBOUND_SQL} SELECT * FROM outbound")
def outbound_events(t):
    return ing.outbound_events(t.raw_hits, t.retailers, t.affiliates)


@query(
    "all_events",
    f"""WITH {ATTRIBUTION_SQL}, {ENGAGEMENT_SQL}, {OUTBOUND_SQL}
        SELECT * FROM attribution UNION ALL SELECT * FROM engagement UNION ALL SELECT * FROM outbound""",
)
def all_events(t):
    return ing.all_events(t.raw_hits, t.retailers, t.affiliates)


@query("affiliate_url", f"WITH {LINK_SQL} SELECT slug, affiliate_url FROM links")
def affiliate_url(t):
    return ing.affiliate_url(t.retailers.select("slug"), t.affiliates)


@query(
    "wrap_affiliate_link",
    """SELECT r.slug, url, CASE WHEN a.network <> 'none' AND tracking_id IS NOT NULL THEN url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'ref=' || tracking_id ELSE url END AS wrapped_url
       FROM (SELECT 's' || l_suppkey AS slug, 'https://shop.example.com/' || l_partkey || CASE WHEN l_linenumber > 3 THEN '?q=1' ELSE '' END AS url FROM lineitem) r LEFT JOIN affiliates a USING (slug)""",
)
def wrap_affiliate_link(t):
    links = t.lineitem.select(
        F.expr("'s' || l_suppkey AS slug"),
        F.expr("'https://shop.example.com/' || l_partkey || CASE WHEN l_linenumber > 3 THEN '?q=1' ELSE '' END AS url"),
    )
    return ing.wrap_affiliate_link(links, t.affiliates)


@query(
    "dedupe_view_hits",
    """SELECT view_id, event_key, ts, hit_id FROM (SELECT user_id AS view_id, event_type AS event_key, ts, event_id AS hit_id FROM events)
       QUALIFY row_number() OVER (PARTITION BY view_id, event_key ORDER BY ts, hit_id) = 1""",
)
def dedupe_view_hits(t):
    hits = t.events.select(
        F.col("user_id").alias("view_id"), F.col("event_type").alias("event_key"), "ts", F.col("event_id").alias("hit_id")
    )
    return ing.dedupe_view_hits(hits)


KEY_EVENTS = "CASE event_id % 3 WHEN 0 THEN 'folder_page_turn' WHEN 1 THEN 'deal_click' ELSE event_type END"


@query(
    "view_key",
    f"""SELECT view_id, event_key, count(*) AS hits FROM (SELECT user_id AS view_id, CASE {KEY_EVENTS} WHEN 'folder_page_turn' THEN 'folder_page_turn:' || CAST(event_id % 5 AS VARCHAR)
          WHEN 'deal_click' THEN 'deal_click:d' || CAST(event_id % 4 AS VARCHAR) || ':' || CASE WHEN value > 50 THEN 'https://x' ELSE '' END ELSE event_type END AS event_key FROM events) GROUP BY ALL""",
)
def view_key(t):
    key = ing.view_key(
        F.expr(KEY_EVENTS), F.col("event_id") % 5, F.concat(F.lit("d"), (F.col("event_id") % 4).cast("string")),
        F.when(F.col("value") > 50, "https://x"),
    )
    rows = t.events.select(F.col("user_id").alias("view_id"), key.alias("event_key"))
    return rows.groupBy("view_id", "event_key").agg(F.count(F.lit(1)).alias("hits"))


SAMPLES = "CAST(user_id * 100 + day(ts) AS BIGINT) AS view_id, ts, value * 10 AS y, CASE WHEN user_id % 7 = 0 THEN 600.0 ELSE 1500.0 END AS height, 600.0 AS viewport"


@query(
    "scroll_milestones",
    f"""WITH s AS (SELECT {SAMPLES} FROM events),
        p AS (SELECT *, CASE WHEN height > viewport THEN y / (height - viewport) * 100 END AS pct FROM s),
        v AS (SELECT view_id, min(ts) AS b, max(ts) AS e, min(ts) FILTER (pct >= 50) AS h, min(ts) FILTER (pct >= 90) AS m FROM p GROUP BY view_id)
        SELECT view_id, 'folder_view' AS event_name, b AS created_at FROM v
        UNION ALL SELECT view_id, 'folder_engaged_15s', b + INTERVAL 15 SECOND FROM v WHERE e >= b + INTERVAL 15 SECOND
        UNION ALL SELECT view_id, 'folder_scroll_50', h FROM v WHERE h IS NOT NULL UNION ALL SELECT view_id, 'folder_scroll_90', m FROM v WHERE m IS NOT NULL""",
)
def scroll_milestones(t):
    samples = t.events.selectExpr(
        "CAST(user_id * 100 + day(ts) AS BIGINT) AS view_id", "ts", "value * 10 AS y",
        "CASE WHEN user_id % 7 = 0 THEN 600.0D ELSE 1500.0D END AS height", "600.0D AS viewport",
    )
    return ing.scroll_milestones(samples)
