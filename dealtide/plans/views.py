"""Views that present the test tables as events, deals, leaflets and captures.

One text per view, in SQL that Spark and DuckDB read alike. ``load`` gives the Spark side; ``with_views``
prefixes a DuckDB query with the views it names.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..functions.skew import spread

AS_OF = "2024-01-31 00:00:00"

BASE_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]

VIEWS: dict[str, str] = {}

VIEWS["sp_events"] = """
SELECT event_id AS id, ts AS created_at,
  CASE event_type WHEN 'view' THEN 'folder_view' WHEN 'click' THEN 'outbound_click'
    WHEN 'signup' THEN 'attribution_set' WHEN 'purchase' THEN 'folder_engaged_15s'
    ELSE CASE event_id % 4 WHEN 0 THEN 'folder_scroll_50' WHEN 1 THEN 'folder_scroll_90'
      WHEN 2 THEN 'folder_page_turn' ELSE 'deal_click' END END AS event_name,
  '/folders/s' || CAST(user_id % 30 AS STRING) AS path,
  CASE WHEN event_type = 'signup' THEN CAST(NULL AS STRING) WHEN event_id % 97 = 0 THEN '' ELSE 's' || CAST(user_id % 30 AS STRING) END AS retailer,
  CASE WHEN event_type = 'click' THEN 'https://shop' || CAST(user_id % 30 AS STRING) || '.example.com/a,b' ELSE CAST(NULL AS STRING) END AS destination_url,
  CASE WHEN event_id % 5 = 0 THEN CAST(NULL AS STRING) ELSE 'social' END AS utm_source,
  CASE WHEN event_id % 5 = 0 THEN CAST(NULL AS STRING) ELSE 'group_post' END AS utm_medium,
  CASE WHEN event_id % 5 = 0 THEN CAST(NULL AS STRING) WHEN user_id % 4 = 0 THEN 'nl_border' ELSE 'be' END AS utm_campaign,
  CASE WHEN event_id % 5 = 0 THEN CAST(NULL AS STRING) ELSE 'post-' || regexp_extract(props, '([0-9]+)', 1) END AS utm_content,
  CAST(NULL AS STRING) AS user_agent, CAST(NULL AS STRING) AS referrer
FROM events
"""

# Raw requests: every kind of hit, with consent, cookies and bodies in many shapes.
VIEWS["raw_hits"] = """
SELECT event_id AS hit_id, ts,
  CASE event_type WHEN 'signup' THEN 'attribution' WHEN 'click' THEN 'outbound' ELSE 'engagement' END AS kind,
  'https://site.example.com/folders/s' || CAST(user_id % 30 AS STRING) || CASE event_id % 6
    WHEN 0 THEN '?utm_source=face+book&utm_content=post-' || CAST(user_id % 50 AS STRING) WHEN 1 THEN '?utm_campaign=nl%20border&utm_medium=&x=1'
    WHEN 2 THEN '?utm_term=only' WHEN 3 THEN '?utm_content=' || repeat('%C3%A9', CAST(user_id % 400 AS INT)) WHEN 4 THEN '?utm_source=&utm_medium=' ELSE '' END AS url,
  CASE event_id % 7 WHEN 0 THEN CAST(NULL AS STRING) WHEN 1 THEN 'sp_cookie_consent=rejected' WHEN 2 THEN 'a=b; sp_cookie_consent=accepted=x'
    WHEN 3 THEN 'xsp_cookie_consent=accepted' ELSE 'lang=nl;  sp_cookie_consent=accepted' END
  || CASE event_id % 8 WHEN 0 THEN '; sp_attrib=%7B%22utm_source%22%3A%22social%22%2C%22utm_content%22%3A%22post%2B' || CAST(user_id % 50 AS STRING) || '%22%7D'
    WHEN 1 THEN '; sp_attrib=%7B%22utm_source%22%3A7%2C%22utm_campaign%22%3A%22a+b%22%7D' WHEN 2 THEN '; sp_attrib=%7B%22utm_source%22%3A%22%22%7D'
    WHEN 3 THEN '; sp_attrib=%E0%A4%A' WHEN 4 THEN '; sp_attrib=notjson' ELSE '' END AS cookie,
  CASE WHEN event_type IN ('signup', 'click') THEN CAST(NULL AS STRING) WHEN event_id % 13 = 0 THEN '{bad' ELSE
  '{"event":"' || CASE event_id % 5 WHEN 0 THEN 'folder_view' WHEN 1 THEN 'folder_engaged_15s' WHEN 2 THEN 'folder_scroll_50' WHEN 3 THEN 'deal_click' ELSE 'folder_page_turn' END
  || '","retailer":' || CASE WHEN event_id % 11 = 0 THEN '5' ELSE '"s' || CAST(user_id % 130 AS STRING) || '"' END
  || ',"path":"' || CASE WHEN event_id % 3 = 0 THEN '/other' ELSE '/folders/s' || CAST(user_id % 130 AS STRING) END || '"}' END AS body,
  's' || CAST(user_id % 130 AS STRING) AS target,
  'agent ' || CAST(user_id % 3 AS STRING) AS user_agent, CAST(NULL AS STRING) AS referrer
FROM events
"""

VIEWS["retailers"] = """
SELECT 's' || CAST(s_suppkey AS STRING) AS slug, s_name AS name,
  CASE s_nationkey % 4 WHEN 0 THEN 'supermarkt' WHEN 1 THEN 'discounter' WHEN 2 THEN 'drogist' ELSE 'electronica' END AS category,
  CASE WHEN s_suppkey % 23 = 5 THEN 'ftp://shop' ELSE 'https://shop' END || CAST(s_suppkey AS STRING) || '.example.com' AS website,
  split(CASE s_nationkey % 3 WHEN 0 THEN 'general,pet,electro,fashion,home-garden,beauty,diy' WHEN 1 THEN 'beauty' ELSE 'electro' END, ',') AS verticals
FROM supplier
"""

VIEWS["affiliates"] = """
SELECT 's' || CAST(s_suppkey AS STRING) AS slug, CASE s_nationkey % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'awin' ELSE 'direct' END AS network,
  'https://aff' || CAST(s_suppkey AS STRING) || '.example.com/go' || CASE WHEN s_nationkey % 2 = 0 THEN '?p=1' ELSE '' END AS base_url,
  CASE WHEN s_suppkey % 4 = 0 THEN CAST(NULL AS STRING) ELSE 'trk' || CAST(s_nationkey AS STRING) END AS tracking_id,
  CASE s_suppkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'https://override.example.com/' || CAST(s_suppkey AS STRING) ELSE CAST(NULL AS STRING) END AS override_url
FROM supplier WHERE s_nationkey <> 7
"""

VIEWS["stores"] = """
SELECT 'st' || CAST(c_custkey AS STRING) AS id, 's' || CAST(c_custkey % 40 AS STRING) AS retailer_slug, c_name AS name,
  CAST(49 AS DOUBLE) + CAST(c_custkey * 37 % 250 AS DOUBLE) / CAST(100 AS DOUBLE) AS lat,
  CAST(2 AS DOUBLE) + CAST(c_custkey * 61 % 400 AS DOUBLE) / CAST(100 AS DOUBLE) AS lng
FROM customer WHERE c_custkey % 5 = 0
"""

VIEWS["user_locations"] = """
SELECT c_custkey AS user_id,
  CAST(49 AS DOUBLE) + CAST(c_custkey * 53 % 250 AS DOUBLE) / CAST(100 AS DOUBLE) + CAST(0.003 AS DOUBLE) AS lat,
  CAST(2 AS DOUBLE) + CAST(c_custkey * 29 % 400 AS DOUBLE) / CAST(100 AS DOUBLE) + CAST(0.007 AS DOUBLE) AS lng
FROM customer WHERE c_custkey % 5 = 1
"""

# Which retailers each located user asks about: those whose articles the user has ordered.
VIEWS["store_requests"] = """
SELECT DISTINCT u.user_id, u.lat, u.lng, 's' || CAST(l_suppkey AS STRING) AS retailer_slug
FROM user_locations u JOIN orders ON o_custkey = u.user_id JOIN lineitem ON l_orderkey = o_orderkey
"""

VIEWS["raw_deals"] = """
SELECT 's' || CAST(l_suppkey AS STRING) AS retailer_slug, p_name || ' ' || p_brand AS product,
  CASE WHEN l_linenumber = 7 THEN CAST(NULL AS DOUBLE) ELSE floor(l_extendedprice / l_quantity) END AS original_price,
  CASE WHEN l_linenumber >= 6 THEN CAST(NULL AS DOUBLE) ELSE floor(l_extendedprice / l_quantity * (CAST(1 AS DOUBLE) - l_discount)) END AS promo_price,
  CASE l_linenumber WHEN 1 THEN '-' || CAST(CAST(round(l_discount * 100) AS INT) AS STRING) || '%' WHEN 2 THEN '2+1 gratis'
    WHEN 3 THEN '2 voor €5' WHEN 4 THEN '€ 5 korting' WHEN 5 THEN 'Cashback' WHEN 6 THEN 'Gratis cadeau' ELSE CAST(NULL AS STRING) END AS discount,
  CASE WHEN l_partkey % 3 = 0 THEN CAST(NULL AS STRING) ELSE p_type || ' size ' || CAST(p_size AS STRING) END AS description,
  CASE WHEN l_partkey % 7 = 0 THEN CAST(NULL AS STRING) ELSE p_type END AS category,
  CASE l_suppkey % 3 WHEN 0 THEN 'general' WHEN 1 THEN 'beauty' ELSE 'electro' END AS vertical,
  CAST(l_shipdate AS DATE) AS valid_from, CAST(l_shipdate + INTERVAL 6 DAY AS DATE) AS valid_until,
  l_shipdate + INTERVAL 10 HOUR AS scraped_at,
  l_orderkey * 10 + l_linenumber AS seq
FROM lineitem JOIN part ON l_partkey = p_partkey
"""

VIEWS["scrape_runs"] = """
SELECT o_orderkey AS id, 'run-' || CAST(o_orderkey % 100 AS STRING) AS run_id, 's' || CAST(o_custkey % 50 AS STRING) AS retailer_slug,
  CASE o_orderstatus WHEN 'F' THEN 'scrape_success' WHEN 'O' THEN 'no_change' ELSE 'error' END AS status,
  CASE WHEN o_orderkey % 9 = 0 THEN CAST(NULL AS STRING) ELSE 'v' || CAST(o_orderkey % 6 AS STRING) END AS fingerprint_raw,
  CASE WHEN o_orderstatus = 'F' AND o_orderkey % 11 <> 0 THEN '{"n":' || CAST(o_orderkey AS STRING) || '}' ELSE CAST(NULL AS STRING) END AS scraped_data,
  o_orderdate AS started_at, o_orderdate + INTERVAL 30 MINUTE AS finished_at,
  CAST(o_orderkey % 4 + 1 AS INT) AS attempts
FROM orders
"""

VIEWS["folder_docs"] = """
SELECT 's' || CAST(s_suppkey AS STRING) AS slug,
  CASE WHEN s_suppkey % 17 = 3 THEN '{broken' WHEN s_suppkey % 17 = 4 THEN '{"folders":"x"}' WHEN s_suppkey % 17 = 5 THEN '{"folders":[],"deals":[]}' ELSE
  '{"retailer":"s' || CAST(s_suppkey AS STRING) || '","scrapedAt":"2024-01-' || CAST(10 + s_suppkey % 20 AS STRING) || 'T10:00:00.000Z","deals":[{"id":"d1"}],"methods":["publitas"],"folders":['
  || '{"id":"a","title":"' || CASE WHEN s_suppkey % 6 = 0 THEN '' ELSE 'F' END || '","validFrom":"2024-01-15","validUntil":"2024-01-21","pageCount":2,"pages":[{"pageNumber":1},{"pageNumber":2}],"embedUrl":"https://view.publitas.com/x/' || CAST(s_suppkey AS STRING) || '","contentSource":"publitas"},'
  || '{"id":"b","title":"G","validFrom":"2024-01-29","validUntil":"' || CASE WHEN s_suppkey % 5 = 0 THEN '04-02-2024' ELSE '2024-02-04' END || '","pageCount":1,"pages":[],"pdfUrl":"' || CASE WHEN s_suppkey % 4 = 0 THEN 'ftp:x' ELSE 'https://cdn.example.com/x.pdf' END || '","contentSource":"pdf"}]}' END AS raw
FROM supplier
"""

VIEWS["deal_text"] = """
SELECT l_orderkey * 10 + l_linenumber AS doc_id, 's' || CAST(l_suppkey AS STRING) AS retailer_slug,
  p_name || chr(10) || '€ ' || CAST(CAST(floor(l_extendedprice / l_quantity) AS INT) AS STRING) || ',99 €' || CAST(p_size AS STRING) || '.50' || chr(10)
  || '-' || CAST(CAST(round(l_discount * 100) AS INT) AS STRING) || '%' || chr(10) || 'vanaf ' || p_type || ' € 3,25' || chr(10) || 'xx' || chr(10) || p_brand || ' 12,50 9,75' || chr(10) || 'koop 2 betaal 1' AS text
FROM lineitem JOIN part ON l_partkey = p_partkey
"""

# One leaflet per order, one page per order line; a page holds one line of text.
VIEWS["leaflet_pages"] = """
SELECT l_orderkey AS doc_id, 's' || CAST(o_custkey % 50 AS STRING) AS retailer_slug,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INT) AS page_no,
  p_name || CASE l_linenumber % 3 WHEN 0 THEN ' nu € ' || CAST(p_size AS STRING) || ',49' WHEN 1 THEN ' € ' || CAST(p_size AS STRING) || '.99 van € 99,00 -20 %' ELSE ' zonder prijs' END AS text
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
"""

VIEWS["ld_pages"] = """
SELECT p_partkey AS page_id, 's' || CAST(p_partkey % 30 AS STRING) AS retailer_slug,
  '<html><script type="application/ld+json">' || CASE p_partkey % 4
    WHEN 0 THEN '{"@type":"Product","name":"' || p_name || '","offers":{"price":"' || CAST(p_size AS STRING) || '.5","highPrice":"99"}}'
    WHEN 1 THEN '[{"@type":"Offer","price":3}]'
    WHEN 2 THEN '{"@type":"ItemList","itemListElement":[{"item":{"name":"' || p_name || '","offers":{"price":2}}},{"name":"' || p_brand || '","price":1}]}'
    ELSE '{bad json' END || '</script><p>' || p_type || '</p></html>' AS html
FROM part
"""

# Product overviews: three cards per page, one without a name, one with a lazily loaded image.
VIEWS["card_pages"] = """
SELECT p_partkey AS page_id, 's' || CAST(p_partkey % 30 AS STRING) AS retailer_slug,
  '<html><body><nav class="product-nav">€ 1,00</nav><div class="grid"><div class="product-card big"><h3> ' || p_name || ' </h3><del>€ ' || CAST(p_size AS STRING) || ',90</del>'
  || '<span class="price-now">€ ' || CAST(p_size AS STRING) || ',50</span><span class="badge">-' || CAST(p_size AS STRING) || '%</span><img src="/i/product/' || CAST(p_partkey AS STRING) || '.png"></div>'
  || '<article class="tile"><h4>' || p_brand || '<br>&amp; co</h4><s>1.299,00</s><p class="desc">' || p_type || '</p><img class="product" data-src="/lazy.png"/></article>'
  || '<div class="product-card"><h3>  </h3><del>€ 5,00</del></div></div></body></html>' AS html
FROM part
"""

# Text of product cards, as an array per page.
VIEWS["card_texts"] = """
SELECT p_partkey AS page_id, 's' || CAST(p_partkey % 60 AS STRING) AS retailer_slug,
  split(p_name || chr(10) || '€ ' || CAST(p_size AS STRING) || ',99' || chr(10) || 'nu € 2,50 -10%'
  || '@' || 'Menu' || chr(10) || p_brand || ' extra € 0,00' || chr(10) || 'gratis'
  || '@' || UPPER(p_name) || ' € 7.25' || chr(10) || 'again'
  || '@' || 'kort € 1,00' || '@' || '€ 60000,00 € 4,00 ' || p_type || ' set 1+1', '@') AS cards
FROM part
"""

VIEWS["responses"] = """
SELECT page_id, CASE page_id % 9 WHEN 0 THEN 'https://view.publitas.com/g' || CAST(page_id % 5 AS STRING) || '/p1/page/3?x=1' WHEN 1 THEN 'https://view.publitas.com/branding/a/b'
    WHEN 2 THEN 'https://b.ipaper.io/iPaper/Papers/q/Pages/1/Zoom.jpg' WHEN 3 THEN 'https://www.yumpu.com/e/1' WHEN 4 THEN 'https://issuu.com/stacks/a.html'
    WHEN 5 THEN 'https://cdn.example.com/f.pdf?v=1' WHEN 6 THEN 'https://api.example.com/promo' WHEN 7 THEN 'https://login.example.com/i.png' ELSE url END AS url,
  CASE page_id % 9 WHEN 6 THEN 'application/json; charset=utf-8' WHEN 7 THEN 'image/png' WHEN 5 THEN 'application/pdf' ELSE 'text/html' END AS content_type,
  CASE page_id % 6 WHEN 0 THEN CAST(NULL AS INT) WHEN 1 THEN 404 WHEN 2 THEN 301 WHEN 3 THEN 503 ELSE 200 END AS status,
  CASE page_id % 7 WHEN 0 THEN 'DENY' WHEN 1 THEN 'SAMEORIGIN' ELSE CAST(NULL AS STRING) END AS x_frame_options,
  CASE page_id % 8 WHEN 0 THEN 'default-src x; frame-ancestors ''self''; img-src *' WHEN 1 THEN 'frame-ancestors *' WHEN 2 THEN 'frame-ancestors https://a.example.com' ELSE CAST(NULL AS STRING) END AS csp,
  's' || CAST(page_id % 20 AS STRING) AS retailer_slug
FROM pages
"""

# A log of many probes per leaflet URL; the latest one counts.
VIEWS["probe_log"] = """
SELECT 's' || CAST(l_suppkey AS STRING) AS slug,
  CASE l_linenumber % 2 WHEN 0 THEN 'https://view.publitas.com/x/' || CAST(l_suppkey AS STRING) ELSE 'https://cdn.example.com/x.pdf' END AS url,
  CASE l_partkey % 4 WHEN 0 THEN 404 WHEN 1 THEN CAST(NULL AS INT) WHEN 2 THEN 200 ELSE 503 END AS status,
  l_orderkey * 10 + l_linenumber AS seq, l_shipdate AS probed_at
FROM lineitem
"""

# Scrape runs as a log of attempts, numbered within run and retailer.
VIEWS["attempt_log"] = """
SELECT run_id, retailer_slug AS slug, CAST(row_number() OVER (PARTITION BY run_id, retailer_slug ORDER BY started_at, id) AS INT) AS attempt,
  status = 'scrape_success' AS ok, CASE WHEN status <> 'scrape_success' THEN 'failed ' || CAST(id AS STRING) END AS error
FROM scrape_runs
"""

VIEWS["crawl_configs"] = """
SELECT 's' || CAST(s_suppkey AS STRING) AS slug, s_name AS name,
  split(CASE s_suppkey % 4 WHEN 0 THEN 'https://a.example.com/1,https://a.example.com/1' WHEN 1 THEN 'ftp://a.example.com' WHEN 2 THEN 'https://a.example.com/1,https://a.example.com/2' ELSE 'folder,https://b.example.com' END, ',') AS folder_urls,
  split(CASE s_nationkey % 3 WHEN 0 THEN 'https://a.example.com/d' WHEN 1 THEN '/deals' ELSE 'https://a.example.com/d,https://a.example.com/d' END, ',') AS deal_urls,
  CASE WHEN s_nationkey % 2 = 0 THEN split('#accept,.ok', ',') END AS cookie_selectors,
  CASE WHEN s_suppkey % 3 = 0 THEN '.card' END AS card_selector, CASE WHEN s_suppkey % 6 = 0 THEN 'h3' END AS name_selector
FROM supplier WHERE s_nationkey <> 7
"""


def _needs(text: str) -> list[str]:
    names = set(re.findall(r"\b(?:FROM|JOIN)\s+([a-z_]+)", text))
    return [name for name in [*VIEWS, *BASE_TABLES] if name in names]


# By what the rows of a table are dealt; lines by order, so that the pages of a leaflet need not be dealt again.
KEYS = {"part": ["p_partkey"], "lineitem": ["l_orderkey"]}


def load(spark: SparkSession, sf_dir: str, name: str, dealt: dict[str, list[str]] | None = None) -> DataFrame:
    """The table or view ``name`` over the parquet files of ``sf_dir``; tables in ``dealt`` are dealt out by the columns it names before anything is made of them."""
    dealt = dealt or {}
    if name not in VIEWS:
        table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return spread(table, *dealt[name]) if name in dealt else table
    for source in _needs(VIEWS[name]):
        load(spark, sf_dir, source, dealt).createOrReplaceTempView(source)
    return spark.sql(VIEWS[name])


def with_views(sql: str) -> str:
    """``sql`` with the definitions of all views it uses in front."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in ordered and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                visit(VIEWS[name])
                ordered.append(name)

    visit(sql)
    parts = [f"{name} AS ({VIEWS[name].strip()})" for name in ordered]
    body = sql.strip()
    if not parts:
        return body
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body
