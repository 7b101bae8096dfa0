"""Page and URL classification over the test captures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as dt
from ..functions import urls as ur
from ..operators import capture as cp
from .registry import query
from .views import AS_OF

NOW = f"TIMESTAMP '{AS_OF}'"

SOURCE_SQL = """CASE WHEN contains({u}, 'publitas') THEN 'publitas' WHEN contains({u}, 'ipaper') THEN 'ipaper' WHEN contains({u}, 'yumpu') THEN 'yumpu'
    WHEN contains({u}, 'issuu') THEN 'issuu' ELSE 'unknown' END"""
PAGED_SQL = "CASE WHEN contains({u}, '/page/') THEN {u} ELSE regexp_replace({u}, '/$', '') || '/page/1' END"


def normal_sql(u: str) -> str:
    paged = PAGED_SQL.format(u=u)
    return f"CASE WHEN contains({u}, 'publitas') AND NOT contains({u}, 'publitas_embed') THEN {paged} || CASE WHEN contains({paged}, '?') THEN '&' ELSE '?' END || 'publitas_embed=embedded' ELSE {u} END"


@query("embed_source", f"SELECT page_id, url, {SOURCE_SQL.format(u='url')} AS source FROM responses")
def embed_source(t):
    return t.responses.select("page_id", "url", ur.embed_source(F.col("url")).alias("source"))


@query("normalize_embed_url", f"SELECT page_id, {normal_sql('url')} AS embed_url FROM responses")
def normalize_embed_url(t):
    url = F.col("url")
    return t.responses.select("page_id", ur.normalize_embed_url(url, ur.embed_source(url)).alias("embed_url"))


BUCKETS_SQL = """sorted AS (SELECT retailer_slug, page_id, url, content_type, [p FOR p IN string_split(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/') IF p <> ''] AS parts FROM responses),
  kinds AS (
    SELECT retailer_slug, page_id, 'image' AS bucket, url FROM sorted WHERE starts_with(content_type, 'image/') OR regexp_matches(url, '(?i)\\.(png|jpe?g|webp|gif)($|\\?)')
    UNION ALL SELECT retailer_slug, page_id, 'pdf', url FROM sorted WHERE regexp_matches(url, '(?i)\\.pdf($|\\?)') OR contains(content_type, 'application/pdf')
    UNION ALL SELECT retailer_slug, page_id, 'publitas', 'https://view.publitas.com/' || parts[1] || '/' || parts[2] || '/' FROM sorted
      WHERE contains(url, 'view.publitas.com') AND len(parts) >= 2 AND NOT list_has_any(parts, ['branding', 'custom-menu', 'analytics', 'stats'])
    UNION ALL SELECT retailer_slug, page_id, 'ipaper', url FROM sorted WHERE contains(url, 'ipaper.io') OR contains(url, 'ipapercms.dk')
    UNION ALL SELECT retailer_slug, page_id, 'yumpu', url FROM sorted WHERE contains(url, 'yumpu.com')
    UNION ALL SELECT retailer_slug, page_id, 'issuu', url FROM sorted WHERE contains(url, 'issuu.com') AND (contains(url, '/stacks/') OR contains(url, 'e.issuu.com')) AND ends_with(url, '.html')
    UNION ALL SELECT retailer_slug, page_id, 'api_json', url FROM sorted WHERE contains(content_type, 'application/json') AND regexp_matches(url, 'promo|deal|offer|folder|product|flyer|leaflet')),
  buckets AS (SELECT retailer_slug, bucket, url, min(page_id) AS seq FROM kinds GROUP BY ALL)"""


def buckets_of(t):
    return cp.bucket_responses(t.responses.withColumnRenamed("page_id", "seq"), ["retailer_slug"])


@query("bucket_responses", f"WITH {BUCKETS_SQL} SELECT retailer_slug, bucket, url, seq FROM buckets")
def bucket_responses(t):
    return buckets_of(t)


CAPTURES_SQL = f"""{BUCKETS_SQL},
  captures AS (SELECT retailer_slug, {', '.join(f"arg_min(url, seq) FILTER (bucket = '{k}') AS {k}" for k in ('pdf', 'publitas', 'ipaper', 'yumpu', 'issuu'))} FROM buckets GROUP BY retailer_slug)"""


@query("first_captures", f"WITH {CAPTURES_SQL} SELECT * FROM captures WHERE coalesce(pdf, publitas, ipaper, yumpu, issuu) IS NOT NULL")
def first_captures(t):
    return cp.first_captures(buckets_of(t), ["retailer_slug"])


@query(
    "is_bot_challenge",
    """SELECT doc_id, regexp_matches(lower(text), 'sorry voor de onderbreking|click to verify|captcha|colruytgroup|je een bot|onmiddellijk weer toegang') AS challenge FROM documents
       UNION ALL SELECT p_partkey, p_size % 2 = 0 FROM part""",
)
def is_bot_challenge(t):
    texts = t.documents.select("doc_id", ur.is_bot_challenge(F.col("text")).alias("challenge"))
    words = F.when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit(" CLICK to Verify"))).otherwise(F.col("p_name"))
    return texts.unionAll(t.part.select("p_partkey", ur.is_bot_challenge(words)))


@query(
    "offline_publication",
    """SELECT p_partkey, p_size % 2 = 0 AS is_offline, CASE WHEN p_size % 4 = 0 THEN 'https://new.example.com/' || p_partkey END AS redirect_url FROM part
       UNION ALL SELECT doc_id, false, NULL FROM documents""",
)
def offline_publication(t):
    text = F.expr(
        "p_name || CASE WHEN p_size % 2 = 0 THEN ' Deze publicatie is OFFLINE' ELSE '' END || CASE WHEN p_size % 4 IN (0, 1) THEN ' (zie https://new.example.com/' || p_partkey || ') https://b' ELSE '' END"
    )
    notes = t.part.select("p_partkey", ur.offline_publication(text).alias("o"))
    texts = t.documents.select("doc_id", ur.offline_publication(F.col("text")).alias("o"))
    return notes.unionAll(texts).select("p_partkey", "o.*")


EMBEDDABLE_SQL = """CASE WHEN regexp_matches(lower(coalesce(x_frame_options, '')), 'deny|sameorigin') THEN false
    WHEN regexp_matches(lower(coalesce(csp, '')), 'frame-ancestors[^;]*(''none''|''self'')') THEN false
    WHEN csp LIKE '%frame-ancestors https://a.example.com%' THEN false ELSE true END"""


@query("is_embeddable", f"SELECT page_id, {EMBEDDABLE_SQL} AS embeddable FROM responses")
def is_embeddable(t):
    ok = ur.is_embeddable(F.col("x_frame_options"), F.col("csp"), ("https://own.example.com",))
    return t.responses.select("page_id", ok.alias("embeddable"))


# Links of the test pages, in SQL: every anchor with a double-quoted href; browsers show letters beyond ASCII percent-encoded.
LINKS_SQL = """tags AS (SELECT page_id, 's' || (page_id % 20) AS retailer_slug, url, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*>.*?</a\\s*>')) AS tag,
      generate_subscripts(regexp_extract_all(html, '(?is)<a\\s[^>]*>.*?</a\\s*>'), 1) AS pos FROM pages),
  anchors AS (SELECT page_id, retailer_slug, pos, regexp_extract(tag, 'href="([^"]*)"', 1) AS raw, lower(regexp_replace(regexp_replace(tag, '(?is)^<a\\s[^>]*>|</a\\s*>$', '', 'g'), '<[^>]*>', '', 'g')) AS text,
      regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS origin, regexp_extract(url, '^([^?#]*/)', 1) AS folder FROM tags),
  links AS (SELECT page_id, retailer_slug, pos, text, array_to_string(list_transform(string_split(
      CASE WHEN regexp_matches(raw, '^[a-z]+:') THEN raw WHEN starts_with(raw, '/') THEN origin || raw ELSE folder || raw END, ''),
      lambda c: CASE WHEN ord(c) > 126 THEN url_encode(c) ELSE c END), '') AS href FROM anchors WHERE raw <> '')"""


def pages_of(t):
    named = t.pages.withColumn("retailer_slug", F.concat(F.lit("s"), (F.col("page_id") % 20).cast("string")))
    return cp.with_links(named)


@query("page_links", f"WITH {LINKS_SQL} SELECT page_id, pos - 1 AS pos, href FROM links")
def page_links(t):
    rows = cp.unnest(pages_of(t), ["page_id"], F.col("links"), "link", "pos")
    return rows.select("page_id", F.col("pos").cast("bigint").alias("pos"), "link.href")


# Patterns of half of the retailers; the pages have no leaflet words, so a word of theirs stands in.
@query(
    "pick_folder_link",
    f"""WITH {LINKS_SQL}, patterned AS (SELECT * FROM links WHERE regexp_matches(href, '/(th|an)') AND retailer_slug IN (SELECT slug FROM retailers WHERE category IN ('supermarkt', 'discounter'))),
          worded AS (SELECT * FROM links WHERE regexp_matches(lower(href) || ' ' || text, 'folder|leaflet|flyer|brochure'))
        SELECT p.page_id, coalesce((SELECT arg_min(href, pos) FROM patterned x WHERE x.page_id = p.page_id), (SELECT arg_min(href, pos) FROM worded x WHERE x.page_id = p.page_id)) AS folder_link FROM pages p""",
)
def pick_folder_link(t):
    patterns = t.retailers.filter(F.col("category").isin("supermarkt", "discounter")).select(
        "slug", F.array(F.lit("/th"), F.lit("/an")).alias("patterns")
    )
    return cp.pick_folder_link(pages_of(t), patterns).select("page_id", "folder_link")


# Pages that carry frames or data attributes, by part.
FRAMED = """SELECT p_partkey AS page_id, 's' || CAST(p_partkey % 25 AS STRING) AS retailer_slug, 'https://www.example.com/nl/' AS url,
  CASE p_partkey % 6 WHEN 0 THEN '<iframe src="https://www.google.com/x"></iframe><iframe class="v" src="https://view.publitas.com/a/b/"></iframe>'
    WHEN 1 THEN '<iframe src="about:blank"></iframe><iframe src="https://analytics.example.com/"></iframe><iframe src="https://viewer.example.com/1"></iframe>'
    WHEN 2 THEN '<div class="f" data-embed-url="https://issuu.com/q" data-viewer-url="https://x.example.com"></div>'
    WHEN 3 THEN '<p>none</p>' WHEN 4 THEN '<iframe src="https://cookie.example.com/"></iframe><b data-viewer-url="https://v.example.com/1">x</b>'
    ELSE '<iframe src="/flipbook/7"></iframe>' END AS html FROM part"""

PICKED_SQL = f"""{CAPTURES_SQL},
  framed AS ({FRAMED}),
  raw_choice AS (SELECT f.page_id, f.retailer_slug, CASE f.page_id % 6 WHEN 0 THEN 'https://view.publitas.com/a/b/' WHEN 1 THEN 'https://viewer.example.com/1' WHEN 5 THEN 'https://www.example.com/flipbook/7' END AS frame,
      CASE f.page_id % 6 WHEN 2 THEN 'https://issuu.com/q' WHEN 4 THEN 'https://v.example.com/1' END AS data, c.publitas, c.ipaper, c.yumpu, c.issuu
    FROM framed f LEFT JOIN captures c USING (retailer_slug)),
  picked AS (SELECT page_id, retailer_slug, CASE WHEN frame IS NOT NULL THEN {normal_sql('frame')} WHEN publitas IS NOT NULL THEN {normal_sql('publitas')} ELSE coalesce(ipaper, yumpu, issuu, data) END AS embed_url,
      CASE WHEN frame IS NOT NULL THEN {SOURCE_SQL.format(u='frame')} WHEN publitas IS NOT NULL THEN 'publitas' WHEN ipaper IS NOT NULL THEN 'ipaper' WHEN yumpu IS NOT NULL THEN 'yumpu'
        WHEN issuu IS NOT NULL THEN 'issuu' WHEN data IS NOT NULL THEN {SOURCE_SQL.format(u='data')} END AS embed_kind FROM raw_choice)"""


def framed_of(t):
    t.dealt("part", "part").createOrReplaceTempView("part")
    return t.spark.sql(FRAMED)


def picked_of(t):
    return cp.pick_embed(framed_of(t), cp.first_captures(buckets_of(t), ["retailer_slug"]), ["retailer_slug"])


@query("pick_embed", f"WITH {PICKED_SQL} SELECT page_id, embed_url, embed_kind FROM picked")
def pick_embed(t):
    return picked_of(t).select("page_id", "embed_url", "embed_kind")


@query(
    "pick_pdf",
    f"""WITH {CAPTURES_SQL}, {LINKS_SQL}, files AS (SELECT page_id, arg_min(href, pos) AS href FROM links WHERE regexp_matches(href, '(?i)\\.pdf($|\\?|#)') GROUP BY page_id),
          downloads AS (SELECT page_id, arg_min(href, pos) AS href FROM links WHERE contains(text, 'download') AND contains(text, 'pdf') AND starts_with(href, 'http') GROUP BY page_id)
        SELECT p.page_id, coalesce(c.pdf, f.href, d.href) AS pdf_url FROM pages p LEFT JOIN captures c ON c.retailer_slug = 's' || (p.page_id % 20) LEFT JOIN files f USING (page_id) LEFT JOIN downloads d USING (page_id)""",
)
def pick_pdf(t):
    captures = cp.first_captures(buckets_of(t), ["retailer_slug"])
    return cp.pick_pdf(pages_of(t), captures, ["retailer_slug"]).select("page_id", "pdf_url")


@query(
    "resolve_content_source",
    f"""WITH {PICKED_SQL} SELECT page_id, CASE WHEN embed_kind IS NOT NULL THEN embed_kind WHEN p_size % 4 = 0 THEN 'pdf' WHEN p_size % 4 = 1 THEN 'screenshot' WHEN p_size % 4 = 2 THEN 'html' ELSE 'unknown' END AS content_source
        FROM picked JOIN part ON p_partkey = page_id""",
)
def resolve_content_source(t):
    rows = picked_of(t).join(t.part.select(F.col("p_partkey").alias("page_id"), "p_size"), "page_id")
    n = F.col("p_size") % 4
    return rows.select("page_id", ur.resolve_content_source(F.col("embed_kind"), n == 0, n <= 1, n <= 2).alias("content_source"))


@query(
    "probe_fingerprint",
    f"""WITH {PICKED_SQL} SELECT page_id, CASE WHEN p_size % 5 = 0 THEN 'no-folder-url' WHEN p_size % 5 = 1 THEN 'blocked' ELSE coalesce(embed_url, CASE WHEN p_size % 2 = 0 THEN 'https://x.example.com/a.pdf' END, 'none') END AS fingerprint
        FROM picked JOIN part ON p_partkey = page_id""",
)
def probe_fingerprint(t):
    rows = picked_of(t).join(t.part.select(F.col("p_partkey").alias("page_id"), "p_size"), "page_id")
    start = F.when(F.col("p_size") % 5 != 0, "https://www.example.com/")
    pdf = F.when(F.col("p_size") % 2 == 0, "https://x.example.com/a.pdf")
    mark = ur.probe_fingerprint(start, F.col("p_size") % 5 == 1, F.col("embed_url"), pdf)
    return rows.select("page_id", mark.alias("fingerprint"))


@query(
    "build_folder_rows",
    f"""WITH {CAPTURES_SQL}, c AS (SELECT r.slug, r.name, CASE WHEN r.category = 'drogist' THEN 'Drogist folder' END AS folder_title, coalesce(k.publitas, k.ipaper, k.yumpu, k.issuu) AS embed_url,
            CASE WHEN k.publitas IS NOT NULL THEN 'publitas' WHEN k.ipaper IS NOT NULL THEN 'ipaper' WHEN k.yumpu IS NOT NULL THEN 'yumpu' WHEN k.issuu IS NOT NULL THEN 'issuu' END AS embed_kind, k.pdf AS pdf_url,
            list_contains(r.verticals, 'pet') AS offline, r.category <> 'discounter' AS embeddable FROM retailers r LEFT JOIN captures k ON k.retailer_slug = r.slug),
          s AS (SELECT retailer_slug AS slug, count(*) AS n, min(page) AS opening FROM (SELECT DISTINCT 's' || (o_custkey % 50) AS retailer_slug, CAST(o_orderkey % 15 + 1 AS INTEGER) AS page FROM orders WHERE o_orderstatus = 'P') GROUP BY 1)
        SELECT slug || '-2024-w5-folder' AS id, slug AS retailer_slug, coalesce(folder_title, name || ' folder van de week') AS title, DATE '2024-01-29' AS valid_from, DATE '2024-02-04' AS valid_until,
          CAST(coalesce(s.n, 0) AS INTEGER) AS page_count, CASE WHEN s.n > 0 THEN '/shots/' || s.opening || '.png' ELSE '' END AS thumbnail_url,
          CASE WHEN NOT (offline OR NOT embeddable OR coalesce(embed_kind = 'issuu' AND s.n > 0, false)) THEN embed_url END AS embed_url, pdf_url,
          CASE WHEN embed_kind IS NOT NULL THEN embed_kind WHEN pdf_url IS NOT NULL THEN 'pdf' WHEN s.n > 0 THEN 'screenshot' ELSE 'html' END AS content_source
        FROM c LEFT JOIN s USING (slug)""",
)
def build_folder_rows(t):
    captures = cp.first_captures(buckets_of(t), ["retailer_slug"]).withColumnRenamed("retailer_slug", "slug")
    kind = F.coalesce(*[F.when(F.col(k).isNotNull(), F.lit(k)) for k in ("publitas", "ipaper", "yumpu", "issuu")])
    rows = t.retailers.join(captures, "slug", "left").select(
        "slug", "name", F.when(F.col("category") == "drogist", "Drogist folder").alias("folder_title"),
        F.coalesce("publitas", "ipaper", "yumpu", "issuu").alias("embed_url"), kind.alias("embed_kind"), F.col("pdf").alias("pdf_url"),
        F.array_contains("verticals", "pet").alias("offline"), (F.col("category") != "discounter").alias("embeddable"), F.lit(3).alias("deal_count"),
    )
    page = (F.col("o_orderkey") % 15 + 1).cast("int")
    shots = t.orders.filter("o_orderstatus = 'P'").select(
        F.concat(F.lit("s"), (F.col("o_custkey") % 50).cast("string")).alias("slug"), page.alias("page_number"),
    ).distinct()
    shots = shots.withColumn("image_url", F.concat(F.lit("/shots/"), F.col("page_number").cast("string"), F.lit(".png")))
    return cp.build_folder_rows(rows, shots, AS_OF).drop("pages", "scraped_at")


WEEK_SLUGS = "CASE o_custkey % 5 WHEN 0 THEN 'albert-heijn' WHEN 1 THEN 'delhaize' WHEN 2 THEN 'aldi' WHEN 3 THEN 'lidl' ELSE 'other' END"


@query(
    "week_dates",
    """SELECT o_orderkey, CAST(date_trunc('week', o_orderdate) AS DATE) AS valid_from, CAST(date_trunc('week', o_orderdate) + INTERVAL 6 DAY AS DATE) AS valid_until FROM orders""",
)
def week_dates(t):
    return t.orders.select("o_orderkey", dt.week_dates(F.col("o_orderdate")).alias("w")).select("o_orderkey", "w.*")


@query(
    "folder_id",
    """SELECT o_orderkey, 's' || (o_custkey % 50) || '-' || year(o_orderdate) || '-w' || week(o_orderdate) || '-folder' AS id FROM orders""",
)
def folder_id(t):
    slug = F.concat(F.lit("s"), (F.col("o_custkey") % 50).cast("string"))
    return t.orders.select("o_orderkey", dt.folder_id(slug, F.col("o_orderdate")).alias("id"))


@query(
    "candidate_week_urls",
    f"""WITH r AS (SELECT o_orderkey, {WEEK_SLUGS} AS slug, o_orderdate AS d, CAST(unnest([0, 1, -1]) AS INTEGER) AS "offset" FROM orders),
          w AS (SELECT *, week(d) + "offset" AS week, isoyear(d) AS year, CAST(date_trunc('week', d) AS DATE) + 7 * "offset" AS monday FROM r)
        SELECT o_orderkey, slug, "offset", CASE slug WHEN 'albert-heijn' THEN 'https://www.ah.be/bonus/folder/bonus-week-' || week || '-' || year
            WHEN 'delhaize' THEN 'https://view.publitas.com/delhaize-belgium-nl/w' || week || '-' || year || '-nl/page/1'
            WHEN 'aldi' THEN 'https://folder.aldi.be/import-folder/' || year || '/' || right(CAST(year AS VARCHAR), 2) || lpad(CAST(week AS VARCHAR), 2, '0') || '-nl'
            ELSE 'https://folder-nl.lidl.be/nl-folder-' || strftime(monday, '%d-%m') || '-' || strftime(monday + 5, '%d-%m') END AS url
        FROM w WHERE slug = 'lidl' OR (slug <> 'other' AND week BETWEEN 1 AND 53)""",
)
def candidate_week_urls(t):
    requests = t.orders.select("o_orderkey", F.expr(WEEK_SLUGS).alias("slug"), F.col("o_orderdate").alias("moment"))
    return cp.candidate_week_urls(requests).select("o_orderkey", "slug", "offset", "url")


VIEWERS = """CASE p_partkey % 6 WHEN 0 THEN 'https://e.issuu.com/embed.html?d=x' || p_partkey WHEN 1 THEN 'https://e.issuu.com/embed.html?pageNumber=4&u=y#z'
  WHEN 2 THEN 'https://view.publitas.com/g/' || p_partkey || '/page/7/?publitas_embed=embedded' WHEN 3 THEN 'https://view.publitas.com/g/h' WHEN 4 THEN 'https://b.ipaper.io/iPaper/Papers/q' || p_partkey || '/Pages/1/Zoom.jpg?t=1'
  ELSE 'https://other.example.com/page/1' END"""


@query(
    "viewer_page_urls",
    f"""SELECT p_partkey, page, CASE p_partkey % 6 WHEN 0 THEN 'https://e.issuu.com/embed.html?d=x' || p_partkey || '&pageNumber=' || page WHEN 1 THEN 'https://e.issuu.com/embed.html?pageNumber=' || page || '&u=y#z'
          WHEN 2 THEN 'https://view.publitas.com/g/' || p_partkey || '/page/' || page || '?publitas_embed=embedded' WHEN 3 THEN 'https://view.publitas.com/g/h?page=' || page || '&pageNumber=' || page
          ELSE 'https://b.ipaper.io/iPaper/Papers/q' || p_partkey || '/Pages/' || page || '/Zoom.jpg?t=1' END AS page_url
        FROM (SELECT p_partkey, CAST(unnest(range(1, p_size + 1)) AS INTEGER) AS page FROM part WHERE p_partkey % 6 < 5)""",
)
def viewer_page_urls(t):
    embeds = t.dealt("part", "part").select("p_partkey", "p_size", F.expr(VIEWERS).alias("url"))
    return cp.viewer_page_urls(embeds, F.col("p_size").cast("int")).select("p_partkey", "page", "page_url")
