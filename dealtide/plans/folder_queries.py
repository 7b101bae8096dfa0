"""Leaflet lifecycle, validation, health, coverage and change detection over the test documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import format_age as age_text
from ..operators import changes as ch
from ..operators import coverage as cv
from ..operators import folders as fo
from ..operators import health as he
from ..sources import sinks
from ..sources.documents import deals_of, folders_of, parse_docs
from ..streaming.folders import run_folder
from .registry import query
from .views import AS_OF

NOW = f"TIMESTAMP '{AS_OF}'"

# Parsed documents and their leaflets, in SQL.
DOCS_SQL = """docs AS (SELECT slug, raw, try_cast(raw AS JSON) AS doc FROM folder_docs),
  valid AS (SELECT slug, doc FROM docs WHERE json_type(doc, '$.folders') = 'ARRAY'),
  folders AS (SELECT slug, CAST(pos - 1 AS INTEGER) AS pos, f ->> '$.id' AS id, f ->> '$.title' AS title, f ->> '$.validFrom' AS valid_from, f ->> '$.validUntil' AS valid_until,
      CAST(f ->> '$.pageCount' AS DOUBLE) AS page_count, json_array_length(f, '$.pages') AS pages, f ->> '$.embedUrl' AS embed_url, f ->> '$.pdfUrl' AS pdf_url,
      f ->> '$.contentSource' AS content_source
    FROM (SELECT slug, unnest(CAST(json_extract(doc, '$.folders') AS JSON[])) AS f, generate_subscripts(CAST(json_extract(doc, '$.folders') AS JSON[]), 1) AS pos FROM valid)),
  dated AS (SELECT *, coalesce(try_cast(valid_from AS DATE), try_strptime(valid_from, '%m-%d-%Y')::DATE) AS d_from,
      coalesce(try_cast(valid_until AS DATE), try_strptime(valid_until, '%m-%d-%Y')::DATE) AS d_until,
      CASE WHEN regexp_full_match(valid_until, '\\d{4}-\\d{2}-\\d{2}') THEN try_cast(valid_until || ' 23:59:59' AS TIMESTAMP) END AS ends FROM folders)"""


def docs_of(t):
    return parse_docs(t.folder_docs)


@query(
    "read_folder_docs",
    f"""WITH {DOCS_SQL} SELECT slug, doc IS NOT NULL AS is_json, coalesce(json_type(doc, '$.folders') = 'ARRAY', false) AS is_valid,
          doc ->> '$.scrapedAt' AS scraped_at, CASE WHEN json_type(doc, '$.folders') = 'ARRAY' THEN json_array_length(doc, '$.folders')::INTEGER END AS folders FROM docs""",
)
def read_folder_docs(t):
    return docs_of(t).select("slug", "is_json", "is_valid", "scraped_at", F.size("folders").alias("folders"))


@query(
    "folders_of",
    f"WITH {DOCS_SQL} SELECT slug, pos, id, title, valid_from, valid_until, page_count, embed_url, pdf_url, content_source FROM folders",
)
def folders_rows(t):
    return folders_of(docs_of(t)).select(
        "slug", "pos", "id", "title", "valid_from", "valid_until", "page_count", "embed_url", "pdf_url", "content_source"
    )


@query("deals_of", f"WITH {DOCS_SQL} SELECT slug AS doc_slug, 0 AS pos, 'd1' AS id FROM valid WHERE json_array_length(doc, '$.deals') = 1")
def deals_rows(t):
    return deals_of(docs_of(t)).select("doc_slug", "pos", "id")


CURRENT_SQL = f"""{DOCS_SQL},
  current AS (SELECT * FROM dated QUALIFY row_number() OVER (PARTITION BY slug ORDER BY NOT coalesce(d_from <= {NOW} AND d_until >= {NOW}, false), pos) = 1)"""


@query("all_current_folders", f"WITH {CURRENT_SQL} SELECT slug, id, title, valid_from, valid_until, content_source FROM current")
def all_current_folders(t):
    return fo.all_current_folders(docs_of(t), AS_OF).select(
        "slug", "id", "title", "valid_from", "valid_until", "content_source"
    )


@query("current_folder", f"WITH {CURRENT_SQL} SELECT slug, id, valid_until FROM current WHERE slug = 's9'")
def current_folder(t):
    return fo.current_folder(docs_of(t), "s9", AS_OF).select("slug", "id", "valid_until")


@query(
    "current_folders_for_vertical",
    f"""WITH {CURRENT_SQL} SELECT slug, id, valid_until FROM current
        WHERE slug IN (SELECT slug FROM retailers WHERE list_contains(verticals, 'beauty'))""",
)
def current_folders_for_vertical(t):
    return fo.current_folders_for_vertical(docs_of(t), t.retailers, "beauty", AS_OF).select("slug", "id", "valid_until")


@query("scraped_at", f"WITH {DOCS_SQL} SELECT slug, CAST(replace(doc ->> '$.scrapedAt', 'Z', '') AS TIMESTAMP) AS scraped_at FROM docs")
def scraped_at(t):
    return fo.scraped_at(docs_of(t))


LOCAL_SQL = f"""{DOCS_SQL},
  local AS (SELECT slug, coalesce(json_type(doc, '$.folders') = 'ARRAY', false) AS valid,
      CASE WHEN json_type(doc, '$.folders') = 'ARRAY' THEN epoch({NOW} - CAST(replace(doc ->> '$.scrapedAt', 'Z', '') AS TIMESTAMP)) / 3600.0::DOUBLE END AS age_hours FROM docs)"""


@query("check_local_data", f"WITH {LOCAL_SQL} SELECT slug, valid, age_hours FROM local")
def check_local_data(t):
    return fo.check_local_data(docs_of(t), AS_OF)


AGE_SQL = """CASE WHEN {h} IS NULL THEN 'unknown age' WHEN {h} < 1 THEN CAST(floor({h} * 60 + 0.5)::BIGINT AS VARCHAR) || 'm'
    WHEN {h} < 24 THEN CAST(floor({h} + 0.5)::BIGINT AS VARCHAR) || 'h' ELSE CAST(floor({h} / 24 + 0.5)::BIGINT AS VARCHAR) || 'd' END"""


@query(
    "format_age",
    f"""SELECT o_orderkey, {AGE_SQL.format(h='hours')} AS age FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL
          WHEN o_orderstatus = 'F' THEN o_totalprice / 100000 ELSE o_totalprice / 1000 END AS hours FROM orders)""",
)
def format_age(t):
    hours = F.expr(
        "CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderstatus = 'F' THEN o_totalprice / 100000 ELSE o_totalprice / 1000 END"
    )
    return t.orders.select("o_orderkey", hours.alias("hours")).select("o_orderkey", age_text(F.col("hours")).alias("age"))


EXPIRY_SQL = f"""{DOCS_SQL},
  expiry AS (SELECT d.slug, coalesce(f.ends < {NOW}, false) AS expired, nullif(f.valid_until, '') AS latest_valid_until
    FROM docs d LEFT JOIN dated f ON f.slug = d.slug AND f.pos = 0)"""


@query("folder_expiry", f"WITH {EXPIRY_SQL} SELECT * FROM expiry")
def folder_expiry(t):
    return fo.folder_expiry(docs_of(t), AS_OF)


# The documents are looked at when both leaflets have ended.
LATER = "2024-03-01 00:00:00"


def _links(docs):
    return folders_of(docs).select("slug", "pos", "embed_url", "pdf_url")


@query(
    "strip_offline_embeds",
    f"""WITH {DOCS_SQL},
        past AS (SELECT *, NOT coalesce(ends >= TIMESTAMP '{LATER}', false) AS gone FROM dated)
        SELECT slug, pos, CASE WHEN gone AND regexp_matches(embed_url, '(?i)publitas\\.com|folderz\\.be') THEN '' ELSE embed_url END AS embed_url,
          CASE WHEN gone AND regexp_matches(pdf_url, '(?i)publitas\\.com|folderz\\.be') THEN '' ELSE pdf_url END AS pdf_url,
          bool_or(gone AND (coalesce(regexp_matches(embed_url, '(?i)publitas\\.com|folderz\\.be'), false)
            OR coalesce(regexp_matches(pdf_url, '(?i)publitas\\.com|folderz\\.be'), false))) OVER (PARTITION BY slug) AS changed FROM past""",
)
def strip_offline_embeds(t):
    stripped = fo.strip_offline_embeds(docs_of(t), LATER)
    return _links(stripped).join(stripped.select("slug", "changed"), "slug")


PROBES_SQL = "probes AS (SELECT slug, url, arg_max_null(status, seq) AS status FROM (SELECT * FROM probe_log QUALIFY row_number() OVER (PARTITION BY slug, url ORDER BY seq DESC, probed_at DESC, status DESC NULLS LAST) = 1) GROUP BY slug, url)"


def probes_of(t):
    # The log has no unique sequence of its own: time and status settle ties.
    log = t.probe_log.select("slug", "url", "status", F.struct("seq", "probed_at", "status").alias("seq"))
    return fo.latest_probes(log)


@query(
    "classify_probe",
    "SELECT page_id, status, status IS NULL OR status < 400 AS live FROM responses",
)
def classify_probe(t):
    return t.responses.select("page_id", "status", fo.classify_probe(F.col("status")).alias("live"))


@query("latest_probes", f"WITH {PROBES_SQL} SELECT slug, url, status, status IS NULL OR status < 400 AS live FROM probes")
def latest_probes(t):
    return probes_of(t)


TARGETS_SQL = """targets AS (SELECT slug, CAST(pos * 2 AS INTEGER) AS place, embed_url AS url FROM folders WHERE starts_with(embed_url, 'http')
    UNION ALL SELECT slug, CAST(pos * 2 + 1 AS INTEGER), pdf_url FROM folders WHERE starts_with(pdf_url, 'http'))"""


@query(
    "probe_results",
    f"""WITH {DOCS_SQL}, {PROBES_SQL}, {TARGETS_SQL}
        SELECT slug, url, place, status, status IS NULL OR status < 400 AS live FROM targets JOIN probes USING (slug, url)""",
)
def probe_results(t):
    return fo.probe_results(docs_of(t), probes_of(t))


@query(
    "strip_dead_urls",
    f"""WITH {DOCS_SQL}, {PROBES_SQL}, dead AS (SELECT slug, url FROM probes WHERE status >= 400)
        SELECT f.slug, pos, CASE WHEN e.url IS NOT NULL THEN '' ELSE embed_url END AS embed_url, CASE WHEN p.url IS NOT NULL THEN '' ELSE pdf_url END AS pdf_url,
          bool_or(e.url IS NOT NULL OR p.url IS NOT NULL) OVER (PARTITION BY f.slug) AS changed
        FROM folders f LEFT JOIN dead e ON e.slug = f.slug AND e.url = f.embed_url LEFT JOIN dead p ON p.slug = f.slug AND p.url = f.pdf_url""",
)
def strip_dead_urls(t):
    stripped = fo.strip_dead_urls(docs_of(t), probes_of(t))
    return _links(stripped).join(stripped.select("slug", "changed"), "slug")


ISSUES_SQL = """issues AS (
    SELECT slug, 'file' AS field, 'Invalid JSON' AS message, 'error' AS severity FROM docs WHERE doc IS NULL
    UNION ALL SELECT slug, 'folders', 'Missing or not an array', 'error' FROM docs WHERE doc IS NOT NULL AND json_type(doc, '$.folders') IS DISTINCT FROM 'ARRAY'
    UNION ALL SELECT slug, 'folders', 'Empty folders array', 'warning' FROM valid WHERE json_array_length(doc, '$.folders') = 0
    UNION ALL SELECT slug, 'folders[' || pos || '].title', 'Missing or invalid title', 'error' FROM folders WHERE coalesce(title, '') = ''
    UNION ALL SELECT slug, 'folders[' || pos || '].validFrom', 'Invalid date: ' || coalesce(valid_from, 'undefined'), 'error' FROM folders WHERE NOT coalesce(regexp_full_match(valid_from, '\\d{4}-\\d{2}-\\d{2}'), false)
    UNION ALL SELECT slug, 'folders[' || pos || '].validUntil', 'Invalid date: ' || coalesce(valid_until, 'undefined'), 'error' FROM folders WHERE NOT coalesce(regexp_full_match(valid_until, '\\d{4}-\\d{2}-\\d{2}'), false)
    UNION ALL SELECT slug, 'folders[' || pos || '].pageCount', 'Mismatch: pageCount=' || page_count::BIGINT || ' but pages.length=' || pages, 'warning' FROM folders WHERE page_count <> pages
    UNION ALL SELECT slug, 'folders[' || pos || '].embedUrl', 'Not a valid URL: ' || embed_url, 'warning' FROM folders WHERE embed_url <> '' AND NOT starts_with(embed_url, 'http')
    UNION ALL SELECT slug, 'folders[' || pos || '].pdfUrl', 'Not a valid URL: ' || pdf_url, 'warning' FROM folders WHERE pdf_url <> '' AND NOT starts_with(pdf_url, 'http')
    UNION ALL SELECT slug, 'folders[' || pos || ']', 'Folder has no embed, PDF, or pages — will show empty on frontend', 'warning' FROM folders
      WHERE coalesce(embed_url, '') = '' AND coalesce(pdf_url, '') = '' AND coalesce(pages, 0) = 0)"""


@query("validate_docs", f"WITH {DOCS_SQL}, {ISSUES_SQL} SELECT * FROM issues")
def validate_docs(t):
    return he.validate_docs(docs_of(t))


STATUS_SQL = f"""{EXPIRY_SQL}, local AS (SELECT slug, coalesce(json_type(doc, '$.folders') = 'ARRAY', false) AS valid,
      CASE WHEN json_type(doc, '$.folders') = 'ARRAY' THEN epoch({NOW} - CAST(replace(doc ->> '$.scrapedAt', 'Z', '') AS TIMESTAMP)) / 3600.0::DOUBLE END AS age_hours FROM docs),
  counted AS (SELECT a.*, l.valid, l.age_hours FROM attempt_log a LEFT JOIN local l USING (slug)),
  tried AS (SELECT run_id, slug, any_value(valid) AS valid, any_value(age_hours) AS age_hours, min(attempt) FILTER (ok) AS win, max(attempt) AS last_n,
      arg_max(error, attempt) AS last_error FROM counted GROUP BY run_id, slug),
  results AS (SELECT run_id, slug, CASE WHEN win = 1 THEN 'fresh' WHEN win > 1 THEN 'retry_success' WHEN coalesce(valid, false) AND age_hours > 168 THEN 'stale'
        WHEN coalesce(valid, false) THEN 'fallback_local' ELSE 'missing' END AS status, coalesce(win, last_n) AS attempts,
      CASE WHEN win IS NULL THEN last_error END AS error,
      CASE WHEN win IS NULL AND coalesce(valid, false) THEN {AGE_SQL.format(h='age_hours')} END AS data_age FROM tried)"""


def results_of(t):
    return he.run_status(t.attempt_log, docs_of(t), AS_OF)


@query("run_status", f"WITH {STATUS_SQL} SELECT * FROM results")
def run_status(t):
    return results_of(t)


# A retailer without a document has one issue: its file is missing.
ENTRIES_SQL = f"""{STATUS_SQL}, {PROBES_SQL}, {TARGETS_SQL}, {ISSUES_SQL},
  entries AS (SELECT r.*, d.doc ->> '$.scrapedAt' AS scraped_at, coalesce(f.n, 0) AS folder_count,
      CAST(CASE WHEN json_type(d.doc, '$.deals') = 'ARRAY' THEN json_array_length(d.doc, '$.deals') ELSE 0 END AS BIGINT) AS deal_count,
      coalesce(f.embed, false) AS has_embed, coalesce(f.pdf, false) AS has_pdf, coalesce(f.pages, false) AS has_pages, CASE WHEN d.raw IS NULL THEN 1 ELSE coalesce(i.n, 0) END AS issues, CASE WHEN d.raw IS NULL THEN 1 ELSE coalesce(i.errors, 0) END AS errors,
      CASE WHEN r.status <> 'missing' THEN coalesce(p.n, 0) ELSE 0 END AS probes, CASE WHEN r.status <> 'missing' THEN coalesce(p.dead, 0) ELSE 0 END AS dead
    FROM results r LEFT JOIN docs d USING (slug)
      LEFT JOIN (SELECT slug, count(*) AS n, bool_or(coalesce(embed_url, '') <> '') AS embed, bool_or(coalesce(pdf_url, '') <> '') AS pdf, bool_or(pages > 0) AS pages FROM folders GROUP BY slug) f USING (slug)
      LEFT JOIN (SELECT slug, count(*) AS n, count(*) FILTER (severity = 'error') AS errors FROM issues GROUP BY slug) i USING (slug)
      LEFT JOIN (SELECT slug, count(*) AS n, count(*) FILTER (status >= 400) AS dead FROM targets JOIN probes USING (slug, url) GROUP BY slug) p USING (slug))"""


def entries_of(t):
    docs = docs_of(t)
    return he.health_entries(results_of(t), docs, fo.probe_results(docs, probes_of(t)))


@query(
    "health_entries",
    f"""WITH {ENTRIES_SQL} SELECT run_id, slug, status, attempts, error, data_age, scraped_at, folder_count, deal_count, has_embed, has_pdf, has_pages, issues, errors, probes, dead FROM entries""",
)
def health_entries(t):
    def many(array, test):
        return F.size(F.filter(array, test)).cast("bigint")

    return entries_of(t).select(
        "run_id", "slug", "status", "attempts", "error", "data_age", "scraped_at",
        F.col("folder_count").cast("bigint").alias("folder_count"), F.col("deal_count").cast("bigint").alias("deal_count"),
        "has_embed", "has_pdf", "has_pages",
        F.size("validation_issues").cast("bigint").alias("issues"),
        many("validation_issues", lambda i: i["severity"] == "error").alias("errors"),
        F.size("probe_results").cast("bigint").alias("probes"),
        many("probe_results", lambda p: ~p["live"]).alias("dead"),
    )


@query(
    "health_summary",
    f"""WITH {ENTRIES_SQL} SELECT count(*) AS total, count(*) FILTER (status IN ('fresh', 'retry_success')) AS fresh, count(*) FILTER (status = 'fallback_local') AS fallback,
          count(*) FILTER (status = 'stale') AS stale, count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (errors > 0) AS with_errors,
          count(*) FILTER (dead > 0) AS with_dead_urls FROM entries""",
)
def health_summary(t):
    return he.health_summary(entries_of(t))


@query(
    "write_health_manifest",
    f"""WITH {ENTRIES_SQL} SELECT status, count(*) AS entries, (SELECT count(*) FROM entries) AS total, (SELECT count(*) FROM entries WHERE errors > 0) AS with_errors, '2024-01-31T00:00:00Z' AS stamp
        FROM entries GROUP BY status""",
)
def write_health_manifest(t):
    """The manifest is written and read back: its lines by status beside its totals."""
    path = run_folder(t.spark, "health")
    sinks.write_health_manifest(entries_of(t), path, "2024-01-31T00:00:00Z")
    totals = t.spark.read.json(f"{path}/summary").select("summary.total", "summary.with_errors", F.col("generatedAt").alias("stamp"))
    lines = t.spark.read.json(f"{path}/retailers").groupBy("status").agg(F.count("*").alias("entries"))
    return lines.withColumn("stamp", F.lit("2024-01-31T00:00:00Z")).join(totals, "stamp")


@query(
    "run_alerts",
    f"""WITH {ENTRIES_SQL} SELECT run_id, slug, 'missing' AS kind, true AS fatal FROM entries WHERE status = 'missing'
        UNION ALL SELECT run_id, slug, 'stale', false FROM entries WHERE status = 'stale'
        UNION ALL SELECT run_id, slug, 'validation_errors', false FROM entries WHERE errors > 0
        UNION ALL SELECT run_id, slug, 'dead_urls', false FROM entries WHERE dead > 0""",
)
def run_alerts(t):
    return he.run_alerts(entries_of(t))


@query(
    "contract_violations",
    f"""WITH {DOCS_SQL} SELECT slug, NULL::INTEGER AS folder, 'retailer_text' AS rule FROM docs WHERE doc ->> '$.retailer' IS NULL
        UNION ALL SELECT slug, NULL, 'folders_array' FROM docs WHERE json_type(doc, '$.folders') IS DISTINCT FROM 'ARRAY'
        UNION ALL SELECT slug, NULL, 'deals_array' FROM docs WHERE json_type(doc, '$.deals') IS DISTINCT FROM 'ARRAY'
        UNION ALL SELECT slug, NULL, 'scraped_at_text' FROM docs WHERE doc ->> '$.scrapedAt' IS NULL
        UNION ALL SELECT slug, pos, 'folder_retailer' FROM folders
        UNION ALL SELECT slug, pos, 'page_count' FROM folders WHERE page_count <> pages
        UNION ALL SELECT slug, pos, 'thumbnail' FROM folders WHERE pages > 0
        UNION ALL SELECT slug, pos, 'pages_in_order' FROM folders WHERE pages > 0""",
)
def contract_violations(t):
    return he.contract_violations(docs_of(t))


@query(
    "doc_structure_check",
    f"""WITH {DOCS_SQL} SELECT slug, NULL::INTEGER AS folder, 'json' AS rule FROM docs WHERE doc IS NULL
        UNION ALL SELECT slug, NULL, 'retailer' FROM docs WHERE doc ->> '$.retailer' IS NULL
        UNION ALL SELECT slug, NULL, 'scraped_at' FROM docs WHERE doc ->> '$.scrapedAt' IS NULL
        UNION ALL SELECT slug, NULL, 'folders' FROM docs WHERE coalesce(CASE WHEN json_type(doc, '$.folders') = 'ARRAY' THEN json_array_length(doc, '$.folders') END, 0) = 0
        UNION ALL SELECT slug, NULL, 'deals' FROM docs WHERE json_type(doc, '$.deals') IS DISTINCT FROM 'ARRAY'
        UNION ALL SELECT slug, NULL, 'source_urls' FROM docs
        UNION ALL SELECT slug, NULL, 'methods' FROM docs WHERE json_type(doc, '$.methods') IS DISTINCT FROM 'ARRAY'
        UNION ALL SELECT slug, NULL, 'deal_fields' FROM docs WHERE json_array_length(doc, '$.deals') > 0
        UNION ALL SELECT slug, pos, unnest(['folder_retailer', 'folder_scraped_at']) FROM folders
        UNION ALL SELECT slug, pos, 'folder_title' FROM folders WHERE coalesce(title, '') = ''
        UNION ALL SELECT slug, pos, 'valid_until' FROM folders WHERE NOT regexp_full_match(valid_until, '\\d{{4}}-\\d{{2}}-\\d{{2}}')
        UNION ALL SELECT slug, pos, 'pdf_url' FROM folders WHERE pdf_url <> '' AND NOT regexp_matches(pdf_url, '^https?://')
        UNION ALL SELECT slug, pos, 'page_fields' FROM folders WHERE pages > 0""",
)
def doc_structure_check(t):
    return he.doc_structure_check(docs_of(t))


@query(
    "freshness_check",
    f"""WITH {LOCAL_SQL}, d2 AS (SELECT slug, bool_or({NOW} - ends < INTERVAL 72 HOUR) AS recent FROM dated GROUP BY slug)
        SELECT l.slug, coalesce(l.age_hours < 168, false) AS fresh, coalesce(d2.recent, false) AS has_recent_folder FROM local l LEFT JOIN d2 USING (slug)""",
)
def freshness_check(t):
    return he.freshness_check(docs_of(t), AS_OF)


@query(
    "viewer_mode",
    f"""WITH {LOCAL_SQL}, v AS (SELECT d.*, coalesce(ends < TIMESTAMP '2024-02-20', false) AS expired, coalesce(l.age_hours > 72, false) AS stale,
          coalesce(regexp_matches(embed_url, '^https?://([^/]*\\.)publitas\\.com/'), false) AS blocked FROM dated d JOIN local l USING (slug))
        SELECT slug, id AS folder_id, expired, stale, blocked AS embed_blocked,
          coalesce(embed_url, '') <> '' AND NOT blocked AS embed_shown, coalesce(pdf_url, '') <> '' AS pdf_shown,
          CASE WHEN pages > 0 THEN 'pages' WHEN coalesce(embed_url, '') <> '' AND NOT blocked THEN 'embed' ELSE 'pdf' END AS mode FROM v""",
)
def viewer_mode(t):
    docs = docs_of(t)
    rows = folders_of(docs).join(fo.check_local_data(docs, AS_OF).select("slug", "age_hours"), "slug")
    return fo.viewer_mode(rows, "2024-02-20 00:00:00")


# Coverage ----------------------------------------------------------------------------------------

CHECKS_SQL = f"""{CURRENT_SQL},
  checks AS (SELECT 'main' AS project, r.slug, c.slug IS NOT NULL AS has_config, coalesce(len([u FOR u IN c.folder_urls IF starts_with(u, 'http')]) > 0, false) AS has_folder_urls,
      d.doc IS NOT NULL AS has_data_file, coalesce(CASE WHEN json_type(d.doc, '$.folders') = 'ARRAY' THEN json_array_length(d.doc, '$.folders') END, 0)::INTEGER AS folder_count,
      coalesce(CASE WHEN json_type(d.doc, '$.deals') = 'ARRAY' THEN json_array_length(d.doc, '$.deals') END, 0)::INTEGER AS deal_count,
      k.slug IS NOT NULL AS has_current_folder, coalesce(k.embed_url <> '', false) OR coalesce(k.pdf_url <> '', false) OR coalesce(k.pages > 0, false) AS renderable, k.content_source
    FROM retailers r LEFT JOIN crawl_configs c USING (slug) LEFT JOIN docs d ON d.slug = r.slug AND d.doc IS NOT NULL LEFT JOIN current k ON k.slug = r.slug),
  reasons AS (SELECT *, concat_ws(',', CASE WHEN NOT has_config THEN 'missing_scraper' END, CASE WHEN NOT has_folder_urls THEN 'missing_folder_urls' END,
      CASE WHEN NOT has_data_file THEN 'missing_data_file' END, CASE WHEN folder_count = 0 THEN 'no_folders' END, CASE WHEN NOT has_current_folder THEN 'no_current_folder' END,
      CASE WHEN has_current_folder AND NOT renderable THEN 'folder_not_renderable' END, CASE WHEN deal_count = 0 AND NOT renderable THEN 'no_products' END) AS failure_reasons FROM checks)"""


def _projects(t):
    return t.retailers.select(F.lit("main").alias("project"), "slug")


def checks_of(t, require_deals=True):
    return cv.coverage_checks(_projects(t), t.crawl_configs, docs_of(t), AS_OF, require_deals)


@query(
    "coverage_checks",
    f"""WITH {CHECKS_SQL} SELECT project, slug, has_config, has_folder_urls, has_data_file, folder_count, has_current_folder, renderable, content_source, deal_count,
          failure_reasons <> '' AS failing, failure_reasons FROM reasons""",
)
def coverage_checks(t):
    return checks_of(t).drop("methods", "scraped_at").withColumn("failure_reasons", F.array_join("failure_reasons", ","))


@query(
    "coverage_failing",
    f"""WITH {CHECKS_SQL} SELECT project, slug, failure_reasons, folder_count, deal_count, content_source FROM reasons WHERE failure_reasons <> ''""",
)
def coverage_failing(t):
    return cv.coverage_failing(checks_of(t)).withColumn("failure_reasons", F.array_join("failure_reasons", ","))


@query("coverage_counts", f"WITH {CHECKS_SQL} SELECT count(*) AS count, count(*) FILTER (failure_reasons <> '') AS failing_count FROM reasons")
def coverage_counts(t):
    return cv.coverage_counts(checks_of(t))


@query(
    "inspector_search",
    f"""WITH {CHECKS_SQL} SELECT q.project, q.slug, r.name, r.category, r.website, q.has_config FROM reasons q JOIN retailers r USING (slug)
        WHERE q.failure_reasons <> '' AND contains(lower(q.project || ' ' || q.slug || ' ' || r.name || ' ' || r.category || ' ' || r.website), 'n s1')""",
)
def inspector_search(t):
    listed = t.retailers.select(F.lit("main").alias("project"), "slug", "name", "category", "website")
    return cv.inspector_search(listed, t.crawl_configs, checks_of(t), query="  N S1 ", project="main", only_failing=True)


@query(
    "config_quality",
    """WITH c AS (SELECT * FROM crawl_configs)
       SELECT slug, 'few_folder_urls' AS rule FROM c WHERE len(folder_urls) < 2
       UNION ALL SELECT slug, 'no_cookie_selectors' FROM c WHERE cookie_selectors IS NULL
       UNION ALL SELECT slug, 'folder_url_not_web' FROM c WHERE len([u FOR u IN folder_urls IF NOT regexp_matches(u, '^https?://')]) > 0
       UNION ALL SELECT slug, 'deal_url_not_web' FROM c WHERE len([u FOR u IN deal_urls IF NOT regexp_matches(u, '^https?://')]) > 0
       UNION ALL SELECT slug, 'selectors_incomplete' FROM c WHERE card_selector IS NOT NULL AND name_selector IS NULL
       UNION ALL SELECT slug, 'folder_urls_repeated' FROM c WHERE len(list_distinct(folder_urls)) < len(folder_urls)
       UNION ALL SELECT slug, 'deal_urls_repeated' FROM c WHERE len(list_distinct(deal_urls)) < len(deal_urls)""",
)
def config_quality(t):
    return cv.config_quality(t.crawl_configs)


# Changes and runs --------------------------------------------------------------------------------


def _probed(t):
    return t.scrape_runs.select(F.col("retailer_slug").alias("slug"), "id", F.col("started_at").alias("probed_at"), "fingerprint_raw")


@query("fingerprint_hash", "SELECT id, sha256(fingerprint_raw) AS fingerprint FROM scrape_runs")
def fingerprint_hash(t):
    return t.scrape_runs.select("id", ch.fingerprint_hash(F.col("fingerprint_raw")).alias("fingerprint"))


GOOD_SQL = """good AS (SELECT retailer_slug AS slug, sha256(fingerprint_raw) AS fingerprint, 'publitas' AS source, NULL::VARCHAR AS embed_url, run_id AS pdf_url, finished_at AS updated_at
    FROM scrape_runs WHERE status = 'scrape_success'),
  state AS (SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY slug ORDER BY updated_at DESC, coalesce(fingerprint, '') DESC, pdf_url DESC) = 1)"""


def state_of(t):
    good = t.scrape_runs.filter(F.col("status") == "scrape_success").select(
        F.col("retailer_slug").alias("slug"), ch.fingerprint_hash(F.col("fingerprint_raw")).alias("fingerprint"),
        F.lit("publitas").alias("source"), F.lit(None).cast("string").alias("embed_url"), F.col("run_id").alias("pdf_url"),
        F.col("finished_at").alias("updated_at"),
    )
    return ch.upsert_fingerprints(None, good)


@query("upsert_fingerprints", f"WITH {GOOD_SQL} SELECT slug, fingerprint, source, embed_url, pdf_url, updated_at FROM state")
def upsert_fingerprints(t):
    return state_of(t)


@query(
    "detect_changes",
    f"""WITH {GOOD_SQL} SELECT r.id, r.retailer_slug AS slug, sha256(r.fingerprint_raw) AS fingerprint,
          coalesce(s.fingerprint, '') = '' OR sha256(r.fingerprint_raw) IS DISTINCT FROM s.fingerprint AS changed
        FROM scrape_runs r LEFT JOIN state s ON s.slug = r.retailer_slug""",
)
def detect_changes(t):
    return ch.detect_changes(_probed(t), state_of(t)).select("id", "slug", "fingerprint", "changed")


@query(
    "change_history",
    """SELECT id, retailer_slug AS slug, coalesce(lag(fingerprint_raw) OVER w, '') = '' OR fingerprint_raw IS DISTINCT FROM lag(fingerprint_raw) OVER w AS changed
       FROM scrape_runs WINDOW w AS (PARTITION BY retailer_slug ORDER BY started_at, id)""",
)
def change_history(t):
    return ch.change_history(_probed(t)).select("id", "slug", "changed")


def _updates(t):
    """Two updates per run: its start, and its end if it has one."""
    runs = t.scrape_runs.withColumnRenamed("retailer_slug", "slug")
    empty = F.lit(None).cast("string")
    start = runs.select(
        "id", "run_id", "slug", F.lit(0).alias("seq"), F.col("started_at").alias("at"), F.lit("started").alias("status"),
        F.lit("Monitor started").alias("message"), empty.alias("fingerprint"), empty.alias("embed_url"), empty.alias("pdf_url"), empty.alias("scraped_data"),
    )
    later = runs.select(
        "id", "run_id", "slug", F.lit(1).alias("seq"), F.col("finished_at").alias("at"),
        F.when(F.col("status") == "no_change", "change_detected").otherwise(F.col("status")).alias("status"), empty.alias("message"),
        F.col("fingerprint_raw").alias("fingerprint"), empty.alias("embed_url"), empty.alias("pdf_url"), "scraped_data",
    )
    return start.unionAll(later)


@query(
    "run_log",
    """SELECT id, run_id, retailer_slug AS slug, started_at, CASE WHEN status = 'no_change' THEN 'change_detected' ELSE status END AS status, NULL::VARCHAR AS message,
         fingerprint_raw AS fingerprint, NULL::VARCHAR AS embed_url, NULL::VARCHAR AS pdf_url, scraped_data,
         CASE WHEN status <> 'no_change' THEN finished_at END AS finished_at FROM scrape_runs""",
)
def run_log(t):
    return ch.run_log(_updates(t))


LAST_SQL = """last_good AS (SELECT retailer_slug AS slug, scraped_data, finished_at, id FROM scrape_runs
    WHERE status = 'scrape_success' AND scraped_data IS NOT NULL QUALIFY row_number() OVER (PARTITION BY retailer_slug ORDER BY finished_at DESC, id DESC) = 1)"""


@query("last_successful_scrape", f"WITH {LAST_SQL} SELECT slug, scraped_data, finished_at, id FROM last_good")
def last_successful_scrape(t):
    return ch.last_successful_scrape(t.scrape_runs.withColumnRenamed("retailer_slug", "slug"))


@query(
    "restore_missing_docs",
    f"""WITH {LAST_SQL}, o AS (SELECT slug, CASE category WHEN 'drogist' THEN 'error' WHEN 'supermarkt' THEN 'changed' ELSE 'unchanged' END AS outcome FROM retailers),
        d AS (SELECT slug, raw FROM folder_docs WHERE raw NOT LIKE '%ftp:x%')
        SELECT o.slug, outcome, CASE outcome WHEN 'error' THEN coalesce(g.scraped_data, d.raw) WHEN 'unchanged' THEN coalesce(d.raw, g.scraped_data) ELSE d.raw END AS raw,
          g.scraped_data IS NOT NULL AND (outcome = 'error' OR (outcome = 'unchanged' AND d.raw IS NULL)) AS restored
        FROM o LEFT JOIN d USING (slug) LEFT JOIN last_good g USING (slug)""",
)
def restore_missing_docs(t):
    outcome = F.when(F.col("category") == "drogist", "error").when(F.col("category") == "supermarkt", "changed").otherwise("unchanged")
    docs = t.folder_docs.filter(~F.contains("raw", F.lit("ftp:x")))
    runs = t.scrape_runs.withColumnRenamed("retailer_slug", "slug")
    return ch.restore_missing_docs(docs, runs, t.retailers.select("slug", outcome.alias("outcome")))


@query(
    "doc_changed",
    """SELECT slug, try_cast(raw AS JSON) IS NULL OR (slug LIKE '%7' AND contains(raw, '"title":"F"')) AS changed FROM folder_docs""",
)
def doc_changed(t):
    later = F.replace("raw", F.lit("T10:00"), F.lit("T11:30"))
    edited = F.when(F.endswith("slug", F.lit("7")), F.replace(later, F.lit('"title":"F"'), F.lit('"title":"H"'))).otherwise(later)
    new = t.folder_docs.withColumn("raw", edited)
    return ch.doc_changed(t.folder_docs, new).select("slug", "changed")
