"""Streams over the test tables, run to their end, and the export and store rows.

Each query reads its table as a stream, lets the stream finish, and returns what it has stored.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.skew import spread
from ..operators import changes as ch
from ..operators import events as ev
from ..sources import event_store, sinks
from ..sources.documents import parse_docs, read_folder_docs
from ..sources.tables import read_events, read_fingerprints, read_products, read_scrape_runs
from ..streaming import events as se
from ..streaming import upserts as su
from ..streaming.folders import run_folder
from .event_queries import DAILY_SQL, NOW
from .ingest_queries import ATTRIBUTION_SQL, ENGAGEMENT_SQL, OUTBOUND_SQL
from .product_queries import KEYED_SQL, SHOWN
from .registry import query
from .views import AS_OF, VIEWS


def _table(t, name: str):
    """A test table that arrives as a stream."""
    path = f"{t.sf_dir}/{name}.parquet"
    return se.read_stream(t.spark, path, t.spark.read.parquet(path).schema)


def _stream(t, table: str, view: str, *keys: str):
    """A view over a table that arrives as a stream; with ``keys``, the rows of a batch are dealt by them over all tasks first."""
    rows = _table(t, table)
    (spread(rows, *keys) if keys else rows).createOrReplaceTempView(table)
    return t.spark.sql(VIEWS[view])


def _finish(stream):
    stream.awaitTermination()


@query("stream_daily_counts", DAILY_SQL.format(filter="true"))
def stream_daily_counts(t):
    work = run_folder(t.spark, "daily")
    events = _stream(t, "events", "sp_events").withColumn("created_at", F.col("created_at").cast("timestamp"))
    _finish(se.start_daily_counts(events, "2 days", f"{work}/counts", f"{work}/progress"))
    return se.read_daily_counts(t.spark, f"{work}/counts")


@query("stream_dedupe_view_hits", "SELECT DISTINCT user_id AS view_id, event_type AS event_key FROM events")
def stream_dedupe_view_hits(t):
    work = run_folder(t.spark, "dedupe")
    hits = _table(t, "events").select(
        F.col("user_id").alias("view_id"), F.col("event_type").alias("event_key"), F.col("ts").cast("timestamp").alias("ts")
    )
    _finish(se.start_dedupe(hits, "40 days", f"{work}/hits", f"{work}/progress"))
    return t.spark.read.parquet(f"{work}/hits").select("view_id", "event_key")


@query(
    "stream_ingest_events",
    f"""WITH {ATTRIBUTION_SQL}, {ENGAGEMENT_SQL}, {OUTBOUND_SQL},
          e AS (SELECT * FROM attribution UNION ALL SELECT * FROM engagement UNION ALL SELECT * FROM outbound)
        SELECT strftime(created_at, '%Y-%m-%d') AS day, event_name, retailer, utm_content, count(*) AS events FROM e GROUP BY ALL""",
)
def stream_ingest_events(t):
    work = run_folder(t.spark, "ingest")
    hits = _stream(t, "events", "raw_hits").withColumn("ts", F.col("ts").cast("timestamp"))
    _finish(se.start_ingest(hits, t.retailers, t.affiliates, f"{work}/events", f"{work}/progress"))
    day = F.date_format("event_date", "yyyy-MM-dd").alias("day")
    stored = t.spark.read.parquet(f"{work}/events")
    return stored.groupBy(day, "event_name", "retailer", "utm_content").agg(F.count(F.lit(1)).alias("events"))


@query("stream_upsert_products", f"WITH {KEYED_SQL} SELECT * FROM products")
def stream_upsert_products(t):
    work = run_folder(t.spark, "products")
    t.part.createOrReplaceTempView("part")
    deals = _stream(t, "lineitem", "raw_deals", "l_partkey").withColumn("scraped_at", F.col("scraped_at").cast("timestamp"))
    _finish(su.start_product_upserts(deals, f"{work}/table", f"{work}/progress", "2001-10-01 00:00:00"))
    stored = read_products(t.spark, f"{work}/table").select(*SHOWN)
    return stored.withColumn("scraped_at", F.col("scraped_at").cast("timestamp_ntz"))


@query(
    "stream_change_detection",
    """SELECT id, retailer_slug AS slug, coalesce(lag(fingerprint_raw) OVER w, '') = '' OR fingerprint_raw IS DISTINCT FROM lag(fingerprint_raw) OVER w AS changed
       FROM scrape_runs WINDOW w AS (PARTITION BY retailer_slug ORDER BY started_at, id)""",
)
def stream_change_detection(t):
    work = run_folder(t.spark, "changes")
    probes = _stream(t, "orders", "scrape_runs").select(
        F.col("retailer_slug").alias("slug"), "id", F.col("started_at").cast("timestamp").alias("probed_at"), "fingerprint_raw"
    )
    _finish(su.start_change_detection(probes, f"{work}/marks", f"{work}/progress"))
    return t.spark.read.parquet(f"{work}/marks").select("id", "slug", "changed")


def _cell(column: str) -> str:
    return f"""CASE WHEN regexp_matches(coalesce({column}, ''), '[\n\r",]') THEN '"' || replace({column}, '"', '""') || '"' ELSE coalesce({column}, '') END"""


@query(
    "export_events_csv",
    f"""WITH e AS (SELECT * FROM sp_events WHERE event_name = 'outbound_click' AND created_at >= {NOW} - INTERVAL 30 DAY ORDER BY created_at DESC, id DESC LIMIT 5000)
        SELECT id, regexp_replace(regexp_replace(strftime(created_at, '%Y-%m-%d %H:%M:%S.%f'), '0+$', ''), '\\.$', '') || '+00,' || concat_ws(',', {', '.join(_cell(c) for c in ev.EXPORT_COLUMNS if c != 'created_at')}) AS line FROM e""",
)
def export_events_csv(t):
    """The export is written and its lines read back; the id is found again by the line's place in the export."""
    work = run_folder(t.spark, "export")
    sinks.export_events_csv(t.sp_events, work, AS_OF, event_name="outbound_click")
    lines = t.spark.read.text(f"{work}/parts").select(F.col("value").alias("line"))
    rows = ev.events_for_export(t.sp_events, AS_OF, event_name="outbound_click")
    shown = rows.withColumn("created_at", sinks.instant_text(F.col("created_at"))).select("id", sinks.csv_line(ev.EXPORT_COLUMNS).alias("line"))
    return lines.dropDuplicates(["line"]).join(shown, "line").select("id", "line")


@query(
    "stored_events",
    """SELECT id, created_at, event_name, CAST(created_at AS DATE) AS event_date FROM sp_events""",
)
def stored_events(t):
    """The events are appended in two batches, the second of them twice, and read back."""
    stored = read_events(t.spark, _event_store(t))
    return stored.select(F.col("id").cast("bigint").alias("id"), "created_at", "event_name", "event_date")


def _event_store(t) -> str:
    path = f"{run_folder(t.spark, 'store')}/events"
    for batch, rest in ((0, 0), (1, 1), (1, 1)):
        rows = t.sp_events.filter(F.col("id") % 2 == rest).withColumn("id", F.col("id").cast("string"))
        event_store.append_events(rows.withColumn("created_at", F.col("created_at").cast("timestamp")), path, batch)
    return path


def _plain(events):
    """Ids and times as the SQL has them."""
    return events.withColumn("id", F.col("id").cast("bigint")).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


@query("read_events_stored", "SELECT *, CAST(created_at AS DATE) AS event_date FROM sp_events")
def read_events_stored(t):
    """All columns of the stored events, after their days are folded."""
    path = _event_store(t)
    event_store.compact(t.spark, path, most=1)
    return _plain(read_events(t.spark, path))


# Ids are stored as text, so ties of one instant stand in the order of text.
@query(
    "recent_stored_events",
    f"SELECT id, {', '.join(ev.EXPORT_COLUMNS)} FROM sp_events ORDER BY created_at DESC, CAST(id AS VARCHAR) DESC LIMIT 500",
)
def recent_stored_events(t):
    return _plain(event_store.recent_stored_events(t.spark, _event_store(t), limit=500))


@query(
    "read_scrape_runs",
    """SELECT id, run_id, retailer_slug AS slug, status, 'm' AS message, fingerprint_raw AS fingerprint, CAST(NULL AS VARCHAR) AS embed_url, CAST(NULL AS VARCHAR) AS pdf_url,
         scraped_data, started_at, finished_at FROM scrape_runs""",
)
def scrape_runs(t):
    """The run log written as a stored table and read by its schema."""
    path = run_folder(t.spark, "runs")
    void = F.lit(None).cast("string")
    t.scrape_runs.select(
        "id", "run_id", F.col("retailer_slug").alias("slug"), "status", F.lit("m").alias("message"), F.col("fingerprint_raw").alias("fingerprint"),
        void.alias("embed_url"), void.alias("pdf_url"), "scraped_data", *[F.col(c).cast("timestamp").alias(c) for c in ("started_at", "finished_at")],
    ).write.parquet(path)
    stored = read_scrape_runs(t.spark, path)
    return stored.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started_at", "finished_at")})


@query(
    "read_fingerprints",
    """SELECT slug, fingerprint, updated_at FROM (SELECT retailer_slug AS slug, sha256(fingerprint_raw) AS fingerprint, finished_at AS updated_at,
         row_number() OVER (PARTITION BY retailer_slug ORDER BY finished_at DESC, coalesce(sha256(fingerprint_raw), '') DESC) AS n FROM scrape_runs) WHERE n = 1""",
)
def fingerprints(t):
    """The latest fingerprint per retailer, stored and read by its schema."""
    path = run_folder(t.spark, "fingerprints")
    void = F.lit(None).cast("string")
    scraped = t.scrape_runs.select(
        F.col("retailer_slug").alias("slug"), ch.fingerprint_hash(F.col("fingerprint_raw")).alias("fingerprint"), F.lit("html").alias("source"), void.alias("embed_url"),
        void.alias("pdf_url"), F.col("finished_at").cast("timestamp").alias("updated_at"),
    )
    ch.upsert_fingerprints(None, scraped).write.parquet(path)
    return read_fingerprints(t.spark, path).select("slug", "fingerprint", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"))


# The latest of two writes of all documents; the second changes nothing but a third of them.
@query(
    "write_folder_docs",
    """SELECT slug, CASE WHEN CAST(substr(slug, 2) AS INTEGER) % 3 = 0 THEN replace(raw, '"title":"G"', '"title":"H"') ELSE raw END AS raw,
         CASE WHEN CAST(substr(slug, 2) AS INTEGER) % 3 = 0 THEN 1 ELSE 0 END AS version FROM folder_docs WHERE raw LIKE '%"id":"b"%'""",
)
def write_folder_docs(t):
    path = run_folder(t.spark, "documents")
    third = F.substring("slug", 2, 9).cast("int") % 3 == 0
    later = F.when(third, F.replace(F.col("raw"), F.lit('"title":"G"'), F.lit('"title":"H"'))).otherwise(F.regexp_replace("raw", '"scrapedAt":"[^"]*"', '"scrapedAt":"2025"'))
    for raw in (F.col("raw"), later):
        docs = parse_docs(t.folder_docs.select("slug", raw.alias("raw")))
        sinks.write_folder_docs(docs.withColumn("changed", F.lit(True)), path)
    stored = read_folder_docs(t.spark, path, layout="written")
    version = t.spark.read.parquet(f"{path}/documents").groupBy("slug").agg(F.max("version").cast("int").alias("version"))
    return stored.join(version, "slug")
