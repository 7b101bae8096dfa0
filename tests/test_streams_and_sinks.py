"""Writers read back, and streams in several batches against their batch results."""

import datetime as dt
import json

from pyspark.sql import functions as F

from dealtide.operators import changes, health, products
from dealtide.sources import sinks
from dealtide.sources.documents import parse_docs, read_folder_docs
from dealtide.sources.tables import read_events, read_products
from dealtide.streaming import events as se
from dealtide.streaming import upserts as su


def test_csv_quotes_only_what_needs_it(spark, tmp_path):
    at = dt.datetime(2024, 1, 2, 3, 4, 5, 120000)
    rows = [(1, at, "e", " /p ", None, 'https://x/a,b"c', "s", None, "", "line\nend")]
    frame = spark.createDataFrame(
        rows, "id bigint, created_at timestamp, event_name string, path string, retailer string, destination_url string, utm_source string, utm_medium string, utm_campaign string, utm_content string"
    )
    sinks.export_events_csv(frame, str(tmp_path / "csv"), "2024-01-03", event_name="e")
    body = "".join(p.read_text() for p in sorted((tmp_path / "csv" / "parts").glob("part-*")))
    manifest = spark.read.json(str(tmp_path / "csv" / "manifest")).first()
    want = '2024-01-02 03:04:05.12+00,e, /p ,,"https://x/a,b""c",s,,,"line\nend"\n'
    assert body == want and (manifest.header, manifest.rows) == (",".join(sinks.EXPORT_COLUMNS), 1)
    line = sinks.export_rows(frame).select(sinks.csv_line(sinks.EXPORT_COLUMNS).alias("l")).first().l
    assert line + "\n" == want


def test_documents_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "ok.json").write_text(json.dumps({"retailer": "ok", "folders": [{"id": "1"}], "deals": []}, indent=2))
    (tmp_path / "in" / "bad.json").write_text("{")
    docs = parse_docs(read_folder_docs(spark, str(tmp_path / "in")))
    assert {r.slug: (r.is_json, r.is_valid) for r in docs.collect()} == {"ok": (True, True), "bad": (False, False)}
    out = str(tmp_path / "out")
    sinks.write_folder_docs(docs.withColumn("changed", F.lit(True)), out)
    again = parse_docs(read_folder_docs(spark, out, layout="written"))
    shown = ["slug", "raw", "is_valid", "retailer"]
    assert [tuple(r) for r in again.select(*shown).collect()] == [tuple(r) for r in docs.filter("is_valid").select(*shown).collect()]


def test_manifest(spark, tmp_path):
    docs = parse_docs(spark.createDataFrame([("a", '{"folders":[],"scrapedAt":"2024-01-01T00:00:00Z"}')], "slug string, raw string"))
    log = spark.createDataFrame([("r", "a", 1, True, None), ("r", "b", 1, False, "x")], "run_id string, slug string, attempt int, ok boolean, error string")
    results = health.run_status(log, docs, "2024-01-02")
    probes = spark.createDataFrame([], "slug string, url string, place int, status int, live boolean")
    entries = health.health_entries(results, docs, probes)
    sinks.write_health_manifest(entries, str(tmp_path), "2024-01-02T00:00:00Z")
    summary = spark.read.json(str(tmp_path / "summary")).first().summary
    assert (summary.total, summary.fresh, summary.missing, summary.with_errors) == (2, 1, 1, 1)
    assert spark.read.json(str(tmp_path / "retailers")).count() == 2


def test_append_events_prunes_days(spark, tmp_path):
    rows = [("e", dt.datetime(2024, 1, 1 + n, 12)) for n in range(3)]
    frame = spark.createDataFrame(rows, "event_name string, created_at timestamp")
    sinks.append_events(frame, str(tmp_path / "ev"))
    sinks.append_events(frame, str(tmp_path / "ev"))
    stored = read_events(spark, str(tmp_path / "ev"))
    assert stored.count() == 6 and stored.select("id").distinct().count() == 6
    assert stored.filter("event_date = DATE '2024-01-02'").count() == 2


def batches(spark, folder, schema, *parts):
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_daily_counts_in_batches(spark, tmp_path):
    t = lambda d, h: dt.datetime(2024, 1, d, h)
    parts = [[("a", t(1, 1)), ("b", t(1, 2))], [("a", t(2, 3)), ("a", t(1, 23))], [("b", t(3, 0)), ("a", t(2, 1))]]
    stream = batches(spark, tmp_path / "in", "event_name string, created_at timestamp", *parts)
    out = str(tmp_path / "out")
    se.start_daily_counts(stream, "3 days", out, str(tmp_path / "cp")).awaitTermination()
    got = {(r.day, r.event_name): r["count"] for r in se.read_daily_counts(spark, out).collect()}
    assert got == {("2024-01-01", "a"): 2, ("2024-01-01", "b"): 1, ("2024-01-02", "a"): 2, ("2024-01-03", "b"): 1}


def test_dedupe_across_batches(spark, tmp_path):
    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    parts = [[("v", "k", t(0)), ("v", "k", t(1))], [("v", "k", t(2)), ("v", "m", t(2))], [("w", "k", t(3)), ("v", "m", t(3))]]
    stream = batches(spark, tmp_path / "in", "view_id string, event_key string, ts timestamp", *parts)
    out = str(tmp_path / "out")
    se.start_dedupe(stream, "1 hour", out, str(tmp_path / "cp")).awaitTermination()
    assert sorted((r.view_id, r.event_key) for r in spark.read.parquet(out).collect()) == [("v", "k"), ("v", "m"), ("w", "k")]


def test_product_stream_equals_batch(spark, tmp_path):
    schema = "retailer_slug string, product string, original_price double, promo_price double, discount string, vertical string, valid_from date, valid_until date, scraped_at timestamp, seq bigint"
    day = lambda n: dt.date(2024, 1, n)
    row = lambda product, start, price, seq: ("s", product, price, 1.0, None, "general", day(start), day(start + 6), dt.datetime(2024, 1, 1), seq)
    parts = [[row("A", 1, 5.0, 1), row("B", 8, 5.0, 2)], [row("A", 1, 6.0, 3), row("C", 1, 5.0, 4)], [row("A", 1, 7.0, 5)]]
    stream = batches(spark, tmp_path / "in", schema, *parts)
    table = str(tmp_path / "table")
    su.start_product_upserts(stream, table, str(tmp_path / "cp"), "2024-01-01").awaitTermination()
    want = products.upsert_products(None, products.product_rows(spark.read.schema(schema).parquet(str(tmp_path / "in")), "2024-01-01"))
    shown = ["id", "product_name", "original_price", "promo_price", "year", "week_number"]
    got = sorted(map(tuple, read_products(spark, table).select(*shown).collect()))
    assert got == sorted(map(tuple, want.select(*shown).collect())) and len(got) == 3
    # A batch that is run again changes nothing.
    again = spark.createDataFrame(parts[2], schema)
    su.upsert_products_batch(again, 2, table, "2024-01-01")
    assert sorted(map(tuple, read_products(spark, table).select(*shown).collect())) == got


def test_change_stream_with_tied_times(spark, tmp_path):
    """Several probes of one retailer at one time, within a batch and across batches, in any order of values."""
    schema = "slug string, id bigint, probed_at timestamp, fingerprint_raw string"
    at = dt.datetime(2024, 1, 1)
    rows = [("a", 1, at, "v2"), ("a", 2, at, "v1"), ("b", 3, at, "v1"), ("b", 4, at, "v2"), ("a", 5, at, "v1"), ("b", 6, at, "v1"), ("b", 7, at, "v1")]
    stream = batches(spark, tmp_path / "in", schema, rows[:4], rows[4:6], rows[6:])
    su.start_change_detection(stream, str(tmp_path / "marks"), str(tmp_path / "cp")).awaitTermination()
    got = {r.id: r.changed for r in spark.read.parquet(str(tmp_path / "marks")).collect()}
    want = {r.id: r.changed for r in changes.change_history(spark.createDataFrame(rows, schema)).collect()}
    assert got == want and got[5] is False


def test_change_stream_equals_batch(spark, tmp_path):
    schema = "slug string, id bigint, probed_at timestamp, fingerprint_raw string"
    rows = [("a" if n % 3 else "b", n, dt.datetime(2024, 1, 1) + dt.timedelta(days=9 * n), "xxyy"[n % 4]) for n in range(12)]
    stream = batches(spark, tmp_path / "in", schema, rows[:4], rows[4:8], rows[8:])
    marks = str(tmp_path / "marks")
    su.start_change_detection(stream, marks, str(tmp_path / "cp")).awaitTermination()
    got = {r.id: r.changed for r in spark.read.parquet(marks).collect()}
    want = {r.id: r.changed for r in changes.change_history(spark.createDataFrame(rows, schema)).collect()}
    assert got == want and len(got) == 12
