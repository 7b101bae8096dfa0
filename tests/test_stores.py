"""Event and document stores: batches once, folds, crashes in between, and what a read opens; streams with late and repeated data."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from dealtide.operators import changes
from dealtide.operators.events import recent_events
from dealtide.sources import document_store as ds
from dealtide.sources import event_store as es
from dealtide.sources.documents import read_folder_docs
from dealtide.sources.sinks import export_events_csv, write_folder_docs
from dealtide.sources.tables import read_events
from dealtide.streaming import events as se
from dealtide.streaming import upserts as su

EVENT = "id string, created_at timestamp, event_name string, path string, retailer string, destination_url string, utm_source string, utm_medium string, utm_campaign string, utm_content string, user_agent string, referrer string"


def events(spark, numbers):
    rows = [(f"{n:04d}", dt.datetime(2024, 1, 1) + dt.timedelta(hours=5 * n), "outbound_click", "/p", None, None, None, None, None, "line\nend" if n == 3 else f"post-{n}", "u", None) for n in numbers]
    return spark.createDataFrame(rows, EVENT)


def ids(frame):
    return sorted(r.id for r in frame.select("id").collect())


def test_batches_and_folds(spark, tmp_path):
    path = str(tmp_path / "ev")
    for n in range(4):
        assert es.append_events(events(spark, range(n, 40, 4)), path, n)
    assert not es.append_events(events(spark, range(99)), path, 2)
    want = [f"{n:04d}" for n in range(40)]
    assert ids(read_events(spark, path)) == want and len(read_events(spark, path).columns) == 13
    folded = es.compact(spark, path, most=2)
    assert folded and ids(read_events(spark, path)) == want
    assert {len(es.folders(spark, path)[day]) for day in folded} == {1} and es.compact(spark, path, most=2) == []
    es.append_events(events(spark, range(100, 110)), path)
    assert ids(read_events(spark, path)) == want + [f"{n:04d}" for n in range(100, 110)]
    with pytest.raises(ValueError):
        es.remove(spark, f"{path}/{es.MARKS}/batch=1")
        es.append_events(events(spark, [1]), path, 1)


def test_stopped_writes(spark, tmp_path, monkeypatch):
    path, want = str(tmp_path / "ev"), [f"{n:04d}" for n in range(20)]
    for n in range(2):
        es.append_events(events(spark, range(n, 20, 2)), path, n)
    monkeypatch.setattr(es, "create", lambda *a: (_ for _ in ()).throw(OSError("stopped")))
    for stopped in (lambda: es.append_events(events(spark, range(50, 60)), path, 2), lambda: es.compact(spark, path, most=1)):
        with pytest.raises(OSError):
            stopped()
        assert ids(read_events(spark, path)) == want  # neither half a batch nor half a fold is seen
    monkeypatch.undo()
    monkeypatch.setattr(es, "remove", lambda *a: None)
    assert es.compact(spark, path, most=1) and ids(read_events(spark, path)) == want  # folded files still there
    monkeypatch.undo()
    es.append_events(events(spark, range(50, 52)), path, 2)  # comes again with other rows
    assert ids(read_events(spark, path)) == want + ["0050", "0051"]


def test_newest_days(spark, tmp_path):
    path = str(tmp_path / "ev")
    es.append_events(events(spark, range(400)), path, 0)
    for limit in (1, 7, 50, 1000):
        got = es.recent_stored_events(spark, path, limit)
        assert [r.id for r in got.collect()] == [r.id for r in recent_events(read_events(spark, path), limit).collect()]
    opened = es.recent_stored_events(spark, path, 7).inputFiles()
    assert opened and all("event_date=2024-03" in file for file in opened) and len(opened) < 5
    empty = str(tmp_path / "none")
    es.append_events(events(spark, []), empty, 0)
    assert es.recent_stored_events(spark, empty, 5).count() == 0 and read_events(spark, empty).count() == 0


def test_export_in_order(spark, tmp_path):
    export_events_csv(events(spark, range(60)), str(tmp_path), "2024-01-20", limit=50_000)
    text = "".join(p.read_text() for p in sorted((tmp_path / "parts").glob("part-*")))
    times = [line[:19] for line in text.split("\n") if line.startswith("2024")]
    assert times == sorted(times, reverse=True) and len(times) == 60 and '"line\nend"' in text
    assert spark.read.json(str(tmp_path / "manifest")).first().rows == 60


def doc(title, at="2024"):
    return json.dumps({"retailer": "r", "folders": [{"id": "1", "title": title, "scrapedAt": at}], "deals": [], "scrapedAt": at})


def test_documents(spark, tmp_path):
    path = str(tmp_path / "docs")
    frame = lambda rows: spark.createDataFrame(rows, "slug string, raw string")
    assert ds.write_documents(frame([("007", doc("A")), ("b", doc("B")), ("bad", "{")]), path, 0)
    assert not ds.write_documents(frame([("007", doc("Z"))]), path, 0)
    second = frame([("007", doc("A", "2025")), ("b", doc("C")), ("c", doc("D")), ("bad", "{")])
    assert sorted(r.slug for r in ds.changed_documents(second, path).collect()) == ["b", "c"]
    plan = ds.changed_documents(second, path)._jdf.queryExecution().executedPlan().toString()
    assert "/digests" in plan and "/documents" not in plan
    ds.write_documents(second, path)
    got = {r.slug: r.raw for r in read_folder_docs(spark, path, layout="written").collect()}
    assert got == {"007": doc("A"), "b": doc("C"), "c": doc("D"), "bad": "{"}
    assert len([p for p in (tmp_path / "docs" / "documents").iterdir() if p.name.startswith("bucket")]) <= ds.BUCKETS
    none = frame([]).selectExpr("*", "CAST(NULL AS array<string>) AS folders", "CAST(NULL AS array<string>) AS deals", "true AS changed")
    write_folder_docs(none, path)
    assert read_folder_docs(spark, path, layout="written").count() == 4


def stream(spark, folder, schema, *parts):
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_late_rows_and_a_repeated_batch(spark, tmp_path):
    at = lambda d, h=0: dt.datetime(2024, 1, d, h)
    schema = "event_name string, created_at timestamp"
    parts = [[("a", at(1)), ("a", at(9))], [("a", at(9, 5)), ("b", at(8))], [("a", at(1, 3)), ("a", at(9, 7)), ("b", at(7))], [("b", at(10))]]
    out = str(tmp_path / "out")
    se.start_daily_counts(stream(spark, tmp_path / "in", schema, *parts), "3 days", out, str(tmp_path / "cp")).awaitTermination()
    got = {(r.day, r.event_name): r["count"] for r in se.read_daily_counts(spark, out).collect()}
    # the third file's first row is eight days behind and is dropped
    assert got == {("2024-01-01", "a"): 1, ("2024-01-09", "a"): 3, ("2024-01-08", "b"): 1, ("2024-01-07", "b"): 1, ("2024-01-10", "b"): 1}
    held = spark.read.parquet(out).groupBy("batch").count().collect()
    assert len(held) >= 4 and max(r["count"] for r in held) <= 2  # a batch writes what it has changed
    last = spark.read.parquet(out).filter("batch = 1").drop("batch").collect()
    again = spark.createDataFrame(last, "day string, event_name string, count bigint").withColumn("batch", F.lit(1))
    again.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)
    assert {(r.day, r.event_name): r["count"] for r in se.read_daily_counts(spark, out).collect()} == got


def test_changes_with_missing_fingerprints(spark, tmp_path):
    schema = "slug string, id bigint, probed_at timestamp, fingerprint_raw string"
    at = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)
    rows = [("a", n, at(n), ["x", None, None, "x", "x", "y"][n % 6]) for n in range(18)] + [("b", 100 + n, at(n), "z") for n in range(4)]
    marks = str(tmp_path / "marks")
    source = stream(spark, tmp_path / "in", schema, rows[:5], rows[5:8] + rows[18:20], rows[8:18] + rows[20:])
    su.start_change_detection(source, marks, str(tmp_path / "cp")).awaitTermination()
    shown = lambda frame: {r.id: (r.changed, r.fingerprint) for r in frame.collect()}
    assert shown(spark.read.parquet(marks)) == shown(changes.change_history(spark.createDataFrame(rows, schema)))
