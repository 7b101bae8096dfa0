"""Plans and limits: stored events are read by day, and nothing is cut that the caller did not ask for."""

import datetime as dt

import pytest

from dealtide.operators import events as ev
from dealtide.operators.changes import upsert_fingerprints
from dealtide.operators.ingest import attribution_events
from dealtide.sources.sinks import append_events
from dealtide.sources.tables import read_events

AS_OF = "2026-03-10 12:00:00"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events") / "t")
    start = dt.datetime(2024, 6, 1)
    rows = [
        (n, start + dt.timedelta(hours=7 * n), ("outbound_click", "attribution_set")[n % 2], "/p", f"r{n % 3}", None, None, None, None, f"post{n}", None, None)
        for n in range(2200)
    ]
    columns = "id long, created_at timestamp, event_name string, path string, retailer string, destination_url string, utm_source string, utm_medium string, utm_campaign string, utm_content string, user_agent string, referrer string"
    append_events(spark.createDataFrame(rows, columns), path)
    return read_events(spark, path)


@pytest.mark.parametrize("build", [
    lambda e: ev.post_funnel(e, as_of=AS_OF, days=3), lambda e: ev.daily_metrics(e, AS_OF, 3), lambda e: ev.events_for_export(e, AS_OF, days=3),
])
def test_days_are_pruned(stored, build):
    plan = build(stored)._jdf.queryExecution().executedPlan().toString()
    assert "event_date" in plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]


def test_pruning_keeps_the_window(stored):
    day = lambda days: ev.event_total_count(stored, "outbound_click", AS_OF, days=days).first()["count"]
    plain = lambda days: ev.event_total_count(stored.drop("event_date"), "outbound_click", AS_OF, days=days).first()["count"]
    assert [day(n) for n in (1, 30, 365, 5000)] == [plain(n) for n in (1, 30, 365, 5000)]
    assert day(5000) > day(365)


def test_no_hidden_ceiling(stored):
    assert ev.utm_content_metrics(stored, "outbound_click", AS_OF, days=5000, limit=5000).count() == stored.filter("event_name = 'outbound_click'").count()
    assert ev.recent_events(stored, limit=2000).count() == 2000


def test_long_payloads_are_kept(spark):
    hit = {"kind": "attribution", "ts": dt.datetime(2026, 1, 1), "cookie": "sp_cookie_consent=accepted", "url": "https://x.be/a?utm_source=" + "s" * 3000, "user_agent": "u", "referrer": "r"}
    hits = spark.createDataFrame([hit], "kind string, ts timestamp, cookie string, url string, user_agent string, referrer string")
    assert attribution_events(hits).count() >= attribution_events(hits, max_chars=1500).count() == 0


def test_tied_fingerprints_give_one_result(spark):
    columns = "slug string, fingerprint string, source string, embed_url string, pdf_url string, updated_at timestamp"
    at = dt.datetime(2026, 1, 1)
    rows = [("a", "f", "s", None, pdf, at) for pdf in ("x", "z", "y", None)]
    for order in (rows, rows[::-1]):
        assert upsert_fingerprints(None, spark.createDataFrame(order, columns).repartition(3)).first()["pdf_url"] == "z"
