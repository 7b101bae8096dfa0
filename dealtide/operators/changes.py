"""Change detection by fingerprint and by document, and the run log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.skew import salted_join
from ..functions.text import present

RUN_FIELDS = ["status", "message", "fingerprint", "embed_url", "pdf_url", "scraped_data"]
# The states of a run; the last three end it.
RUN_STATES = ["started", "change_detected", "no_change", "scrape_success", "error"]
FINAL_STATES = ["no_change", "scrape_success", "error"]


def fingerprint_hash(raw: Column) -> Column:
    return F.sha2(raw, 256)


def detect_changes(probes: DataFrame, state: DataFrame) -> DataFrame:
    """Probed fingerprints against the stored ones; no stored value counts as a change.

    ``probes``: slug, id, fingerprint_raw and more; ``state``: one row per slug with its stored hash.
    """
    stored = state.select("slug", F.col("fingerprint").alias("stored"))
    hashed = probes.withColumn("fingerprint", fingerprint_hash(F.col("fingerprint_raw")))
    joined = salted_join(hashed, stored, ["slug"], ["fingerprint_raw", "id"], "left")
    known = F.coalesce(present(F.col("stored")), F.lit(False))
    return joined.withColumn("changed", ~known | ~F.col("fingerprint").eqNullSafe(F.col("stored"))).drop("stored")


def change_history(probes: DataFrame) -> DataFrame:
    """Which probes of a history differ from the one before them of the same retailer.

    ``probes``: slug, probed_at, id, fingerprint_raw. The history of one retailer is cut by day, so no
    task holds more than a day of it; the last value of each day is carried into the next one through a
    table of one row per retailer and day.
    """
    rows = probes.withColumn("fingerprint", fingerprint_hash(F.col("fingerprint_raw"))).withColumn(
        "_day", F.to_date("probed_at")
    )
    turn = F.struct("probed_at", "id")
    ends = rows.groupBy("slug", "_day").agg(F.max_by(F.struct("fingerprint"), turn).alias("end"))
    carried = ends.withColumn("carry", F.lag("end").over(Window.partitionBy("slug").orderBy("_day"))).select(
        "slug", "_day", "carry"
    )
    inside = F.lag(F.struct("fingerprint")).over(Window.partitionBy("slug", "_day").orderBy("probed_at", "id"))
    before = F.coalesce(F.col("inside"), F.col("carry"))["fingerprint"]
    known = F.coalesce(present(before), F.lit(False))
    return (
        rows.withColumn("inside", inside)
        .join(carried, ["slug", "_day"], "left")
        .withColumn("changed", ~known | ~F.col("fingerprint").eqNullSafe(before))
        .drop("inside", "carry", "_day")
    )


def upsert_fingerprints(state: DataFrame | None, scraped: DataFrame) -> DataFrame:
    """The stored fingerprints after the good scrapes of ``scraped``: the latest row per retailer."""
    columns = ["slug", "fingerprint", "source", "embed_url", "pdf_url", "updated_at"]
    rows = scraped.select(*columns)
    if state is not None:
        rows = state.select(*columns).unionAll(rows)
    # all columns take part, so rows that tie in time and fingerprint still give one result
    order = F.struct("updated_at", *[F.coalesce(c, F.lit("")) for c in ("fingerprint", "pdf_url", "embed_url", "source")])
    latest = rows.groupBy("slug").agg(F.max_by(F.struct(*columns[1:]), order).alias("s"))
    return latest.select("slug", "s.*")


def run_log(events: DataFrame) -> DataFrame:
    """Run rows from their updates. The last update sets every field, absent ones to null; the first one
    sets the start and a final one the end.

    ``events``: id, run_id, slug, seq, at and the run fields.
    """
    final = F.col("status").isin(FINAL_STATES)
    runs = events.groupBy("id").agg(
        F.min_by(F.struct("run_id", "slug", F.col("at").alias("started_at")), F.col("seq")).alias("first"),
        F.max_by(F.struct(*RUN_FIELDS), F.col("seq")).alias("last"),
        F.max_by(F.when(final, F.col("at")), F.when(final, F.col("seq"))).alias("finished_at"),
    )
    return runs.select("id", "first.*", "last.*", "finished_at")


def last_successful_scrape(runs: DataFrame) -> DataFrame:
    """The data of the newest successful run that has any, per retailer."""
    good = runs.filter((F.col("status") == "scrape_success") & F.col("scraped_data").isNotNull())
    newest = good.groupBy("slug").agg(
        F.max_by(F.struct("scraped_data", "finished_at", "id"), F.struct("finished_at", "id")).alias("r")
    )
    return newest.select("slug", "r.*")


def restore_missing_docs(docs: DataFrame, runs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Documents after a monitor round: after an error the last good data replace whatever is there, after
    an unchanged probe they fill in for a missing document.

    ``docs``: slug, raw; ``outcomes``: slug, outcome (one row per retailer).
    """
    good = last_successful_scrape(runs).select("slug", F.col("scraped_data").alias("_good"))
    joined = outcomes.join(docs.select("slug", "raw"), "slug", "left").join(good, "slug", "left")
    use = F.when(F.col("outcome") == "error", F.coalesce("_good", "raw")).when(
        F.col("outcome") == "unchanged", F.coalesce("raw", "_good")
    ).otherwise(F.col("raw"))
    restored = F.col("_good").isNotNull() & (
        (F.col("outcome") == "error") | ((F.col("outcome") == "unchanged") & F.col("raw").isNull())
    )
    return joined.select("slug", "outcome", use.alias("raw"), restored.alias("restored"))


def document_digest(raw: Column) -> Column:
    """Hash of a document without its scrape times; null if it is not JSON."""
    doc = F.try_parse_json(raw)

    def part(path: str) -> Column:
        return F.coalesce(F.to_json(F.try_variant_get(doc, path, "variant")), F.lit(""))

    def folder(value: Column) -> Column:
        fields = F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))
        named = F.filter(fields, lambda f: f["key"] != "scrapedAt")
        return F.array_join(
            F.array_sort(F.transform(named, lambda f: F.concat(f["key"], F.lit("="), F.coalesce(F.to_json(f["value"]), F.lit("null"))))), "\x01"
        )

    folders = F.array_join(F.transform(F.try_variant_get(doc, "$.folders", "array<variant>"), folder), "\x02")
    parts = [part("$.retailer"), part("$.sourceUrls"), part("$.methods"), F.coalesce(folders, F.lit("")), part("$.deals")]
    return F.when(doc.isNotNull(), F.sha2(F.concat_ws("\x03", *parts), 256))


def doc_changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """New documents (slug, raw) with whether they differ from the stored ones in more than scrape times."""
    before = old.select("slug", document_digest(F.col("raw")).alias("_before"))
    after = new.withColumn("_after", document_digest(F.col("raw")))
    joined = after.join(before, "slug", "left")
    return joined.withColumn("changed", F.col("_before").isNull() | ~F.col("_after").eqNullSafe(F.col("_before"))).drop(
        "_before", "_after"
    )
