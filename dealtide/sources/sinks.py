"""Writers: documents, health manifest, event export and the event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.events import EXPORT_COLUMNS, events_for_export
from ..operators.health import health_summary
from .document_store import write_documents
from .event_store import append_events, stored_events  # noqa: F401


def documents_to_write(docs: DataFrame) -> DataFrame:
    """Documents with any leaflet or deal that differ from the stored ones.

    ``docs``: slug, raw, folders, deals and ``changed`` (see ``doc_changed``).
    """
    content = F.coalesce(F.size("folders"), F.lit(0)) + F.coalesce(F.size("deals"), F.lit(0))
    return docs.filter((content > 0) & F.col("changed")).select("slug", "raw")


def write_folder_docs(docs: DataFrame, path: str) -> None:
    """Documents with content that have changed, into the document store at ``path``; retailers without a new document keep theirs."""
    write_documents(documents_to_write(docs), path)


def write_health_manifest(entries: DataFrame, path: str, generated_at: str) -> None:
    """The health manifest: one JSON line per retailer below ``retailers``, totals below ``summary``.

    Entries are written where they are computed; only the totals, one row, come together.
    """
    stamp = F.lit(generated_at).alias("generatedAt")
    entries.write.mode("overwrite").json(f"{path}/retailers")
    health_summary(entries).select(stamp, F.struct("*").alias("summary")).write.mode("overwrite").json(f"{path}/summary")


def instant_text(moment: Column) -> Column:
    """A UTC time as the event store prints it: no trailing zeros in the fraction, offset +00."""
    text = F.date_format(moment, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(text, r"(?:\.0+|(\.\d*?[1-9])0+)\z", "$1"), F.lit("+00"))


def export_rows(events: DataFrame) -> DataFrame:
    """The nine export columns as text."""
    shown = [instant_text(F.col(c)).alias(c) if c == "created_at" else F.col(c) for c in EXPORT_COLUMNS]
    return events.select(*shown)


def csv_line(columns: list[str]) -> Column:
    """A CSV line: a cell is quoted only if it holds a line end, a quote or a comma; null is empty."""
    def cell(name: str) -> Column:
        text = F.coalesce(F.col(name), F.lit(""))
        quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(text.rlike('[\n\r",]'), quoted).otherwise(text)

    return F.concat_ws(",", *[cell(c) for c in columns])


def export_events_csv(events: DataFrame, path: str, as_of, **filters) -> None:
    """The export of ``events_for_export`` as CSV lines, newest first over the parts below ``parts``; ``manifest`` names columns and rows.

    The rows are dealt to the parts by ranges of their order, so no task holds all of them; the header line stands in the
    manifest once, and the parts one after another are the export.
    """
    rows = events_for_export(events, as_of, **filters)
    shown = rows.withColumn("_at", F.col("created_at")).withColumn("created_at", instant_text(F.col("created_at")))
    lines = shown.orderBy(F.desc("_at"), F.desc("id")).select(csv_line(EXPORT_COLUMNS).alias("value"))
    lines.write.mode("overwrite").text(f"{path}/parts")
    header = F.lit(",".join(EXPORT_COLUMNS)).alias("header")
    events_for_export(events, as_of, **filters).agg(F.count("*").alias("rows")).select(header, "rows").write.mode("overwrite").json(f"{path}/manifest")
