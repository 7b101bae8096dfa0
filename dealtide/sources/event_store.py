"""Events stored by day in numbered batches: each batch once, small files folded, the newest found without a scan.

Files lie at ``event_date=…/compacted=…/batch=…``. A batch counts once its mark below ``_batches`` is there. Folding a day writes
its batches as one and then marks the fold; from that mark on readers take the fold in place of what it holds. Readers
open the folders that count and no others, so half a batch, half a fold and folded files are never seen.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.events import recent_events
from ..params import clamp_int
from ..streaming.folders import create, exists, listed, remove

MARKS = "_batches"
_FOLDER = re.compile(r"event_date=([0-9-]+)/compacted=([01])/batch=(\d+)$")
_FOLD = re.compile(r"fold=([0-9-]+)_(\d+)$")


def is_store(spark: SparkSession, path: str) -> bool:
    return exists(spark, f"{path}/{MARKS}")


def stored_events(events: DataFrame) -> DataFrame:
    """Events as stored rows: an id of their own, as text, the time of arrival where they have none, their day."""
    rows = events
    if "created_at" not in rows.columns:
        rows = rows.withColumn("created_at", F.current_timestamp())
    if "id" not in rows.columns:
        rows = rows.withColumn("id", F.expr("uuid()"))
    return rows.withColumn("id", F.col("id").cast("string")).withColumn("event_date", F.to_date("created_at"))


def _folds(spark: SparkSession, path: str) -> dict[str, int]:
    """The newest batch folded into each folded day."""
    found: dict[str, int] = {}
    for mark in listed(spark, f"{path}/{MARKS}/fold=*"):
        day, batch = _FOLD.search(mark).groups()
        found[day] = max(found.get(day, -1), int(batch))
    return found


def folders(spark: SparkSession, path: str) -> dict[str, list[tuple[int, int, str]]]:
    """Of each day the folders that count: (compacted, batch, path). From names alone."""
    marked = {int(mark.rsplit("=", 1)[1]) for mark in listed(spark, f"{path}/{MARKS}/batch=*")}
    folds, found = _folds(spark, path), {}
    for folder in listed(spark, f"{path}/event_date=*/compacted=*/batch=*"):
        day, compacted, batch = _FOLDER.search(folder).groups()
        compacted, batch, fold = int(compacted), int(batch), folds.get(day, -1)
        if batch == fold if compacted else batch in marked and batch > fold:
            found.setdefault(day, []).append((compacted, batch, folder))
    return found


def next_batch(spark: SparkSession, path: str) -> int:
    return 1 + max([int(mark.rsplit("=", 1)[1]) for mark in listed(spark, f"{path}/{MARKS}/batch=*")], default=-1)


def append_events(events: DataFrame, path: str, batch: int | None = None) -> bool:
    """``events`` as batch number ``batch``, or as the next one; False if that batch is stored already.

    Batches of one store are added one after another, in ascending order. Files have about the advisory partition size: AQE
    splits large days and joins small ones.
    """
    spark = events.sparkSession
    batch = next_batch(spark, path) if batch is None else batch
    if exists(spark, f"{path}/{MARKS}/batch={batch}"):
        return False
    late = [day for day, fold in _folds(spark, path).items() if fold >= batch]
    if late:
        raise ValueError(f"batch {batch} comes after a fold of later ones: {late[:3]}")
    for left in listed(spark, f"{path}/event_date=*/compacted=0/batch={batch}"):
        remove(spark, left)
    rows = stored_events(events).withColumn("compacted", F.lit(0)).withColumn("batch", F.lit(batch))
    _written(rows, path)
    create(spark, f"{path}/{MARKS}/batch={batch}")
    return True


def _written(rows: DataFrame, path: str) -> None:
    keys = ["event_date", "compacted", "batch"]
    rows.hint("rebalance", *keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def _read(spark: SparkSession, path: str, paths: list[str], schema: str | None = None) -> DataFrame:
    kind = f"{schema or schemas.EVENTS}, event_date date, compacted int, batch bigint"
    if not paths:
        return spark.createDataFrame([], kind)
    return spark.read.schema(kind).option("basePath", path).parquet(*paths)


def read_store(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The stored events with their ``event_date``; a filter on it prunes whole days."""
    paths = [folder for parts in folders(spark, path).values() for _, _, folder in parts]
    return _read(spark, path, paths, schema).drop("compacted", "batch")


def compact(spark: SparkSession, path: str, most: int = 4, schema: str | None = None) -> list[str]:
    """Fold each day that has more than ``most`` batches into one; the days it has folded. Reads and writes those days only."""
    days = {day: parts for day, parts in folders(spark, path).items() if len(parts) > most}
    if not days:
        return []
    newest = {day: max(batch for _, batch, _ in parts) for day, parts in days.items()}
    batch = F.lit(None).cast("bigint")
    for day, number in newest.items():
        batch = F.when(F.col("event_date") == F.lit(day).cast("date"), F.lit(number)).otherwise(batch)
    rows = _read(spark, path, [folder for parts in days.values() for _, _, folder in parts], schema)
    _written(rows.withColumn("batch", batch.cast("bigint")).withColumn("compacted", F.lit(1)), path)
    for day, number in newest.items():
        create(spark, f"{path}/{MARKS}/fold={day}_{number}")
        for compacted, old, folder in days[day]:
            if (compacted, old) != (1, number):
                remove(spark, folder)
    return sorted(days)


def recent_stored_events(spark: SparkSession, path: str, limit=100) -> DataFrame:
    """``recent_events`` of a store, from as few of its newest days as hold ``limit`` events.

    The number of days doubles until they hold enough; days are known from folder names and rows counted from file footers.
    """
    held = folders(spark, path)
    days, most, taken = sorted(held, reverse=True), clamp_int(limit, 100, 1), 1
    while True:
        rows = _read(spark, path, [folder for day in days[:taken] for _, _, folder in held[day]])
        if taken >= len(days) or rows.count() >= most:
            return recent_events(rows, most)
        taken *= 2
