"""Where streams keep their state and their progress."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..params import shared_folder


def work_folder(spark: SparkSession, name: str) -> str:
    """A folder for one stream below the shared folder the cluster names; without one, as in tests, below the warehouse's."""
    fallback = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/shared"
    return f"{shared_folder(spark, fallback).rstrip('/')}/dealtide/{name}"


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder of its own for a stream that is run once, from the start."""
    return work_folder(spark, f"{name}/{uuid.uuid4().hex}")


def stored_once(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` computed once, into a folder of its own, for several branches that read it; from then on Spark knows its size."""
    path = run_folder(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def create(spark: SparkSession, path: str) -> None:
    """An empty file at ``path``."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True).close()


def listed(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that match ``pattern``, in order."""
    target = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
    return sorted(str(status.getPath().toString()) for status in found or [])


def remove(spark: SparkSession, path: str) -> None:
    """Delete what this library wrote at ``path``, if it is there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def is_file(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = target.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(target)
    return status.isFile()
