"""Leaflet documents in a store of versions: buckets by slug, with a list of digests that tells what has changed.

Documents lie at ``documents/bucket=…/version=…``, their digests at ``digests/…`` likewise. Writing compares digests, which are a few bytes a
document, and adds the documents that differ as a new version; stored texts are not read. A version counts once its mark below
``_versions`` is there. Of each slug the newest version counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.changes import document_digest
from ..streaming.folders import create, exists, listed, remove

MARKS = "_versions"
BUCKETS = 16
TEXTS, DIGESTS = "slug string, raw string, bucket int, version bigint", "slug string, digest string, bucket int, version bigint"


def is_store(spark: SparkSession, path: str) -> bool:
    return exists(spark, f"{path}/{MARKS}")


def _versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(mark.rsplit("=", 1)[1]) for mark in listed(spark, f"{path}/{MARKS}/version=*"))


def _newest(spark: SparkSession, path: str, part: str, schema: str) -> DataFrame:
    """Of each slug the row of its newest version that counts; Spark cuts each map partition to one row per slug first."""
    counted = _versions(spark, path)
    if not counted or not exists(spark, f"{path}/{part}"):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(f"{path}/{part}").filter(F.col("version").isin(counted))
    last = F.row_number().over(Window.partitionBy("slug").orderBy(F.desc("version")))
    return rows.withColumn("_n", last).filter("_n = 1").drop("_n")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(slug, raw) of the stored documents."""
    return _newest(spark, path, "documents", TEXTS).select("slug", "raw")


def changed_documents(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` (slug, raw) that differ from the stored ones in more than scrape times, with their ``digest``."""
    stored = _newest(docs.sparkSession, path, "digests", DIGESTS).select(F.col("slug").alias("_slug"), F.col("digest").alias("_digest"))
    marked = docs.select("slug", "raw", document_digest(F.col("raw")).alias("digest"))
    joined = marked.join(stored, marked["slug"] == stored["_slug"], "left")
    return joined.filter(F.col("_slug").isNull() | ~F.col("digest").eqNullSafe(F.col("_digest"))).select("slug", "raw", "digest")


def write_documents(docs: DataFrame, path: str, version: int | None = None, buckets: int = BUCKETS) -> bool:
    """The documents of ``docs`` (slug, raw) that have changed, as ``version`` or as the next one; False if it is stored already.

    A slug stands once in ``docs``. Both parts are written before the version is marked; what a stopped run left is replaced.
    """
    spark = docs.sparkSession
    counted = _versions(spark, path)
    version = 1 + max(counted, default=-1) if version is None else version
    if version in counted:
        return False
    for left in listed(spark, f"{path}/*/bucket=*/version={version}"):
        remove(spark, left)
    keys = ["bucket", "version"]
    rows = changed_documents(docs, path).withColumn("bucket", F.pmod(F.xxhash64("slug"), F.lit(buckets)).cast("int")).withColumn("version", F.lit(version))

    def write(frame: DataFrame, part: str) -> None:
        frame.hint("rebalance", *keys).write.mode("append").partitionBy(*keys).parquet(f"{path}/{part}")

    write(rows.drop("digest"), "documents")
    added = spark.read.schema(TEXTS).parquet(f"{path}/documents").filter(F.col("version") == version)
    write(added.select("slug", document_digest(F.col("raw")).alias("digest"), *keys), "digests")
    create(spark, f"{path}/{MARKS}/version={version}")
    return True
