"""Scans that go on where they stopped, and scans of files as they arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scan import scan, text_units


def remaining(units: DataFrame, done: DataFrame, keys: Sequence[str] = ("source_id", "scan_start")) -> DataFrame:
    """Units that aren't done, before any of their bytes are read."""
    return units.join(done.select(*keys).distinct(), list(keys), "left_anti")


def scan_step(units: DataFrame, patterns: Sequence[tuple[str, bytes]], folder: str) -> None:
    """Scan the units that ``folder`` doesn't hold yet, and append their hits, then the units.

    A step that dies between the two leaves hits of units that don't count as done; ``results`` leaves
    out repeats, so a second run of the same units changes nothing.
    """
    spark = units.sparkSession
    left = remaining(units, done(spark, folder)) if _exists(spark, f"{folder}/done") else units
    scan(left, patterns).write.mode("append").parquet(f"{folder}/hits")
    left.select("source_id", "scan_start", "own_end").write.mode("append").parquet(f"{folder}/done")


def done(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/done")


def results(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/hits").distinct()


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def watch(spark: SparkSession, folder: str, schema: str, key: str, text: str, patterns: Sequence[tuple[str, bytes]], out: str, checkpoint: str) -> StreamingQuery:
    """Scan the Parquet files that arrive in ``folder``; hits are appended to ``out``, each file's once."""
    rows = spark.readStream.schema(schema).parquet(folder)
    hits = scan(text_units(rows, key, F.col(text)), patterns)
    return hits.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def counts_by_window(events: DataFrame, gap: str, late: str) -> DataFrame:
    """Sessions of each user's events in a stream: a session ends ``gap`` after its last event; events up to ``late`` late count."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("session")).agg(F.count("*").alias("events"), F.min("ts").alias("first"), F.max("ts").alias("last"))


__all__ = ["counts_by_window", "done", "remaining", "results", "scan_step", "watch"]
