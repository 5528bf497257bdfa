"""Reports: findings written as JSON lines in a total order, and read back as a source.

Only columns that are named leave the library, so nothing that a kernel keeps to itself can reach a report. Spark's
commit protocol makes a report appear whole or not at all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def write(findings: DataFrame, path: str, allowed: Sequence[str], order: Sequence[str]) -> StructType:
    """Write the ``allowed`` columns of ``findings`` below ``path``, ordered across files; the schema to read them by."""
    shown = findings.select(*sorted(allowed))
    shown.repartitionByRange(*order).sortWithinPartitions(*order).write.option("ignoreNullFields", False).json(path)
    return shown.schema


def read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of a report, for another look at the same places. A line that is no JSON is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def folder(files: DataFrame, findings: DataFrame) -> DataFrame:
    """A row for each of ``files(source_id, failure)``: status, findings and the places of the first and last.

    ``findings(source_id, start, end)``. A file that was skipped keeps the reason; one without findings is clean.
    """
    from pyspark.sql import functions as F

    found = findings.groupBy("source_id").agg(F.count("*").alias("findings"), F.min("start").alias("first"), F.max("end").alias("last"))
    status = F.when(F.col("failure").isNotNull(), "skipped").when(F.col("findings").isNotNull(), "found").otherwise("clean")
    out = files.select("source_id", "failure").distinct().join(found, "source_id", "left")
    return out.select("source_id", status.alias("status"), "failure", F.coalesce("findings", F.lit(0)).alias("findings"), "first", "last")
