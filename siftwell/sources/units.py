"""Ownership units: overlapping ranges of a byte source, each match owned by the unit that holds its start."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def units(sources: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """``sources(source_id, size)`` as unit, scan_start, scan_end, own_start, own_end.

    A unit scans ``chunk`` bytes and owns them up to where the next one starts; the last owns all it
    scans, so no unit lies wholly within the overlap of the one before. Empty sources have no unit.
    """
    step = chunk - overlap
    if step <= 0:
        raise ValueError("the overlap must be smaller than the chunk")
    u = sources.where("size > 0").withColumn("scan_start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(step).cast("long"))))
    u = u.where((F.col("scan_start") == 0) | (F.col("scan_start") + overlap < F.col("size")))
    end = F.least(F.col("scan_start") + chunk, F.col("size"))
    own = F.when(end >= F.col("size"), F.col("size")).otherwise(F.least(F.col("scan_start") + step, F.col("size")))
    return u.withColumns({"scan_end": end, "own_start": F.col("scan_start"), "own_end": own, "unit": F.floor(F.col("scan_start") / step)})
