"""Logical streams that lie in pieces of a source: ranges are mapped through extents, and only the bytes asked for are read.

``extents(keys, logical, physical, length)`` say where a stream's bytes are; physical is null where it is sparse. Extents
and ranges are tables like any other and meet in an equi-join on stretches, so neither goes through the driver. Bytes come
from files that all executors see (``read_files``) or from a table of blocks (``read_blocks``), as ``binaryFile`` or the
``ranged`` source give them. What can't be read is a row with its reason, and no data.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import intervals

#: Reasons, as reports have them.
GAP, CONFLICT, OUTSIDE, SHORT, CHANGED, UNREADABLE = "logical_stream_gap_or_sparse", "extent_overlap_conflict", "read_outside_image", "short_image_read", "source_changed", "source_unreadable"


def identity(path: str) -> str:
    """What tells a source from a later one at the same path: its size and time of change."""
    s = os.stat(path)
    return f"{s.st_size}:{s.st_mtime_ns}"


def pieces(ranges: DataFrame, extents: DataFrame, keys: list[str], width: int = 1 << 24) -> DataFrame:
    """keys, id, logical_start, physical_start, length and failure of what ``ranges(keys, id, start, end)`` are made of.

    A range that its stream's extents don't cover, or that meets a sparse one, is one row with GAP and no place; one that
    several extents cover in a place has CONFLICT. An empty range has no row. Ids are unique within keys.
    """
    e = extents.select(*keys, F.col("logical").alias("start"), (F.col("logical") + F.col("length")).alias("end"), "physical")
    met = intervals.overlapping(ranges.select(*keys, "id", "start", "end").where("end > start"), e, keys, width, F.col("b.physical").isNotNull())
    start, end = F.greatest("a.start", "b.start"), F.least("a.end", "b.end")
    found = met.select(*(F.col(f"a.{k}").alias(k) for k in keys), F.col("a.id").alias("id"), start.alias("logical_start"), (F.col("b.physical") + start - F.col("b.start")).alias("physical_start"), (end - start).alias("length"))
    covered = found.groupBy(*keys, "id").agg(F.sum("length").alias("_sum"), F.min("logical_start").alias("_low"), F.max(F.col("logical_start") + F.col("length")).alias("_high"))
    asked = ranges.where("end > start").select(*keys, "id", F.col("start").alias("_start"), F.col("end").alias("_end")).join(covered, [*keys, "id"], "left")
    # extents that overlap hide a gap from the sum alone: the parts are then looked at in order
    along = Window.partitionBy(*keys, "id").orderBy("logical_start", "length").rowsBetween(Window.unboundedPreceding, -1)
    holes = found.withColumn("_top", F.max(F.col("logical_start") + F.col("length")).over(along)).groupBy(*keys, "id").agg(
        F.bool_or(F.col("logical_start") > F.col("_top")).alias("_hole"), F.bool_or(F.col("logical_start") < F.col("_top")).alias("_twice")
    )
    judged = asked.join(holes, [*keys, "id"], "left").withColumn(
        "failure",
        F.when(F.col("_sum").isNull() | (F.col("_low") > F.col("_start")) | (F.col("_high") < F.col("_end")) | F.coalesce("_hole", F.lit(False)), GAP).when(F.coalesce("_twice", F.lit(False)), CONFLICT),
    )
    none = F.lit(None).cast("long")
    good = found.join(judged.where("failure IS NULL").select(*keys, "id"), [*keys, "id"]).withColumn("failure", F.lit(None).cast("string"))
    bad = judged.where("failure IS NOT NULL").select(*keys, "id", F.col("_start").alias("logical_start"), none.alias("physical_start"), (F.col("_end") - F.col("_start")).alias("length"), "failure")
    return good.unionByName(bad)


def stream_chunks(extents: DataFrame, keys: list[str], size: int) -> DataFrame:
    """keys, logical_start, physical_start, length and gap_before of whole streams in pieces of at most ``size`` bytes, for reading and then for ``carry``.

    What is missing or sparse before an extent is a gap. Only places are sorted by stream.
    """
    e = extents.where("physical IS NOT NULL AND length > 0")
    before = F.lag(F.col("logical") + F.col("length")).over(Window.partitionBy(*keys).orderBy("logical"))
    e = e.withColumn("_gap", F.coalesce(before != F.col("logical"), F.lit(False)))
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long")))
    d = e.select(*keys, "logical", "physical", "length", "_gap", at.alias("_at"))
    return d.select(
        *keys, (F.col("logical") + F.col("_at")).alias("logical_start"), (F.col("physical") + F.col("_at")).alias("physical_start"), F.least(F.lit(size).cast("long"), F.col("length") - F.col("_at")).alias("length"),
        (F.col("_gap") & (F.col("_at") == 0)).alias("gap_before"),
    )


def read_files(wanted: DataFrame) -> DataFrame:
    """``wanted(path, identity, physical_start, length)`` and others with data and failure; ``identity`` may be null.

    A task opens a file once for the rows of it that it has in a row. A range beyond the file's end, a negative one, a read that
    ends early and a source that is not the one it was are failures. Rows that failed before keep their reason.
    """
    if "failure" not in wanted.columns:
        wanted = wanted.withColumn("failure", F.lit(None).cast("string"))
    schema = wanted.withColumn("data", F.lit(None).cast("binary")).schema

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, path, file, seen = [], None, None, None
            try:
                for at, start, length, expected, failure in zip(batch["path"], batch["physical_start"], batch["length"], batch["identity"], batch["failure"], strict=True):
                    if failure is not None and not pd.isna(failure):
                        out.append((failure, None))
                        continue
                    if at != path:
                        if file:
                            file.close()
                        path, file, seen = at, None, None
                        try:
                            file, seen = open(at, "rb"), identity(at)  # noqa: SIM115
                        except OSError:
                            pass
                    out.append(_read(file, seen, expected, start, length))
            finally:
                if file:
                    file.close()
            yield batch.assign(failure=[x for x, _ in out], data=[x for _, x in out])

    return wanted.mapInPandas(run, schema)


def _read(file, seen: str | None, expected: str | None, start: int, length: int) -> tuple[str | None, bytes | None]:
    if file is None:
        return UNREADABLE, None
    if expected is not None and not pd.isna(expected) and expected != seen:
        return CHANGED, None
    if pd.isna(start) or pd.isna(length) or start < 0 or length < 0 or start + length > int(seen.split(":")[0]):
        return OUTSIDE, None
    file.seek(int(start))
    data = file.read(int(length))
    return (None, data) if len(data) == length else (SHORT, None)


def read_blocks(wanted: DataFrame, blocks: DataFrame, keys: list[str], ids: list[str], size: int) -> DataFrame:
    """``wanted(ids, keys, physical_start, length, failure)`` with data from ``blocks(keys, block, data)`` of ``size`` bytes each.

    ``keys`` name the source; ``ids``, which tell wanted ranges apart, must not be among them. A range of which a block is missing or
    ends early is SHORT. Blocks that nothing asks for are not moved beyond the join.
    """
    good = wanted.where("failure IS NULL AND length > 0")
    first, last = F.floor(F.col("physical_start") / size), F.floor((F.col("physical_start") + F.col("length") - 1) / size)
    asked = good.select(*ids, *keys, "physical_start", "length", F.explode(F.sequence(first, last)).alias("block"))
    low = F.greatest(F.col("physical_start"), F.col("block") * size)
    high = F.least(F.col("physical_start") + F.col("length"), (F.col("block") + 1) * size)
    part = F.substring("data", (low - F.col("block") * size + 1).cast("int"), (high - low).cast("int"))
    got = asked.join(blocks.select(*keys, F.col("block").cast("long").alias("block"), "data"), [*keys, "block"]).select(*ids, "block", part.alias("part"))
    whole = got.groupBy(*ids).agg(F.transform(F.array_sort(F.collect_list(F.struct("block", "part"))), lambda x: F.hex(x["part"])).alias("parts"))
    data = F.unhex(F.array_join("parts", ""))
    out = wanted.join(whole.select(*ids, data.alias("data")), ids, "left")
    ended = (F.col("length") > 0) & (F.coalesce(F.length("data"), F.lit(0)) < F.col("length"))
    out = out.withColumn("failure", F.coalesce("failure", F.when(ended, SHORT)))
    return out.withColumn("data", F.when(F.col("failure").isNull(), F.coalesce("data", F.lit(b""))))
