"""One pass over bytes for any number of fixed patterns: every occurrence, overlapping ones too.

The scan itself is ``bytes.find`` on Arrow batches; dedup, counters and clustering are DataFrame work.
Of the bytes, no more than offsets leaves the scan.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HITS = "source_id {key}, start long, end long, signature string, detector int, target string, kind string"
#: A pattern: its name and bytes, and what it is evidence of: a target and a kind of artifact.
Pattern = tuple[str, bytes] | tuple[str, bytes, str, str]


def occurrences(data: bytes, pattern: bytes) -> Iterator[int]:
    at = data.find(pattern)
    while at >= 0:
        yield at
        at = data.find(pattern, at + 1)


def scan(units: DataFrame, patterns: Sequence[Pattern]) -> DataFrame:
    """Hits of ``patterns``, (name, bytes) or (name, bytes, target, kind), in ``units(source_id, scan_start, own_end, data)``.

    A hit belongs to the unit that owns its first byte, so a hit in the overlap of two units comes once;
    units must overlap by the longest pattern less one.
    """
    key = units.schema["source_id"].dataType
    kind = pa.int64() if key.simpleString() == "bigint" else pa.string()
    schema = pa.schema([("source_id", kind), ("start", pa.int64()), ("end", pa.int64()), ("signature", pa.string()), ("detector", pa.int32()), ("target", pa.string()), ("kind", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [], [])
            for source, start, own_end, data in zip(*(batch.column(c).to_pylist() for c in ("source_id", "scan_start", "own_end", "data")), strict=True):
                for detector, (name, pattern, *of) in enumerate(patterns):
                    for at in occurrences(data or b"", pattern):
                        if start + at >= own_end:
                            break
                        for values, value in zip(out, (source, start + at, start + at + len(pattern), name, detector, *(of or ("unknown", name))), strict=True):
                            values.append(value)
            yield pa.record_batch([pa.array(v, t) for v, t in zip(out, schema.types, strict=True)], schema=schema)

    return units.select("source_id", "scan_start", "own_end", "data").mapInArrow(run, HITS.format(key=key.simpleString()))


def deduplicated(hits: DataFrame) -> DataFrame:
    """The first hit of each target and kind of artifact at each place; of several detectors that find it, the first."""
    row = F.struct(*hits.columns)
    first = hits.groupBy("source_id", "target", "kind", "start", "end").agg(F.min_by(row, F.struct("detector", "signature")).alias("_row"))
    return first.select("_row.*")


def text_units(rows: DataFrame, key: str, text: Column) -> DataFrame:
    """Each text's bytes as one unit."""
    return rows.select(F.col(key).alias("source_id"), F.lit(0).cast("long").alias("scan_start"), F.octet_length(text).cast("long").alias("own_end"), text.cast("binary").alias("data"))
