"""Parsers over logical streams that come in chunks: what a chunk cuts is carried to the next, and a gap ends it.

``chunks`` have keys that name a stream, logical_start, data, physical_start (null where it isn't known) and
gap_before. However a stream is cut into chunks and rows into partitions, the rows are those of one chunk; a gap,
a place that does not follow, or a chunk without data ends what is pending. Chunks of a stream don't overlap.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.journals import Runs
from ..operators import intervals
from ..operators.store import materialize

CHUNK = ["logical_start", "data", "physical_start", "gap_before"]
SEGMENTS = "segments array<struct<logical: long, physical: long, length: long>>"


class Stream:
    """A parser and what it has not yet done with: bytes, where they begin, and where they are from."""

    def __init__(self, parser: Callable) -> None:
        self.parser, self.pending, self.start, self.segments = parser(), b"", None, []

    def chunk(self, start: int, data: bytes, physical: int | None, gap: bool) -> list[tuple]:
        rows = []
        if self.start is not None and (gap or not data or start != self.start + len(self.pending)):
            rows = self.end("gap")
        if data:
            self.start = start if self.start is None else self.start
            self.pending += data
            if physical is not None:
                self.segments.append((start, start + len(data), physical))
            rows += self._taken(None)
        return rows

    def end(self, why: str = "end") -> list[tuple]:
        rows = self._taken(why) if self.start is not None else []
        self.pending, self.start, self.segments = b"", None, []
        return rows

    def _taken(self, ended: str | None) -> list[tuple]:
        rows, used = self.parser.take(self.pending, self.start, ended)
        if not rows and not used:
            return rows
        rows = [(*r, self._from(*self._span(r))) for r in rows]
        self.pending, self.start = self.pending[used:], self.start + used
        self.segments = [s for s in self.segments if s[1] > self.start]
        return rows

    def _span(self, row: tuple) -> tuple[int, int]:
        offset, length, unit = _places(self.parser.schema)
        return row[offset], unit * (row[length] or 1)

    def _from(self, start: int, length: int) -> list[tuple[int, int, int]]:
        end, found = start + length, []
        for a, b, physical in self.segments:
            if a < end and start < b:
                low = a if a > start else start
                found.append((low, physical + low - a, (b if b < end else end) - low))
        return found


def _values(column: pa.Array) -> list:
    """What ``to_pylist`` gives, without a scalar for each value where there is a shorter way."""
    t = column.type
    short = pa.types.is_integer(t) or pa.types.is_boolean(t) or pa.types.is_binary(t) or pa.types.is_string(t)
    return column.to_numpy(zero_copy_only=False).tolist() if short and not column.null_count else column.to_pylist()


def carried(chunks: DataFrame, keys: list[str], parser: Callable) -> DataFrame:
    """keys, the parser's columns and segments of every row that ``parser`` finds in the streams.

    A task reads a stream in order and holds no more of it than a chunk and what that cuts. Where a parser learns
    nothing from a stream, its stretches between gaps go to different tasks. Keys are not null.
    """
    d, by = chunks.select(*keys, *CHUNK), list(keys)
    schema = _schema(d, keys, parser)
    d = d.withColumn("_why", F.lit("end"))
    if not parser().learns:
        d = materialize(d, "chunks")
        along = Window.partitionBy(*keys).orderBy("logical_start")
        # only places are sorted by stream, not the bytes
        ends = d.select(*keys, "logical_start", F.length("data").alias("_n"), "gap_before")
        before = F.lag(F.col("logical_start") + F.col("_n")).over(along)
        cut = F.coalesce(F.col("gap_before"), F.lit(False)) | (F.col("_n") == 0) | (F.coalesce(before, F.col("logical_start")) != F.col("logical_start"))
        runs = ends.withColumn("_run", F.sum(cut.cast("long")).over(along))
        why = F.when(F.col("_run") < F.max("_run").over(Window.partitionBy(*keys)), "gap").otherwise("end")
        d = d.drop("_why").join(runs.select(*keys, "logical_start", "_run", why.alias("_why")), [*keys, "logical_start"])
        by = [*keys, "_run"]
    names = [*by, "_why", *CHUNK]
    types = to_arrow_schema(StructType.fromDDL(schema))

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[]] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, types, strict=True)], schema=types)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, stream, why = (), Stream(parser), "end"
        for batch in batches:
            out = []
            for row in zip(*(_values(batch.column(c)) for c in names), strict=True):
                line, (start, data, physical, gap) = row[: len(by)], row[len(by) + 1 :]
                if line != own:
                    out += [(*own[: len(keys)], *r) for r in stream.end(why)]
                    own, stream = line, Stream(parser)
                why = row[len(by)]
                out += [(*own[: len(keys)], *r) for r in stream.chunk(start, data or b"", physical, bool(gap))]
            yield table(out)
        yield table([(*own[: len(keys)], *r) for r in stream.end(why)])

    return d.repartition(*by).sortWithinPartitions(*by, "logical_start").mapInArrow(run, schema)


def carried_stream(chunks: DataFrame, keys: list[str], parser: Callable) -> DataFrame:
    """As ``carried`` over a streaming DataFrame whose chunks arrive in order: what a chunk cuts is the stream's state.

    What is pending when no more comes is not told, since a stream has no end.
    """
    d = chunks.select(*keys, *CHUNK)
    names = [*keys, *fields(parser().schema), "segments"]

    def run(line: tuple, batches: Iterable[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        stream = pickle.loads(state.get[0]) if state.exists else Stream(parser)
        rows = pd.concat(list(batches)).sort_values("logical_start")
        out = []
        for start, data, physical, gap in rows[CHUNK].itertuples(index=False, name=None):
            out += [(*line, *r) for r in stream.chunk(int(start), bytes(data or b""), None if pd.isna(physical) else int(physical), gap is True or gap == 1)]
        state.update((pickle.dumps(stream),))
        yield pd.DataFrame(out, columns=names, dtype=object)

    return d.groupBy(*keys).applyInPandasWithState(run, _schema(d, keys, parser), "stream binary", "append", "NoTimeout")


def _schema(d: DataFrame, keys: list[str], parser: Callable) -> str:
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.select(*keys).schema)
    return f"{own}, {parser().schema}, {SEGMENTS}"


@cache
def _places(schema: str) -> tuple[int, int, int]:
    """Where in a parser's rows an offset and a length are, and the length's unit in bytes."""
    names = fields(schema)
    return (names.index("offset"), names.index("length"), 1) if "length" in names else (names.index("offset"), names.index("characters"), 2)


def fields(schema: str) -> list[str]:
    """Names of the fields of a schema text, but for those within others."""
    while "<" in schema:
        schema = re.sub(r"<[^<>]*>", "", schema)
    return [c.split()[0] for c in re.sub(r"\(.*?\)", "", schema).split(",")]


def maximal_runs(chunks: DataFrame, keys: list[str], width: int = 1 << 20) -> DataFrame:
    """The UTF-16 runs of streams (``journals.Runs``) whose bytes do not lie within those of another run."""
    runs = materialize(carried(chunks, keys, Runs), "runs")
    spans = runs.select(*keys, F.col("offset").alias("start"), (F.col("offset") + 2 * F.col("characters")).alias("end"))
    within = intervals.contained(spans, spans, keys, width, "inner").where("p.start <> e.start OR p.end <> e.end")
    return runs.join(within.select(*(F.col(f"p.{k}").alias(k) for k in keys), F.col("p.start").alias("offset")).distinct(), [*keys, "offset"], "left_anti")
