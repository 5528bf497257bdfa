"""A Spark data source that reads byte ranges of files: ``spark.read.format("ranged")``.

Options: ``path`` (a file, or a folder that is walked without following links), ``chunk`` and ``overlap``
in bytes, ``start`` and ``end`` of the range to scan, ``units`` to a partition. A row is one ownership unit, so a file of any
size is read in parallel and no row holds more than a chunk. With ``pushdown`` true, which asks for
``spark.sql.python.filterPushdown.enabled``, bounds on own_start are pushed: units outside are neither planned nor read. Files and folders must be visible to all
executors under the same path; for stores that only Spark reads, ``binaryFile`` with ``units`` will do.

Rows: source_id (the path within the folder), scan_start, own_start, own_end, data, failure. A file that
can't be read is a row with its reason and no data, and the run goes on.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "source_id string, scan_start long, own_start long, own_end long, data binary, failure string"
#: Suffixes of whole images; a folder is a folder, and everything else a file.
IMAGE_SUFFIXES = (".img", ".dd", ".bin", ".raw")


def source_type(path: str, explicit: str | None = None) -> str:
    """image, file or folder; an explicit type that the path can't have is an error."""
    found = "folder" if os.path.isdir(path) else "image" if path.lower().endswith(IMAGE_SUFFIXES) else "file"
    if explicit is None or explicit == found:
        return found
    if "folder" in (explicit, found):
        raise ValueError(f"{path} is not a {explicit}")
    return explicit


def walk(folder: str) -> tuple[list[tuple[str, int]], list[tuple[str, str]]]:
    """Regular files (path within ``folder``, size) in case-insensitive order, and what was skipped, with reasons."""
    files, skipped, seen, left = [], [], set(), [folder]
    while left:
        at = left.pop()
        try:
            entries = sorted(os.scandir(at), key=lambda e: (e.name.lower(), e.name))
        except OSError as error:
            skipped.append((os.path.relpath(at, folder), type(error).__name__))
            continue
        for entry in entries:
            name = os.path.relpath(entry.path, folder)
            try:
                status = entry.stat(follow_symlinks=False)
            except OSError as error:
                skipped.append((name, type(error).__name__))
                continue
            if entry.is_symlink():
                skipped.append((name, "link"))
            elif entry.is_dir(follow_symlinks=False):
                if (status.st_dev, status.st_ino) in seen:
                    skipped.append((name, "loop"))
                else:
                    seen.add((status.st_dev, status.st_ino))
                    left.append(entry.path)
            elif entry.is_file(follow_symlinks=False):
                files.append((name, status.st_size))
            else:
                skipped.append((name, "not a regular file"))
    return sorted(files, key=lambda f: (f[0].lower(), f[0])), skipped


#: What a pushed filter on own_start leaves of it: [low, high).
PUSHED = {
    EqualTo: lambda n: (n, n + 1), GreaterThan: lambda n: (n + 1, 1 << 63), GreaterThanOrEqual: lambda n: (n, 1 << 63), LessThan: lambda n: (0, n), LessThanOrEqual: lambda n: (0, n + 1),
}


class Unit:
    def __init__(self, path: str, source_id: str, scan: tuple[int, int], own_end: int, failure: str | None = None):
        self.path, self.source_id, self.scan, self.own_end, self.failure = path, source_id, scan, own_end, failure


class Stretch(InputPartition):
    """Units ``first``, ``first`` + 1 and so on of a file, ``count`` of them, or one unit that says what is wrong. Its units are made where it is read."""

    def __init__(self, path: str, source_id: str, size: int, first: int, count: int, failure: str | None = None):
        self.path, self.source_id, self.size, self.first, self.count, self.failure = path, source_id, size, first, count, failure


class RangedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.chunk, self.overlap = int(options.get("chunk", 16 << 20)), int(options.get("overlap", 64 << 10))
        self.low, self.high = int(options.get("start", 0)), int(options["end"]) if "end" in options else None
        self.units, self.own = int(options.get("units", 1)), (0, 1 << 63)
        if self.units < 1:
            raise ValueError("units must be at least 1")
        if not 0 <= self.overlap < self.chunk:
            raise ValueError("overlap must be at least 0 and smaller than chunk")
        if self.low < 0 or (self.high is not None and self.high < self.low):
            raise ValueError("start must be at least 0 and at most end")

    def partitions(self) -> list[Stretch]:
        if source_type(self.path) == "folder":
            files, skipped = walk(self.path)
        else:
            files, skipped = [("", os.path.getsize(self.path))], []
        out = [Stretch(self.path, name, 0, 0, 1, reason) for name, reason in skipped if self.own[0] <= 0 < self.own[1]]
        step = self.chunk - self.overlap
        for name, size in files:
            high = size if self.high is None else min(self.high, size)
            if high <= self.low:
                continue
            # the last unit is the first whose chunk reaches the end
            n = 1 + max(0, -(-(high - self.low - self.chunk) // step))
            first = max(0, -(-(self.own[0] - self.low) // step))
            last = min(n, -(-(self.own[1] - self.low) // step))
            path, source = (os.path.join(self.path, name), name) if name else (self.path, os.path.basename(self.path))
            out += [Stretch(path, source, high, i, min(self.units, last - i)) for i in range(first, last, self.units)]
        return out or [Stretch(self.path, "", 0, 0, 0)]

    def read(self, stretch: Stretch) -> Iterator[tuple]:
        if stretch.failure:
            yield from self.unit(Unit(stretch.path, stretch.source_id, (0, 0), 0, stretch.failure))
            return
        for i in range(stretch.first, stretch.first + stretch.count):
            at = self.low + i * (self.chunk - self.overlap)
            end = min(at + self.chunk, stretch.size)
            yield from self.unit(Unit(stretch.path, stretch.source_id, (at, end), end if end == stretch.size else at + self.chunk - self.overlap))

    def unit(self, unit: Unit) -> Iterator[tuple]:
        start, end = unit.scan
        if unit.failure or end > start:
            data, failure = None, unit.failure
            if not failure:
                try:
                    with open(unit.path, "rb") as f:
                        f.seek(start)
                        data = f.read(end - start)
                    if len(data) < end - start:
                        data, failure = None, "short read"
                except OSError as error:
                    failure = type(error).__name__
            yield unit.source_id, start, start, unit.own_end, data, failure


class PushedReader(RangedReader):
    def pushFilters(self, filters: list) -> Iterator:
        """Bounds on own_start narrow the units; every other filter stays Spark's."""
        for f in filters:
            bound = getattr(f, "value", None)
            if getattr(f, "attribute", None) == ("own_start",) and isinstance(bound, int) and type(f) in PUSHED:
                low, high = PUSHED[type(f)](bound)
                self.own = max(self.own[0], low), min(self.own[1], high)
            else:
                yield f


class RangedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ranged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RangedReader:
        return PushedReader(dict(self.options)) if self.options.get("pushdown", "false").lower() == "true" else RangedReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RangedSource)
