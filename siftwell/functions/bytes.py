"""Numbers, times and checks on BINARY columns, as SQL expressions; offsets count from 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds from 1601-01-01, where file times begin, to 1970-01-01.
FILE_TIME_EPOCH = 11_644_473_600


def part(data: Column, at: int | Column, n: int) -> Column:
    return F.substring(data, (F.lit(at) if isinstance(at, int) else at) + 1, F.lit(n))


def _digits(raw: Column, n: int, big: bool) -> Column:
    """Hexadecimal digits of ``n`` bytes, the most significant first. (``reverse`` would turn bytes as UTF-8 characters.)"""
    digits = F.hex(raw)
    return digits if big else F.concat(*(F.substring(digits, 2 * i + 1, 2) for i in reversed(range(n))))


def unsigned(data: Column, at: int | Column, n: int, big: bool = False) -> Column:
    """The unsigned number of ``n`` < 8 bytes at ``at``, little-endian unless ``big``; null if the data end before."""
    raw = part(data, at, n)
    return F.when(F.octet_length(raw) == n, F.conv(_digits(raw, n, big), 16, 10).cast("long"))


def unsigned64(data: Column, at: int | Column) -> Column:
    raw = part(data, at, 8)
    return F.when(F.octet_length(raw) == 8, F.conv(_digits(raw, 8, False), 16, 10).cast("decimal(20,0)"))


def file_time(ticks: Column) -> Column:
    """TIMESTAMP of a count of 100 ns since 1601; null for 0."""
    return F.when(ticks != 0, F.timestamp_micros(F.floor(ticks / 10).cast("long") - FILE_TIME_EPOCH * 1_000_000))


def reference(value: Column) -> tuple[Column, Column]:
    """Record number and sequence of a 64-bit file reference."""
    return value.bitwiseAND(F.lit((1 << 48) - 1)), F.shiftrightunsigned(value, 48)


def hash256(data: Column) -> Column:
    return F.sha2(F.unhex(F.sha2(data, 256)), 256)
