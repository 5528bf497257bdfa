"""Length prefixes, partition tables, keyed hashes and paths on columns, as SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytes import part, unsigned, unsigned64

#: Names of wallet records, and the longest name that is read.
RECORD_TYPES = ("key", "wkey", "defaultkey", "ckey", "mkey", "keymeta")
LONGEST_NAME = 64
#: Partition entries and bytes of an entry that a GPT may have.
GPT_ENTRIES, GPT_ENTRY = 4096, (128, 4096)


def compact_size(data: Column, at: int | Column = 0) -> Column:
    """value, size and canonical of a CompactSize at ``at``; a form longer than needed is flagged, one cut short is null."""
    at = F.lit(at) if isinstance(at, int) else at
    marker = unsigned(data, at, 1)
    wide = {253: (unsigned(data, at + 1, 2).cast("decimal(20,0)"), 3, 253), 254: (unsigned(data, at + 1, 4).cast("decimal(20,0)"), 5, 1 << 16), 255: (unsigned64(data, at + 1), 9, 1 << 32)}
    value, size, least = marker.cast("decimal(20,0)"), F.lit(1), F.lit(0).cast("decimal(20,0)")
    for mark, (v, n, low) in wide.items():
        value, size, least = F.when(marker == mark, v).otherwise(value), F.when(marker == mark, n).otherwise(size), F.when(marker == mark, F.lit(low).cast("decimal(20,0)")).otherwise(least)
    return F.when(value.isNotNull(), F.struct(value.alias("value"), size.alias("size"), (value >= least).alias("canonical")))


def record_type(data: Column) -> Column:
    """name, size (of length and name) and canonical of the record name that begins a key, if it is a known one."""
    length = compact_size(data)
    n = length["value"].cast("int")
    name = F.decode(F.substring(data, length["size"] + 1, n), "US-ASCII")
    whole = (length["value"] > 0) & (length["value"] <= LONGEST_NAME) & (F.octet_length(data) >= length["size"] + n)
    return F.when(whole & name.isin(*RECORD_TYPES), F.struct(name.alias("name"), (length["size"] + n).alias("size"), length["canonical"].alias("canonical")))


def varint(data: Column, at: int = 0, most: int = 9) -> Column:
    """value and size of a base-128 number of at most ``most`` bytes, the lowest first; null if none of them ends it."""
    out = F.lit(None).cast("struct<value: bigint, size: int>")
    for n in reversed(range(1, most + 1)):
        digits = [unsigned(data, at + i, 1) for i in range(n)]
        value = sum((F.shiftleft(d.bitwiseAND(F.lit(127).cast("long")), 7 * i) for i, d in enumerate(digits[1:], 1)), digits[0].bitwiseAND(F.lit(127).cast("long")))
        # shorter ones, set later, come first
        out = F.when(digits[-1] < 128, F.struct(value.alias("value"), F.lit(n).alias("size"))).otherwise(out)
    return out


def der_length(data: Column, at: int = 0) -> Column:
    """value, size and canonical of a DER length of at most four bytes; null for indefinite, longer or cut ones."""
    first = unsigned(data, at, 1)
    out = F.when(first < 128, F.struct(first.alias("value"), F.lit(1).alias("size"), F.lit(True).alias("canonical")))
    for n in (1, 2, 3, 4):
        value = unsigned(data, at + 1, n, True)
        out = out.when((first == 128 + n) & value.isNotNull(), F.struct(value.alias("value"), F.lit(n + 1).alias("size"), (value >= (128 if n == 1 else 1 << 8 * (n - 1))).alias("canonical")))
    return out


def hmac(key: bytes, message: Column, bits: int = 256) -> Column:
    """Hexadecimal HMAC-SHA-2 of ``message`` under a fixed ``key``."""
    import hashlib

    block = 64 if bits == 256 else 128
    key = (hashlib.new(f"sha{bits}", key).digest() if len(key) > block else key).ljust(block, b"\0")
    pad = lambda x: F.lit(bytes(b ^ x for b in key))
    return F.sha2(F.concat(pad(0x5C), F.unhex(F.sha2(F.concat(pad(0x36), message), bits))), bits)


def mbr(data: Column) -> Column:
    """The partitions of a master boot record: index, kind, first and sectors; empty without its signature."""
    entries = [F.struct(F.lit(i).alias("index"), unsigned(data, 446 + 16 * i + 4, 1).alias("kind"), unsigned(data, 446 + 16 * i + 8, 4).alias("first"), unsigned(data, 446 + 16 * i + 12, 4).alias("sectors")) for i in range(4)]
    real = F.filter(F.array(*entries), lambda e: (e["kind"] != 0) & (e["sectors"] > 0))
    return F.when(part(data, 510, 2) == F.lit(b"\x55\xaa"), real).otherwise(F.slice(real, 1, 0))


def gpt(data: Column, sector: int = 512) -> Column:
    """The partitions, index, first and last sector, of a disk's first sectors: header in the second, table where it says; empty if either is wrong."""
    head = sector
    table, count, size = unsigned64(data, head + 72).cast("long") * sector, unsigned(data, head + 80, 4), unsigned(data, head + 84, 4)
    good = (part(data, head, 8) == F.lit(b"EFI PART")) & count.between(1, GPT_ENTRIES) & size.between(*GPT_ENTRY)
    at = lambda i: (table + i * size).cast("int")
    entry = lambda i: F.struct(i.cast("int").alias("index"), part(data, at(i), 16).alias("_kind"), unsigned64(data, at(i) + 32).cast("long").alias("first"), unsigned64(data, at(i) + 40).cast("long").alias("last"))
    found = F.filter(F.transform(F.sequence(F.lit(0).cast("long"), count - 1), entry), lambda e: (e["_kind"] != F.lit(b"\0" * 16)) & (e["first"] > 0) & (e["last"] >= e["first"]))
    return F.transform(F.when(F.coalesce(good, F.lit(False)), found), lambda e: F.struct(e["index"].alias("index"), e["first"].alias("first"), e["last"].alias("last")))


def page_grid(anchors: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, base, page_size, page and at: the places on each anchor's grid within ``ranges(keys, start, end)``, but the anchor itself.

    ``anchors(keys, base, page_size, meta_page)``.
    """
    both = anchors.join(ranges, keys)
    first = F.ceil(F.greatest(F.col("start") - F.col("base"), F.lit(0)) / F.col("page_size"))
    last = F.ceil((F.col("end") - F.col("base")) / F.col("page_size")) - 1
    pages = both.withColumn("page", F.explode(F.when(last >= first, F.sequence(first, last))))
    return pages.where("page <> meta_page").select(*keys, "base", "page_size", "page", (F.col("base") + F.col("page") * F.col("page_size")).alias("at"))


def path_identity(path: Column) -> Column:
    """A path by which files are told apart on case-insensitive volumes: lower case, one kind of slash, no empty or ``.`` parts, ``..`` resolved."""
    parts = F.filter(F.split(F.lower(F.replace(path, F.lit("/"), F.lit("\\"))), r"\\", -1), lambda p: (p != "") & (p != "."))
    folded = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    return F.array_join(folded, "\\")
