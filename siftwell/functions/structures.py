"""Structures in bounded blobs, validated by SQL expressions on their BINARY column.

Each function returns a struct of states and numbers; none returns bytes of the blob.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bytes import file_time, part, unsigned, unsigned64

#: Fixed values of the formats: https://www.ntfs.com and the Berkeley DB sources define them.
BTREE_MAGIC, BTREE_VERSION, BTREE_META, LEAF, INTERNAL = 0x053162, 9, 9, 5, 3


def power_of_two(x: Column) -> Column:
    return (x > 0) & (x.bitwiseAND(x - 1) == 0)


def boot_sector(data: Column) -> Column:
    """Geometry of an NTFS boot sector; state is structural or rejected. A size is a number of clusters, or a negative power of two."""
    sector, per_cluster = F.nullif(unsigned(data, 11, 2), F.lit(0)), F.nullif(unsigned(data, 13, 1), F.lit(0))
    sectors, mft, mirror, serial = unsigned64(data, 40), unsigned64(data, 48), unsigned64(data, 56), unsigned64(data, 72)
    cluster = sector * per_cluster
    sized = lambda at: F.when(unsigned(data, at, 1) < 128, unsigned(data, at, 1) * cluster).otherwise(F.pow(F.lit(2), 256 - unsigned(data, at, 1)).cast("long"))
    record, index = sized(64), sized(68)
    fits = (sectors > 0) & (mft < F.floor(sectors / per_cluster)) & (mirror < F.floor(sectors / per_cluster))
    good = (part(data, 3, 8) == F.lit(b"NTFS    ")) & (part(data, 510, 2) == F.lit(b"\x55\xaa")) & sector.isin(512, 1024, 2048, 4096) & power_of_two(per_cluster) & (per_cluster <= 128) & fits & record.between(512, 65536) & (record % sector == 0)
    return F.struct(
        F.when(F.coalesce(good, F.lit(False)), "structural").otherwise("rejected").alias("state"), sector.alias("sector_size"), cluster.alias("cluster_size"), record.alias("record_size"), sectors.alias("sectors"),
        mft.alias("mft_cluster"), mirror.alias("mirror_cluster"), index.alias("index_size"), serial.alias("serial"),
    )


def _metadata(data: Column, big: bool) -> Column:
    size = unsigned(data, 20, 4, big)
    magic = unsigned(data, 12, 4, big) == BTREE_MAGIC
    good = (unsigned(data, 16, 4, big) == BTREE_VERSION) & (unsigned(data, 25, 1) == BTREE_META) & power_of_two(size) & size.between(512, 65536) & (unsigned(data, 88, 4, big) > 0)
    return F.struct(magic.alias("magic"), F.coalesce(good, F.lit(False)).alias("good"), F.lit("big" if big else "little").alias("order"), size.alias("page_size"), unsigned(data, 32, 4, big).alias("last_page"), unsigned(data, 88, 4, big).alias("root"))


def btree_metadata(data: Column) -> Column:
    """A Berkeley DB b-tree metadata page in either byte order: structural, fragment (cut short) or rejected."""
    little, big = _metadata(data, False), _metadata(data, True)
    m = F.when(big["magic"], big).otherwise(little)
    state = F.when(~F.coalesce(m["magic"], F.lit(False)), "rejected").when(m["good"], "structural").when(F.octet_length(data) < 92, "fragment").otherwise("rejected")
    return F.struct(state.alias("state"), m["order"].alias("order"), m["page_size"].alias("page_size"), m["last_page"].alias("last_page"), m["root"].alias("root"))


def btree_page(data: Column, size: int, big: bool = False) -> Column:
    """Header and slots of a Berkeley DB page of ``size`` bytes: numbers of the page, its links and entries.

    structural needs all slots within the page, behind the slot table and, on a leaf, an even number of
    entries; a page cut short is a fragment.
    """
    u = lambda at, n: unsigned(data, at, n, big)
    entries, free, level, kind = u(20, 2), u(22, 2), u(24, 1), u(25, 1)
    slots = F.transform(F.when(entries > 0, F.sequence(F.lit(0).cast("long"), entries - 1)).otherwise(F.array().cast("array<bigint>")), lambda i: unsigned(data, (i * 2 + 26).cast("int"), 2, big))
    inside = F.forall(slots, lambda s: s.isNotNull() & (s >= entries * 2 + 26) & (s + 3 <= size))
    shape = F.when(kind == LEAF, (level == 1) & (entries % 2 == 0)).when(kind == INTERNAL, (level > 1) & (entries > 0)).otherwise(F.lit(False))
    good = shape & inside & (free >= entries * 2 + 26) & (free <= size) & (F.size(F.array_distinct(slots)) == entries)
    state = F.when(~F.coalesce(shape, F.lit(False)), "rejected").when(F.octet_length(data) < size, "fragment").when(F.coalesce(good, F.lit(False)), "structural").otherwise("rejected")
    return F.struct(state.alias("state"), u(8, 4).alias("page"), u(12, 4).alias("prev"), u(16, 4).alias("next"), entries.alias("entries"), level.alias("level"), F.when(kind == LEAF, "leaf").when(kind == INTERNAL, "internal").alias("kind"))


def change_record(data: Column) -> Column:
    """A version 2 record of an NTFS change journal at the start of ``data``."""
    length, name_bytes, name_at = unsigned(data, 0, 4), unsigned(data, 56, 2), unsigned(data, 58, 2)
    good = (unsigned(data, 4, 2) == 2) & (unsigned(data, 6, 2) == 0) & (length % 8 == 0) & (length >= 60) & (name_at == 60) & (name_bytes % 2 == 0) & (name_at + name_bytes <= length) & (F.octet_length(data) >= length)
    number = lambda at: unsigned(data, at, 6)
    name = F.decode(F.substring(data, F.lit(61), name_bytes.cast("int")), "UTF-16LE")
    ok = F.coalesce(good, F.lit(False))
    return F.when(ok, F.struct(
        length.alias("length"), number(8).alias("file"), unsigned(data, 14, 2).alias("file_sequence"), number(16).alias("parent"), unsigned(data, 22, 2).alias("parent_sequence"),
        file_time(unsigned64(data, 32)).alias("ts"), unsigned(data, 40, 4).alias("reason"), unsigned(data, 52, 4).alias("attributes"), name.alias("name"),
    ))


def sealed_container(token: Column) -> Column:
    """Whether a base64 token frames an ECIES message: magic, compressed key, whole blocks, code. States only."""
    raw = F.try_to_binary(token, F.lit("base64"))
    n = F.octet_length(raw)
    good = part(raw, 0, 4).isin(b"BIE1", b"BIE2") & unsigned(raw, 4, 1).isin(2, 3) & (n >= 4 + 33 + 16 + 32) & ((n - 69) % 16 == 0)
    return F.when(raw.isNull(), "not_base64").when(F.coalesce(good, F.lit(False)), "structural").otherwise("rejected")
