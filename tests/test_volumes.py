"""Volumes that boot sectors propose, and their records."""

import struct

from pyspark.sql import functions as F

from siftwell.functions import structures
from siftwell.operators import volumes

from .test_bytes import boot

RECORD = "source_id string, offset long, record long, sequence int, allocated boolean, extents array<struct<logical: long, cluster: long, length: long>>, failure string"


def test_votes(spark):
    good = bytearray(boot())
    good[68] = 0xF4
    shape = spark.createDataFrame([(bytes(good),)], "d binary").select(structures.boot_sector(F.col("d")).alias("b")).first().b
    assert shape.state == "structural" and shape.index_size == 4096
    sector, cluster, end = shape.sector_size, shape.cluster_size, shape.sectors * shape.sector_size
    start = 8 * sector
    mft = start + shape.mft_cluster * cluster
    hits = [("pair", start), ("pair", start), ("pair", start + end - sector), ("alone", start), ("table", start), ("short", start), ("off", start + 3), ("bad", start)]
    blobs = spark.createDataFrame([(s, int(o), bytes(good) if s != "bad" else bytes(512)) for s, o in hits], "source_id string, offset long, data binary")
    boots = blobs.select("source_id", "offset", structures.boot_sector(F.col("data")).alias("boot"))
    records = spark.createDataFrame([("table", int(mft), 0, 1, True, [(0, int(shape.mft_cluster), 4)], None), ("alone", int(mft), 0, 1, True, [], "cut_short"), ("short", int(mft), 0, 1, True, [], None)], RECORD)
    sizes = spark.createDataFrame([(s, int(start + end)) for s in ("pair", "alone", "table", "off", "bad")] + [("short", int(start + end - 1))], "source_id string, size long")
    found = {(r.source_id, r.volume_start): r for r in volumes.discovered(boots, records, sizes).collect()}
    at = {s: found[s, start] for s in ("pair", "alone", "table", "short")}
    assert {s: r.classification for s, r in at.items()} == {"pair": "detached", "alone": "boot_only_unconfirmed", "table": "detached", "short": "boot_only_unconfirmed"}
    assert at["pair"].boot_copies == 2 and at["pair"].boot_pair and not at["pair"].mft_valid and at["short"].strength == "geometry_correlated"
    assert {s for s, _ in found} == {"pair", "alone", "table", "short"}
    known = volumes.discovered(boots, records, sizes, volumes.discovered(boots, records, sizes).where("source_id = 'pair'").where(F.col("volume_start") == start))
    assert {r.classification for r in known.where("source_id = 'pair'").collect()} == {"current", "boot_only_unconfirmed"}
    size = int(shape.record_size)
    more = [("table", int(mft), 0, 1, True, [(0, int(shape.mft_cluster), 8 * size // cluster + 1)], None), ("table", int(mft) + 2 * size, 2, 1, True, [], None), ("table", int(mft) + 3 * size, 9, 1, True, [], None), ("table", int(start + end - size), 4, 1, False, [], None), ("table", int(mft) + 4 * size, None, None, None, None, "cut_short")]
    layers = {(r.offset - mft) // size: (r.layer, r.failure) for r in volumes.metadata(volumes.discovered(boots, records, sizes), spark.createDataFrame(more, RECORD)).collect()}
    assert layers.pop((start + end - size - mft) // size) == ("detached_stale_file", None)
    assert layers == {0: ("detached_logical_mft", None), 2: ("detached_logical_mft", None), 3: ("detached_misplaced", None), 4: (None, "cut_short")}


def file_record(number, name="a.dat"):
    key = struct.pack("<Q56xBB", 5 | 5 << 48, len(name), 1) + name.encode("utf-16-le")
    named = struct.pack("<II8xIHH", 0x30, (24 + len(key) + 7) // 8 * 8, len(key), 24, 0) + key
    body = named.ljust((24 + len(key) + 7) // 8 * 8, b"\0") + b"\xff\xff\xff\xff\0\0\0\0"
    head = b"FILE\x30\x00\x03\x00" + bytes(8) + struct.pack("<HHHHI", 1, 1, 56, 1, 56 + len(body)) + bytes(16) + struct.pack("<I", number) + b"\5\0" + bytes(6)
    data = (head + body).ljust(1024, b"\0")
    return data[:510] + b"\5\0" + data[512:1022] + b"\5\0"


def test_file_table_through_its_extents(spark):
    """A table of eight records in three extents, of which one record lies in two; one is broken, one in another's place, one beyond the source."""
    numbers = [0, 1, 2, 7, 4, 5, 6, 8]
    table = b"".join(file_record(n, f"file{n}") if i != 5 else bytes(1024) for i, n in enumerate(numbers))
    disk = bytearray(40_000)
    places = [(0, 8, 5), (5, 40, 3), (8, 20, 8)]  # logical, cluster, length in clusters of 512
    for logical, cluster, n in places:
        disk[4096 + cluster * 512 : 4096 + (cluster + n) * 512] = table[logical * 512 : (logical + n) * 512]
    blocks = [("d", i, bytes(disk[i * 1000 : (i + 1) * 1000])) for i in range(40)]
    first = [("d", 4096 + 8 * 512, 0, 1, True, [*places, (16, 900, 2)], None), ("d", 77, 0, 1, True, [], None)]
    v = spark.createDataFrame([("d", 4096, 512, 8, 1024), ("d", 0, 512, 3, 1024)], "source_id string, volume_start long, cluster_size long, mft_cluster long, record_size long")
    found = volumes.file_table(v, spark.createDataFrame(first, RECORD), spark.createDataFrame(blocks, "source_id string, block long, data binary"), 1000)
    rows = {r.number: (r.record, r.aliases[0].name if r.aliases else None, r.failure) for r in found.collect()}
    assert rows == {
        0: (0, "file0", None), 1: (1, "file1", None), 2: (2, "file2", None), 3: (7, "file7", "record_number_mismatch"), 4: (4, "file4", None), 5: (None, None, "no_file_record"), 6: (6, "file6", None),
        7: (8, "file8", "record_number_mismatch"), 8: (None, None, "short_image_read"),
    }
    assert [tuple(r) for r in volumes.safe_prefix(found).collect()] == [("d", 4096, 9, 5, 3)]
