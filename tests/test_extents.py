"""Streams through extents against a stream that is put together in memory."""

import random

import pytest

from siftwell.functions import journals
from siftwell.sources import extents, ranged
from siftwell.streaming import carry

from .test_carry import change

EXTENT = "s int, logical long, physical long, length long"


def layout(r, data, image):
    """Extents that spread ``data`` over the image, in any order."""
    out, at = [], 0
    free = list(range(0, len(image) - 600, 600))
    r.shuffle(free)
    while at < len(data):
        n = min(8 * r.randrange(1, 75), len(data) - at)
        place = free.pop()
        image[place : place + n] = data[at : at + n]
        out.append((at, place, n))
        at += n
    return out


def test_ranges_of_files(spark, tmp_path):
    r = random.Random(4)
    data, image = bytes(r.randrange(256) for _ in range(9000)), bytearray(40_000)
    rows = [(1, *x) for x in layout(r, data, image)]
    path = tmp_path / "disk.img"
    path.write_bytes(image)
    sparse = [(2, 0, 0, 100), (2, 100, None, 100), (2, 200, 200, 100), (3, 0, 0, 100), (3, 50, 500, 100), (4, 0, 39_990, 100)]
    e = spark.createDataFrame(rows + sparse, EXTENT)
    asked = [(1, i, a := r.randrange(9000), min(9000, a + r.randrange(1, 2000))) for i in range(30)]
    asked += [(1, 90, 8990, 9010), (1, 91, 5, 5), (2, 1, 50, 150), (2, 2, 0, 100), (2, 3, 200, 300), (3, 1, 0, 150), (3, 2, 0, 50), (4, 1, 0, 100), (9, 1, 0, 10)]
    ranges = spark.createDataFrame(asked, "s int, id int, start long, end long")
    found = extents.pieces(ranges, e, ["s"], 512)
    from pyspark.sql import functions as F

    wanted = found.select("*", F.lit(str(path)).alias("path"), F.lit(extents.identity(str(path))).alias("identity"))
    got, failed = {}, {}
    for x in sorted(extents.read_files(wanted).collect(), key=lambda x: (x.s, x.id, x.logical_start)):
        if x.failure:
            failed[x.s, x.id] = x.failure
        else:
            got[x.s, x.id] = got.get((x.s, x.id), b"") + bytes(x.data)
    assert failed == {(1, 90): extents.GAP, (2, 1): extents.GAP, (3, 1): extents.CONFLICT, (4, 1): extents.OUTSIDE, (9, 1): extents.GAP}
    for s, i, a, b in asked:
        if s == 1 and i < 90:
            assert got[s, i] == data[a:b]
    assert got[2, 2] == bytes(image[:100]) and got[3, 2] == bytes(image[:50]) and (1, 91) not in got
    changed = extents.read_files(wanted.where("s = 2 AND id = 2").withColumn("identity", F.lit("1:1")).unionByName(wanted.where("s = 2 AND id = 3").withColumn("path", F.lit(str(tmp_path / "none")))))
    assert sorted(x.failure for x in changed.collect()) == [extents.CHANGED, extents.UNREADABLE]
    assert extents.read_files(wanted.limit(0)).collect() == []


def test_stream_feeds_the_journal(spark, tmp_path):
    """A journal whose pieces lie about a disk is read through its extents; a piece that is missing is a gap."""
    r = random.Random(6)
    names = [f"file{i}.dat" for i in range(40)]
    data, image = b"".join(change(n) for n in names), bytearray(60_000)
    rows = [(1, *x) for x in layout(r, data, image)]
    path = tmp_path / "disk.img"
    path.write_bytes(image)
    from pyspark.sql import functions as F

    def names_of(rows, size):
        chunks = extents.stream_chunks(spark.createDataFrame(rows, EXTENT), ["s"], size)
        read = extents.read_files(chunks.select("*", F.lit(str(path)).alias("path"), F.lit(None).cast("string").alias("identity")))
        return [x.name for x in carry.carried(read, ["s"], journals.Changes).where("failure IS NULL").orderBy("offset").collect()]

    assert names_of(rows, 64) == names_of(rows, 4096) == names
    gone = rows.pop(2)
    left = names_of(rows, 100)
    starts = [sum(len(change(x)) for x in names[:i]) for i in range(41)]
    assert left == [n for i, n in enumerate(names) if starts[i + 1] <= gone[1] or starts[i] >= gone[1] + gone[3]]


def test_pushed_ranges_prune_units(spark, tmp_path):
    ranged.register(spark)
    (tmp_path / "a.bin").write_bytes(bytes(range(256)) * 40)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    try:
        df = spark.read.format("ranged").option("chunk", 1000).option("overlap", 100).option("pushdown", "true").load(str(tmp_path / "a.bin"))
        whole = df.count()
        some = df.where("own_start >= 2700 AND own_start < 4500")
        assert whole == 12 and sorted(x.own_start for x in some.collect()) == [2700, 3600]
        assert some.rdd.getNumPartitions() == 2
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


@pytest.mark.parametrize("n", [1, 7])
def test_many_units_share_a_partition(spark, tmp_path, n):
    ranged.register(spark)
    for i in range(9):
        (tmp_path / f"{i}.bin").write_bytes(bytes([i]) * 500)
    df = spark.read.format("ranged").option("chunk", 100).option("overlap", 0).option("units", n).load(str(tmp_path))
    assert df.count() == 45 and df.rdd.getNumPartitions() == 9 * -(-5 // n)
