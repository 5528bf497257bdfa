import hashlib
import random
import struct
from datetime import datetime

from pyspark.sql import functions as F

from siftwell.functions import addresses, bytes as numbers, scan, structures
from siftwell.sources import ranged
from siftwell.sources.units import units
from siftwell.streaming import resume


def one(spark, data, column):
    return spark.createDataFrame([(bytearray(data),)], "d binary").select(column.alias("x")).first().x


def test_numbers(spark):
    d = bytes(range(1, 17))
    assert one(spark, d, numbers.unsigned(F.col("d"), 1, 4)) == int.from_bytes(d[1:5], "little")
    assert one(spark, d, numbers.unsigned(F.col("d"), 1, 4, big=True)) == int.from_bytes(d[1:5], "big")
    assert one(spark, b"\xff" * 8, numbers.unsigned64(F.col("d"), 0)) == 2**64 - 1
    assert one(spark, d, numbers.unsigned(F.col("d"), 14, 4)) is None
    assert one(spark, d, numbers.file_time(F.lit(132537600000000000))) == datetime(2020, 12, 30)
    assert one(spark, b"abc", numbers.hash256(F.col("d"))) == hashlib.sha256(hashlib.sha256(b"abc").digest()).hexdigest()


def boot(**change):
    v = {"oem": b"NTFS    ", "sector": 512, "per": 8, "sectors": 2048, "mft": 4, "mirror": 100, "record": 246} | change
    d = bytearray(512)
    d[3:11] = v["oem"]
    struct.pack_into("<HB", d, 11, v["sector"], v["per"])
    struct.pack_into("<QQQb", d, 40, v["sectors"], v["mft"], v["mirror"], v["record"] - 256)
    d[510:] = b"\x55\xaa"
    return d


def test_boot_sector(spark):
    good = one(spark, boot(), structures.boot_sector(F.col("d")))
    assert (good.state, good.cluster_size, good.record_size) == ("structural", 4096, 1024)
    for bad in ({"oem": b"FAT32   "}, {"per": 3}, {"mft": 900}, {"sector": 500}):
        assert one(spark, boot(**bad), structures.boot_sector(F.col("d"))).state == "rejected"
    assert one(spark, b"", structures.boot_sector(F.col("d"))).state == "rejected"


def metadata(order="<", version=9, size=512):
    d = bytearray(512)
    struct.pack_into(order + "III", d, 12, 0x053162, version, size)
    d[25] = 9
    struct.pack_into(order + "I", d, 32, 7)
    struct.pack_into(order + "I", d, 88, 1)
    return d


def test_btree_metadata(spark):
    for order, name in (("<", "little"), (">", "big")):
        m = one(spark, metadata(order), structures.btree_metadata(F.col("d")))
        assert (m.state, m.order, m.page_size, m.last_page, m.root) == ("structural", name, 512, 7, 1)
    assert one(spark, metadata()[:40], structures.btree_metadata(F.col("d"))).state == "fragment"
    assert one(spark, metadata(version=8), structures.btree_metadata(F.col("d"))).state == "rejected"
    assert one(spark, metadata(size=600), structures.btree_metadata(F.col("d"))).state == "rejected"


def page(slots, size=512, kind=5, level=1, free=400):
    d = bytearray(size)
    struct.pack_into("<IIIHHBB", d, 8, 3, 2, 4, len(slots), free, level, kind)
    struct.pack_into(f"<{len(slots)}H", d, 26, *slots)
    return d


def test_btree_page(spark):
    read = lambda d: one(spark, d, structures.btree_page(F.col("d"), 512))
    good = read(page([500, 480, 460, 440]))
    assert (good.state, good.page, good.prev, good.next, good.entries, good.kind) == ("structural", 3, 2, 4, 4, "leaf")
    assert read(page([500, 480])[:300]).state == "fragment"
    assert {read(page(s)).state for s in ([500], [510, 480], [500, 500], [20, 480])} == {"rejected"}
    assert read(page([500, 480, 460], kind=3, level=2)).state == "structural"
    assert read(page([], kind=9)).state == "rejected"


def change(name, reason=0x200, version=2):
    raw = name.encode("utf-16-le")
    length = -(-(60 + len(raw)) // 8) * 8
    d = struct.pack("<IHHQQQqIIIIHH", length, version, 0, 7 | 3 << 48, 5 | 5 << 48, 1000, 132537600000000000, reason, 0, 0, 32, len(raw), 60) + raw
    return d.ljust(length, b"\0")


def test_change_record(spark):
    r = one(spark, change("wället.dat") + b"rest", structures.change_record(F.col("d")))
    assert (r.file, r.file_sequence, r.parent, r.parent_sequence, r.reason, r.name, r.ts) == (7, 3, 5, 5, 0x200, "wället.dat", datetime(2020, 12, 30))
    assert one(spark, change("x", version=3), structures.change_record(F.col("d"))) is None
    assert one(spark, change("longer name")[:40], structures.change_record(F.col("d"))) is None


def test_sealed_container(spark):
    import base64

    token = base64.b64encode(b"BIE1" + b"\x02" + b"k" * 32 + b"c" * 32 + b"m" * 32).decode()
    df = spark.createDataFrame([(token,), (token[:-8],), ("%%%",)], "t string").select(structures.sealed_container(F.col("t")).alias("x"))
    assert [r.x for r in df.collect()] == ["structural", "rejected", "not_base64"]


def encode58(raw):
    raw += hashlib.sha256(hashlib.sha256(raw).digest()).digest()[:4]
    n, out = int.from_bytes(raw, "big"), ""
    while n:
        n, r = divmod(n, 58)
        out = addresses.BASE58[r] + out
    return "1" * (len(raw) - len(raw.lstrip(b"\0"))) + out


def test_addresses(spark):
    key = "0279be667ef9dcbbac55a06295ce870b07029bfcdb2dce28d959f2815b16f81798"  # the generator, a public constant
    texts = [f"pay {encode58(bytes([0]) + bytes(range(20)))} now", encode58(bytes([5]) + b"x" * 20)[:-1] + "2", "BC1 bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4 end", f"<{key}>", "02" + "f" * 64, "plain", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    got = addresses.find(rows, "k", F.col("t")).collect()
    assert sorted((r.k, r.kind, r.state) for r in got) == [(0, "base58", "p2pkh"), (1, "base58", "invalid"), (2, "bech32", "bech32"), (3, "sec_hex", "public_key"), (4, "sec_hex", "invalid")]
    assert not any(key in str(value) for r in got for value in r)


def test_unit_size_and_partitions_do_not_change_hits(spark, tmp_path):
    ranged.register(spark)
    r = random.Random(3)
    data = bytes(r.choice(b"ab") for _ in range(5000))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "B.img").write_bytes(data)
    (tmp_path / "in" / "a.bin").write_bytes(data[:777])
    (tmp_path / "in" / "empty").write_bytes(b"")
    (tmp_path / "in" / "link").symlink_to(tmp_path)
    patterns = [("abba", b"abba"), ("aa", b"aa"), ("bb", b"bb")]
    want = sorted((n, i, i + len(p), s) for n, d in (("B.img", data), ("a.bin", data[:777])) for s, p in patterns for i in scan.occurrences(d, p))
    for chunk, overlap in ((1 << 20, 8), (100, 3), (64, 16), (7, 3)):
        u = spark.read.format("ranged").option("path", str(tmp_path / "in")).option("chunk", chunk).option("overlap", overlap).load()
        assert [x.source_id for x in u.where("failure = 'link'").collect()] == ["link"]
        got = scan.scan(u.where("failure IS NULL"), patterns).select("source_id", "start", "end", "signature").collect()
        assert sorted(map(tuple, got)) == want
    part = spark.read.format("ranged").option("path", str(tmp_path / "in" / "B.img")).option("chunk", 100).option("overlap", 3).option("start", 1000).option("end", 2000).load()
    got = scan.scan(part, patterns).select("start", "end", "signature").collect()
    assert sorted(map(tuple, got)) == sorted((a, b, s) for n, a, b, s in want if n == "B.img" and a >= 1000 and b <= 2000)


def test_one_hit_of_each_target_and_kind_at_a_place(spark):
    rows = [("s", 0, 2, "late", 1, "t", "k"), ("s", 0, 2, "first", 0, "t", "k"), ("s", 0, 2, "other", 2, "u", "k"), ("s", 0, 2, "kind", 3, "t", "l"), ("s", 0, 3, "late", 1, "t", "k")]
    hits = spark.createDataFrame(rows, "source_id string, start long, end long, signature string, detector int, target string, kind string")
    assert sorted((r.end, r.signature) for r in scan.deduplicated(hits).collect()) == [(2, "first"), (2, "kind"), (2, "other"), (3, "late")]


def test_units(spark):
    got = units(spark.createDataFrame([("a", 10), ("b", 0), ("c", 4), ("d", 5)], "source_id string, size long"), 4, 1).orderBy("source_id", "scan_start").collect()
    assert [(r.source_id, r.scan_start, r.scan_end, r.own_end) for r in got] == [("a", 0, 4, 3), ("a", 3, 7, 6), ("a", 6, 10, 10), ("c", 0, 4, 4), ("d", 0, 4, 3), ("d", 3, 5, 5)]


def test_resumed_scan_equals_a_clean_one(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"ab{i % 3}ab") for i in range(30)], "k long, t string")
    all_ = scan.text_units(rows, "k", F.col("t"))
    patterns = [("ab", b"ab")]
    folder = str(tmp_path / "out")
    resume.scan_step(all_.where("source_id < 11"), patterns, folder)
    resume.scan_step(all_, patterns, folder)
    resume.scan_step(all_, patterns, folder)
    assert sorted(map(tuple, resume.results(spark, folder).collect())) == sorted(map(tuple, scan.scan(all_, patterns).select(*resume.results(spark, folder).columns).collect()))


def test_watch(spark, tmp_path):
    rows = [(i, f"xx ab {i}") for i in range(20)]
    source, out, state = (str(tmp_path / n) for n in ("source", "out", "state"))
    for part in (rows[:12], rows[12:]):
        spark.createDataFrame(part, "k long, t string").write.mode("append").parquet(source)
        resume.watch(spark, source, "k long, t string", "k", "t", [("ab", b"ab")], out, state).awaitTermination()
    assert sorted(r.source_id for r in spark.read.parquet(out).collect()) == list(range(20))
