"""Journals and logs in chunks: however a stream is cut, its rows are the same."""

import random
import struct

import pytest

from siftwell.functions import journals
from siftwell.streaming import carry


def change(name="wallet.dat", major=2, file=70, parent=5, ticks=132_000_000_000_000_000, reason=0x100, **wrong):
    text = name.encode("utf-16-le")
    wide, head = (8, 60) if major == 2 else (16, 76)
    body = file.to_bytes(wide, "little") + parent.to_bytes(wide, "little") + struct.pack("<QqIIIIHH", 7, ticks, reason, 0, 0, 32, len(text), head) + text
    length = wrong.get("length", (8 + len(body) + 7) // 8 * 8)
    return (struct.pack("<IHH", length, wrong.get("version", major), 0) + body).ljust(length, b"\0")


def log_page(mark, size, body, next_record=0, system=None, number=b"\x07\x01", broken=False):
    page = bytearray(size)
    page[:4] = mark
    struct.pack_into("<HH", page, 4, 40, size // 512 + 1)
    page[body[0] : body[0] + len(body[1])] = body[1]
    struct.pack_into("<H", page, 24, body[0] if mark == b"RSTR" else next_record)
    if mark == b"RSTR":
        struct.pack_into("<II", page, 16, system or size, size)
    page[40:42] = number
    for i in range(1, size // 512 + 1):
        page[40 + 2 * i : 42 + 2 * i] = page[i * 512 - 2 : i * 512]
        page[i * 512 - 2 : i * 512] = b"\xff\xff" if broken else number
    return bytes(page)


def restart(size=4096, header=48, start=64):
    return log_page(b"RSTR", size, (80, struct.pack("<20xH14xHH", 44, header, start).ljust(44, b"\0")))


def log_record(lsn, text, kind=1, length=None):
    data = text.encode("utf-16-le")
    return (struct.pack("<QQQIIIIH6x", lsn, 2, 1, len(data) if length is None else length, 3, kind, 9, 1) + data).ljust((48 + len(data) + 7) // 8 * 8, b"\0")


def record_page(*records, size=4096, start=64, broken=False):
    body = b"".join(records)
    return log_page(b"RCRD", size, (start, body), start + len(body), broken=broken)


def cut(data, sizes, r):
    out, at = [], 0
    while at < len(data):
        n = r.choice(sizes)
        out.append((at, data[at : at + n], 10_000 + 3 * at, False))
        at += n
    return out


def parsed(parser, chunks):
    stream = carry.Stream(parser)
    rows = [row for c in chunks for row in stream.chunk(*c)]
    return [r[:-1] for r in rows + stream.end()]


JOURNAL = change() + bytes(24) + change("a.txt", 3, file=1 << 100) + b"\xee" * 16 + change("bad/name") + change(ticks=0) + change(file=0) + change(length=56)[:56] + change("notes.md", version=9) + change("last.dat")[:-8]
LOG = restart() + record_page(log_record(5, "C:\\x\\wallet.dat"), log_record(6, "run\\electrum.exe"), log_record(7, "zzzz", kind=9), log_record(8, "lost.dat")) + bytes(4096) + record_page(log_record(9, "users\\a\\bitcoin\\wallets\\mine"), broken=True) + b"JUNK" * 128 + record_page(log_record(0, "no lsn"))[:4096] + restart(2048) + record_page(log_record(11, "electrum.dat"), log_record(12, "tt", length=900), size=2048) + restart()[:700]
TEXT = "wallet.dat".encode("utf-16-le") + b"\0\0\1" + "longer run of text".encode("utf-16-le") + b"\0\0" + ("x" * 1030).encode("utf-16-le") + b"\0\0abc\0" + "odd".encode("utf-16-be")


@pytest.mark.parametrize("parser, data", [(journals.Changes, JOURNAL), (journals.Log, LOG), (journals.Runs, TEXT)])
def test_rows_do_not_depend_on_chunks(parser, data):
    r = random.Random(1)
    want = parsed(parser, [(0, data, 10_000, False)])
    assert len(want) > 3
    for sizes in ([1], [2, 3, 7], [8], [512], [500, 1000, 5000], [len(data)]):
        if sizes != [1] or len(data) < 5000:
            assert sorted(parsed(parser, cut(data, sizes, r)), key=str) == sorted(want, key=str)


def test_change_records():
    rows = parsed(journals.Changes, [(0, JOURNAL, None, False)])
    good = [r for r in rows if r[-1] is None]
    assert [(r[2], r[8]) for r in good] == [(2, "wallet.dat"), (3, "a.txt")] and int(good[1][3], 16) == 1 << 100
    assert {r[-1] for r in rows} == {None, journals.CHANGE_SHAPE, journals.CHANGE_TEXT, journals.CHANGE_CUT["end"]}
    odd = change()[:56] + struct.pack("<HH", 999, 60) + change()[60:]
    assert parsed(journals.Changes, [(0, odd, None, False)])[0][-1] == journals.CHANGE_NAME


def test_log_pages():
    rows = parsed(journals.Log, [(0, LOG, None, False)])
    assert [int(r[3]) for r in rows if r[0] == "record"] == [5, 6, 11]
    assert [r[0] for r in rows if r[0] in ("restart", "page")] == ["restart", "page", "page", "restart", "page"]
    assert [r[-1] for r in rows if r[-1]] == ["lfs_record_type_unknown", "lfs_usa_mismatch", "lfs_page_signature_invalid", "lfs_record_lsn_invalid", "lfs_client_data_bounds_invalid", "lfs_page_truncated_at_stream_end"]
    first, second = [r for r in rows if r[0] == "record"][:2]
    assert first[11] == [("bitcoin_core", "C:\\x\\wallet.dat", "HIGH", "BITCOIN_CANONICAL_WALLET_NAME")] and second[11:13] == ([], 1)


@pytest.mark.parametrize(
    "text, want",
    [
        ("a/wallet.dat-journal", "BITCOIN_CANONICAL_WALLET_NAME"), ("Electrum\\Wallets\\mine", "DIRECT_CHILD_OF_ELECTRUM_WALLETS"), ("c:\\bitcoin\\wallets\\w1", "DIRECT_CHILD_OF_BITCOIN_WALLETS"),
        ("c:\\Electrum", "ELECTRUM_DIRECTORY_REFERENCE"), ("my wallet backup.zip", "GENERIC_WALLET_BACKUP_OR_RECOVERY_NAME"), ("wallet backup.txt", None), ("electrum-4.exe-1234.pf", "ignored"), ("notes", None),
    ],
)
def test_names(text, want):
    got = journals.named(text)
    assert (got[3] if isinstance(got, tuple) else got) == want


def test_cost_of_a_log_record(monkeypatch):
    """The texts of a log record are those of ``Runs`` without its arrays for each record, and the parser's schema is read once, not for each row."""
    r = random.Random(4)
    pool = ["wallet.dat", "a", "é", "\u4e00", "\0", "\u200b", " ", "\ud800", "\U0001f600", "]", "\\", "electrum", "x" * 1030, "y" * 1025, "z" * 2049, "    "]
    for _ in range(300):
        data = b"".join(x.encode("utf-16-le", "surrogatepass") if r.random() < 0.9 else r.randbytes(r.randrange(5)) for x in r.choices(pool, k=r.randrange(12)))
        found = {data[a : a + 2 * n].decode("utf-16-le").strip() for a, n, _ in journals.Runs().take(data, 0, "end")[0]} - {""}
        assert journals.texts(data) == sorted(t for t in found if not any(t != o and t in o for o in found))
    chunks = cut(LOG, [300], r)
    want, read, fields = parsed(journals.Log, chunks), [], carry.fields
    monkeypatch.setattr(carry, "fields", lambda schema: read.append(schema) or fields(schema))
    monkeypatch.setattr(journals.Runs, "take", None)
    assert len(want) > 10 and parsed(journals.Log, chunks) == want and len(read) <= 1


def test_gaps_cut(spark):
    r = random.Random(3)
    whole = change("one.dat") + change("two.dat") + change("three.dat")
    rows = [(s, at, d, p, g) for s in range(6) for at, d, p, g in cut(whole, [8, 40, 64], r)]
    df = spark.createDataFrame(rows, "s int, logical_start long, data binary, physical_start long, gap_before boolean")
    got = sorted((x.s, x.offset, x.name) for x in carry.carried(df.repartition(5), ["s"], journals.Changes).collect())
    assert [x[2] for x in got] == ["one.dat", "two.dat", "three.dat"] * 6
    # a gap within the second record
    cuts = [(0, whole[:96], None, False), (96, whole[96:], None, True)]
    df = spark.createDataFrame([(1, *c) for c in cuts] + [(2, 0, whole, 77, None), (3, 0, b"", None, None)], df.schema)
    out = carry.carried(df, ["s"], journals.Changes).collect()
    assert sorted((x.s, x.name) for x in out if x.name) == [(1, "one.dat"), (1, "three.dat"), (2, "one.dat"), (2, "three.dat"), (2, "two.dat")]
    assert [x.failure for x in out if x.s == 1 and x.failure and "truncated" in x.failure] == [journals.CHANGE_CUT["gap"]]
    assert [tuple(y) for x in out if x.s == 2 and x.name == "two.dat" for y in x.segments] == [(80, 157, 80)]
    assert carry.carried(df.limit(0), ["s"], journals.Log).collect() == []


def test_streaming_state(spark, tmp_path):
    r = random.Random(5)
    want = [x for x in parsed(journals.Log, [(0, LOG, None, False)]) if not (x[-1] or "").endswith("end")]
    schema = "s int, logical_start long, data binary, physical_start long, gap_before boolean"
    chunks = cut(LOG, [300, 2000], r)
    for i in range(0, len(chunks), 7):  # a file for each micro-batch
        spark.createDataFrame([(s, *c) for s in (1, 2) for c in chunks[i : i + 7]], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i:04}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = carry.carried_stream(source, ["s"], journals.Log).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out")
    q.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("s", "offset", "kind").collect()
    assert len(got) == 2 * len(want) and {x.s for x in got} == {1, 2}
    assert sorted((x.kind, x.offset, x.failure) for x in got if x.s == 1) == sorted((x[0], x[1], x[-1]) for x in want)
