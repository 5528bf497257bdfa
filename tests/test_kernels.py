import hashlib
import hmac as library
import json
import random
import unicodedata

from pyspark.sql import functions as F

from siftwell.functions import addresses, framing, kernels


def base58(payload):
    raw = payload + hashlib.sha256(hashlib.sha256(payload).digest()).digest()[:4]
    n, out = int.from_bytes(raw, "big"), ""
    while n:
        n, i = divmod(n, 58)
        out = addresses.BASE58[i] + out
    return "1" * (len(raw) - len(raw.lstrip(b"\0"))) + out


def test_private_key_shapes(spark):
    scalar = (12345).to_bytes(32, "big")
    plain, short = base58(b"\x80" + scalar), base58(b"\x80" + scalar + b"\1")
    zero, wrong = base58(b"\x80" + b"\0" * 32), base58(b"\x80" + scalar + b"\2")
    broken = plain[:-1] + ("2" if plain[-1] != "2" else "3")
    rows = [(1, f"é {plain} and {short}."), (2, f"{zero} {broken}"), (3, wrong), (4, "none"), (5, None), (6, ""), (7, "x" + plain), (1, plain)]
    got = kernels.private_keys(spark.createDataFrame(rows, "id long, t string"), "id", F.col("t")).collect()
    want = [(1, 2, 2 + len(plain), "VALID_UNCOMPRESSED"), (1, 7 + len(plain), 7 + len(plain) + len(short), "VALID_COMPRESSED"), (1, 0, len(plain), "VALID_UNCOMPRESSED"), (2, 0, len(zero), "PRIVATE_SCALAR_INVALID"), (2, len(zero) + 1, len(zero) + 1 + len(broken), "CHECKSUM_INVALID"), (3, 0, len(wrong), "REJECTED")]
    assert sorted((r.id, r.start, r.end, r.state) for r in got) == sorted(w for w in want if w[3] != "REJECTED" or wrong[0] in "5KL")
    assert all((r.fingerprint is not None) == r.state.startswith("VALID") and plain not in str(r) for r in got)


def test_public_keys_at_any_offset(spark):
    # the group's generator and its double, fixed by the standard
    g = bytes.fromhex("0279BE667EF9DCBBAC55A06295CE870B07029BFCDB2DCE28D959F2815B16F81798")
    assert addresses.on_curve(g)
    data = b"\2\3" + g + b"\4" * 70 + g[:-1]
    rows = spark.createDataFrame([(1, data), (2, None), (3, b"")], "id long, data binary")
    got = kernels.binary_keys(rows, "id").collect()
    want = [(i, i + n) for i in range(len(data)) for n in (33, 65) if i + n <= len(data) and addresses.on_curve(data[i : i + n])]
    assert sorted((r.start, r.end) for r in got) == sorted(want) and (2, 35) in want


def test_objects():
    inner = '{"b": "}{", "c": {"d": 1}}'
    data = ('junk } { "' + "x" + '{"a": ' + inner + "} tail {").encode()
    at = data.index(b'"d"')
    found = [json.loads(data[a:b]) for a, b in kernels.objects(data, at)]
    assert found == [{"a": json.loads(inner)}, json.loads(inner), {"d": 1}]
    assert kernels.objects(b'{"a": 1', 2) == [] and kernels.objects(b"", 0) == [] and kernels.objects(b"{}", 1) == [(0, 2)]
    assert kernels.objects(b'["q", {"k": "\\"}"}]', 8) == [(6, 18)]


def test_plain(spark):
    texts = ["ＡＢＣ  Ｄ", "Éa\u0301 b", "", " \t", None, "中 文 字 a 字", "ひ らが", "ﬁne ②"]
    got = [r.t for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", kernels.normalized("t").alias("t")).orderBy("i").collect()]

    def brute(t):
        v = "".join(c for c in unicodedata.normalize("NFKD", t).lower() if not unicodedata.combining(c))
        v = " ".join(v.split())
        return "".join(c for i, c in enumerate(v) if not (c == " " and 0 < i < len(v) - 1 and kernels._cjk(v[i - 1]) and kernels._cjk(v[i + 1])))

    assert got == [None if t is None else brute(t) for t in texts] and got[5] == "中文字 a 字"


def test_mnemonic_status(spark):
    def phrase(entropy):
        bits = "".join(f"{b:08b}" for b in entropy) + f"{hashlib.sha256(entropy).digest()[0]:08b}"[: len(entropy) // 4]
        return [int(bits[i : i + 11], 2) for i in range(0, len(bits), 11)]

    r = random.Random(1)
    good = [phrase(r.randbytes(n)) for n in (16, 20, 24, 28, 32)]
    bad = [[*p[:-1], p[-1] ^ 1] for p in good]
    rows = [(p,) for p in [*good, *bad, good[0][:-1], [-1, *good[0][1:]]]]
    got = [x.s for x in spark.createDataFrame(rows, "p array<int>").coalesce(1).select(kernels.mnemonic_statuses("p").alias("s")).collect()]
    assert got == ["BIP39_VALID"] * 5 + ["BIP39_CHECKSUM_INVALID"] * 5 + ["BIP39_WORD_COUNT_INVALID", "BIP39_WORD_INVALID"]


def test_hmac(spark):
    df = spark.createDataFrame([(bytearray(b"message"),), (bytearray(b""),)], "m binary").coalesce(1)
    for key in (b"k", b"long" * 60):
        for bits in (256, 512):
            got = [r.h for r in df.select(framing.hmac(key, F.col("m"), bits).alias("h")).collect()]
            assert got == [library.new(key, m, f"sha{bits}").hexdigest() for m in (b"message", b"")]


def test_framing_of_cut_data(spark):
    df = spark.createDataFrame([(bytearray(x),) for x in (b"", b"\xfd\x01", b"\xfe\x01\x02", b"\xff" * 3, b"\x80\x80", b"\x03ke", b"\x41" + b"a" * 70)], "d binary")
    got = df.select(framing.compact_size(F.col("d")).alias("c"), framing.varint(F.col("d")).alias("v"), framing.der_length(F.col("d")).alias("l"), framing.record_type(F.col("d")).alias("r"), F.size(framing.mbr(F.col("d"))).alias("m"), framing.gpt(F.col("d")).alias("g")).collect()
    assert [r.c is None for r in got] == [True, True, True, True, False, False, False]
    assert got[4].v is None and all(r.r is None and not r.m for r in got)


def test_paths(spark):
    rows = [("C:\\A\\..\\b\\.\\C.txt", "c:\\b\\c.txt"), ("//x///Y/", "x\\y"), ("", ""), ("../a", "a"), ("É/ß", "é\\ß")]
    got = spark.createDataFrame(rows, "p string, want string").select(framing.path_identity(F.col("p")).alias("p"), "want").collect()
    assert all(r.p == r.want for r in got), got
