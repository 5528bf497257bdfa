"""Every query against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from siftwell.plans import catalog

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_same_rows(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    if name not in catalog.ORACLES:
        # its own test holds it against brute force
        assert len(got.columns) == len(set(got.columns)) and got.schema == catalog.QUERIES[name](spark, SF).schema
        return
    want = duck.execute(catalog.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = lambda data: sorted((tuple(map(plain, r)) for r in data), key=str)
    assert rows(got.select(columns).collect()) == rows(want.fetchall())


def test_queries_without_sql(spark, tmp_path):
    """On texts that hold what the given tables don't."""
    from .test_kernels import base58

    address, segwit = base58(b"\0" + bytes(range(20))), "BC1QW508D6QEJXTDG4Y5R3ZARVARY0C5XW7KV8F3T4"
    point = "0279BE667EF9DCBBAC55A06295CE870B07029BFCDB2DCE28D959F2815B16F81798"
    key = base58(b"\x80" + (7).to_bytes(32, "big"))
    texts = [f"é {address}, {segwit} {segwit.lower()}x", f"{address[:-1]}x {point} 05{point[2:]}", f"{segwit[:-1]}q {segwit.lower()}", key, None, "", f"{key} {key[:-2]}11"]
    for name, columns in (("documents", "doc_id long, text string"), ("pages", "page_id long, html string"), ("conversations", "conv_id long, text string")):
        rows = list(enumerate(texts)) if name != "pages" else []
        spark.createDataFrame(rows, columns).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = {r.source: tuple(r)[1:] for r in catalog.QUERIES["address_context"](spark, str(tmp_path)).collect()}
    # an address, segwit in upper case, and in lower case with an x behind; a broken address, a point and no point; segwit of mixed case, and in lower case
    assert got == {n: (7, 8, 4, 3) for n in ("documents", "conversations")}
    states = {(r.source, r.state): (r.shapes, r.distinct_valid) for r in catalog.QUERIES["private_key_shapes"](spark, str(tmp_path)).collect()}
    assert states == {(n, s): c for n in ("documents", "conversations") for s, c in (("VALID_UNCOMPRESSED", (2, 1)), ("CHECKSUM_INVALID", (1, 0)))}
    import hashlib

    from siftwell.functions import kernels

    got = {r.doc_id: (r.length, r.fingerprint) for r in catalog.QUERIES["normalized_texts"](spark, str(tmp_path)).collect()}
    assert got == {i: (None, None) if t is None else (len(kernels.plain(t)), hashlib.sha256(kernels.plain(t).encode()).hexdigest()) for i, t in enumerate(texts)}


def test_every_part_and_line(spark, tmp_path):
    """Parts from 40 on have trees, keys that 500 would fold stay apart, and lines without a partner have a row."""
    lines = [(1, 1, 7, 1, 5.0), (1, 2, 7, 2, 5.0), (2, 1, 507, 1, 5.0), (3, 1, 507, 1, 5.0), (4, 3, 507, 1, 6.0), (5, 4, 507, 3, 6.0), (6, 4, 507, 3, 7.0), (6, 5, 507, 4, 6.0), (6, 6, 507, 4, 9.0)]
    tables = {
        "lineitem": (lines, "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_quantity double"),
        "part": ([(7,), (39,), (40,), (507,)], "p_partkey long"),
        "supplier": ([(1, 3), (2, 3), (3, 4), (9500, 5)], "s_suppkey long, s_nationkey int"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    nation = {s: n for s, n in tables["supplier"][0]}
    want = {(f"p{p}", f"p{p}", 0, 0) for (p,) in tables["part"][0]} | {(f"p{x[2]}", f"s{x[3]}", 1, 1) for x in lines}
    of = {(x[2], x[3]) for x in lines if x[3] in nation}
    want |= {(f"p{p}", f"n{nation[s]}", 2, sum(q == p and nation[t] == nation[s] for q, t in of)) for p, s in of}
    got = catalog.QUERIES["part_tree_all"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want

    def named(a):
        others = [b for b in lines if b[2] == a[2] and b[0] != a[0]]
        ranks = [0 if b[3:] == a[3:] else 1 if b[3] == a[3] else 2 if b[4] == a[4] else 3 for b in others]
        return ("BYTE_IDENTICAL", "STRUCTURALLY_SIMILAR", "SIZE_MATCH_ONLY", "NO_MATCH")[min(ranks, default=3)]

    got = catalog.QUERIES["fingerprint_compare_all"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted((*a[:3], named(a)) for a in lines)


def test_nearest_supplier_of_odd_balances(spark, tmp_path):
    """Against the SQL, with nations that lack suppliers, equal balances on both sides, and balances that are none; no frame runs from a row to the end of a nation."""
    inf, nan = math.inf, math.nan
    values = [-999.5, -64.0, -0.0, 0.0, 63.99, 64.0, 500.25, 1e12, -1e12, inf, -inf, nan, None]
    have = {1: [0.0, 128.0, 128.0, -0.0], 2: [], 3: [None, None], 4: [nan, None], 5: [inf, -inf, nan], 6: [7.0, inf, None], None: [1.0], 7: [5000.0, -5000.0], 8: [None, 3.0]}
    c = [(100 * i + j, n, b) for i, n in enumerate(have) for j, b in enumerate(values)]
    s = [(900 - 10 * i - j, n, b) for i, (n, bs) in enumerate(have.items()) for j, b in enumerate(bs)]
    spark.createDataFrame(c, "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame(s, "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(str(tmp_path / "supplier.parquet"))
    con = duckdb.connect()
    for t in ("customer", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    df = catalog.QUERIES["customer_nearest_supplier"](spark, str(tmp_path)).select("c_custkey", "s_suppkey", "distance")
    rows = lambda data: sorted(map(str, data))
    assert rows(map(tuple, df.collect())) == rows(con.execute(catalog.ORACLES["customer_nearest_supplier"]).fetchall())
    plan = df._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "unboundedfollowing" not in plan.replace("unboundedpreceding$(), unboundedfollowing", "")
