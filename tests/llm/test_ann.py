import math

import numpy as np

from siftwell.llm import ann


def brute(rows, every, k):
    seen, good = set(), []
    for i, v in rows:
        if i is None or v is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v) or (i, tuple(v)) in seen:
            continue
        seen.add((i, tuple(v)))
        good.append((i, np.float32(v).astype(float)))
    out = {}
    for q, v in good:
        if q % every == 0:
            d = sorted((float(np.sqrt(((v - w) ** 2).sum())), i) for i, w in good if i != q)
            out[q] = d[:k]
    return out


def held(spark, rows, every, least, k=10):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.search(frame, k, every).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    want = brute(rows, every, k)
    assert got.keys() == want.keys()
    hit = total = 0
    for q, w in want.items():
        assert len(got[q]) == len(w) and got[q] == sorted(got[q])
        hit += len({i for _, i in got[q]} & {i for _, i in w})
        total += len(w)
    assert hit >= least * total, hit / max(1, total)
    return got, want


def test_recall(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    held(spark, rows, 20, 0.97)


def test_ties_and_copies(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(0, 1, (300, 8)).astype(np.float32)
    rows = [(i, base[i % 300 if i < 300 else 7].tolist()) for i in range(900)]
    got, want = held(spark, rows, 50, 1.0)
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]]
        assert np.allclose([s for s, _ in got[q]], [s for s, _ in want[q]], rtol=1e-12)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0, 3.0]), (0, [1.0, 2.0, 3.0]), (1, None), (2, []), (3, [0.0, 0.0, 0.0]), (4, [1.0, None, 1.0]), (5, [nan, 1.0, 1.0]), (6, [inf, 1.0, 1.0]), (None, [1.0, 2.0, 3.0]), (7, [1.0, 2.0, 4.0]), (8, [-1.0, 2.0, 4.0])]
    got, want = held(spark, rows, 4, 1.0)
    assert [i for _, i in got[0]] == [7, 8] and [i for _, i in got[8]] == [7, 0]
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>, score string")
    assert ann.search(frame).count() == 0


def test_cluster_of_near_copies(spark):
    """Thousands of slightly different vectors share a code; the nearest of them are found whole."""
    rng = np.random.default_rng(6)
    one = rng.normal(0, 1, 16)
    rows = [(i, x.tolist()) for i, x in enumerate(np.concatenate([one + rng.normal(0, 1e-3, (3000, 16)), rng.normal(0, 1, (1000, 16))]).astype(np.float32))]
    held(spark, rows, 100, 1.0)
