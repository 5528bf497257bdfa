import hashlib
import random

import numpy as np

from siftwell.llm import centroids

COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def brute(rows, k=16, rounds=3, width=64, scale=64):
    """Everything with Python's integers and all distances."""
    kept = [(i, [int(np.floor(float(x) * scale)) for x in e], e) for i, e in rows if e is not None and len(e) == width and all(x is not None and np.isfinite(x) for x in e)]
    order = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[2])
    cs = [x for _, x, _ in sorted(kept, key=order)[:k]]
    d = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    near = lambda x: min(range(len(cs)), key=lambda c: (d(x, cs[c]), c))
    for _ in range(rounds):
        own = [near(x) for _, x, _ in kept]
        for c in range(len(cs)):
            if mine := [x for (_, x, _), o in zip(kept, own, strict=True) if o == c]:
                cs[c] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    own = [near(x) for _, x, _ in kept]
    dist = [min(d(x, cs[o]), 2**63 - 1) for (_, x, _), o in zip(kept, own, strict=True)]
    inertia = {o: min(sum(y for y, p in zip(dist, own, strict=True) if p == o), 2**63 - 1) for o in own}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return [(i, o, y, inertia[o], min(sum(dist), 2**63 - 1), digest[o]) for (i, _, _), o, y in zip(kept, own, dist, strict=True)]


def same(spark, rows, schema="vec_id long, embedding array<float>", **how):
    got = centroids.cluster(spark.createDataFrame(rows, schema), **how).select(COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute([r[:2] for r in rows], **how), key=str)


def test_walk_finds_the_nearest_and_stops_early():
    r = np.random.default_rng(2)
    for n, k, width, spread in ((700, 16, 64, 6), (900, 40, 2, 500), (60, 1, 3, 4), (80, 7, 1, 3)):
        x, c = r.integers(-spread, spread, (n, width)), r.integers(-spread, spread, (k, width))
        number, distance, compared = centroids.nearest(x, c)
        every = ((x[:, None] - c[None]) ** 2).sum(2)
        assert (number == every.argmin(1)).all() and (distance == every.min(1)).all()
        if width == 2:
            assert compared < n * k / 3
    huge = x.astype(object) * 10**30
    number, distance, _ = centroids.nearest(huge, c.astype(object) * 10**30)
    assert (number == every.argmin(1)).all() and distance[0] == int(every.min(1)[0]) * 10**60


def test_odd_vectors(spark):
    r = random.Random(4)
    # values that single precision holds exactly, ties on purpose
    vector = lambda: [r.randrange(-8, 8) / 64 for _ in range(64)]
    rows = [(i, vector()) for i in range(90)] + [(7, vector()), (None, vector()), (None, None), (-3, [0.0] * 64), (500, [-0.004] * 64)]
    rows += [(200, [1.0] * 63), (201, [1.0] * 65), (202, []), (203, [None] + [1.0] * 63), (204, [float("nan")] + [1.0] * 63), (205, [float("inf")] + [1.0] * 63)]
    rows += [rows[5]] * 40 + [(300 + i, rows[6][1]) for i in range(40)]
    same(spark, rows)
    same(spark, rows[:3])
    same(spark, rows, k=5, rounds=1)
    assert centroids.cluster(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).collect() == []


def test_components_beyond_64_bits(spark):
    r = random.Random(5)
    rows = [(i, [float(r.randrange(-4, 4)) * 2.0 ** r.choice((0, 60, 120))] * 64) for i in range(30)]
    same(spark, rows, k=4)


def test_clashing_columns(spark):
    rows = [(i, [i / 64] * 64, "x", "y") for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster string, distance string")
    assert sorted(map(tuple, centroids.cluster(df).select(COLUMNS).collect()), key=str) == sorted(brute([r[:2] for r in rows]), key=str)
