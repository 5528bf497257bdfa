"""Centroid clustering by the threshold algorithm.

A centroid is sought for a vector as the nearest row of a table with one sorted list a dimension: each list
holds the centroids' values in that dimension and is walked outward from the vector's own value, nearest
value first. A centroid that turns up in a list is compared exactly. What has not turned up yet is in every
dimension at least as far as the list's frontier, so the squared distances of the frontiers add up to a bound
for all of them; the walk ends when that sum is strictly greater than the best exact distance, which keeps
ties. Components are integers, and so is all arithmetic.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

#: Centroids, rounds of moving them, components of a vector, and the factor before components are rounded down.
CENTROIDS, ROUNDS, WIDTH, SCALE = 16, 3, 64, 64
#: Vectors that walk together.
TOGETHER = 4096
#: Integers below this are added and squared in 64 bits; a batch with larger ones goes through Python's integers.
SMALL = 1 << 26
#: Bits of a limb of a sum, and limbs: room for the largest single-precision component times SCALE, 2^40 times.
LIMB, LIMBS = 48, 4
LONGEST = (1 << 63) - 1


def integers(vectors: Iterable, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of every component; Python integers where one needs more than 64-bit squares allow."""
    x = np.floor(np.array([*vectors], float) * scale)
    return x.astype(np.int64) if not x.size or np.abs(x).max() < SMALL else np.vectorize(int, otypes=[object])(x)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of and squared distance to each row's nearest centroid (ties: the smaller number), and how many were compared."""
    if x.dtype == object or centroids.dtype == object or np.abs(centroids).max(initial=0) >= SMALL:
        x, centroids = x.astype(object), centroids.astype(object)
    k, width = centroids.shape
    order = np.argsort(centroids, axis=0, kind="stable")
    lists, dims = np.take_along_axis(centroids, order, 0), np.arange(width)
    number, distance, compared = np.zeros(len(x), np.int64), np.zeros(len(x), x.dtype), 0
    for a in range(0, len(x), TOGETHER):
        rows = np.arange(a, min(a + TOGETHER, len(x)))
        v = x[rows]
        right = np.stack([np.searchsorted(lists[:, d], v[:, d]) for d in dims], axis=1)
        left = right - 1
        known, exact = np.zeros((len(rows), k), bool), np.zeros((len(rows), k), x.dtype)
        while len(rows):
            gap, go_left, ended = _frontier(v, lists, left, right)
            # a centroid that has not turned up stands in every list beyond the frontier
            best = np.where(known, exact, exact.max() + 1).argmin(1)
            done = known.any(1) & (ended | ((gap * gap).sum(1) > exact[np.arange(len(rows)), best]))
            number[rows[done]], distance[rows[done]] = best[done], exact[done, best[done]]
            compared += int(known[done].sum())
            rows, v, left, right, known, exact, go_left = (y[~done] for y in (rows, v, left, right, known, exact, go_left))
            turned = np.zeros_like(known)
            turned[np.arange(len(rows))[:, None], order[np.where(go_left, left, right), dims]] = True
            i, c = np.nonzero(turned & ~known)
            difference = v[i] - centroids[c]
            exact[i, c] = (difference * difference).sum(1)
            known |= turned
            left, right = left - go_left, right + ~go_left
    return number, distance, compared


def _frontier(v: np.ndarray, lists: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How far the next value of each list is, whether it is the left one, and which rows have walked a whole list."""
    k, dims = len(lists), np.arange(lists.shape[1])
    below, above = v - lists[np.maximum(left, 0), dims], lists[np.minimum(right, k - 1), dims] - v
    go_left = (left >= 0) & ((right >= k) | (below <= above))
    return np.where(go_left, below, above), go_left, ((left < 0) & (right >= k)).any(1)


def _limbs(total: int) -> list[int]:
    out = []
    for _ in range(LIMBS - 1):
        total, low = total >> LIMB, total & ((1 << LIMB) - 1)
        out.append(low)
    return [*out, total]


def moved(vectors: DataFrame, centroids: np.ndarray, scale: int) -> np.ndarray:
    """The centroids after one round: the floor of the mean of each one's vectors; one without vectors stays.

    Each task adds up its own vectors; what is shuffled is a row a centroid, dimension and task, and what
    comes to the driver a row a centroid and dimension.
    """
    k, width = centroids.shape
    held = vectors.sparkSession.sparkContext.broadcast(centroids)

    def added(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, sums = [0] * k, np.zeros((k, width), object)
        for batch in batches:
            x = integers(batch["embedding"], scale) if len(batch) else np.zeros((0, width), np.int64)
            number, _, _ = nearest(x, held.value)
            for c in np.unique(number):
                own = x[number == c]
                counts[c], sums[c] = counts[c] + len(own), sums[c] + own.sum(0).astype(object)
        yield pd.DataFrame(
            [(c, d, counts[c], *_limbs(int(sums[c, d]))) for c in range(k) if counts[c] for d in range(width)],
            columns=["c", "d", "n", *(f"l{i}" for i in range(LIMBS))],
        )

    parts = vectors.select("embedding").mapInPandas(added, "c int, d int, n long, " + ", ".join(f"l{i} long" for i in range(LIMBS)))
    whole = parts.groupBy("c", "d").agg(F.sum("n").alias("n"), *(F.sum(F.col(f"l{i}").cast("decimal(38,0)")).alias(f"l{i}") for i in range(LIMBS)))
    out = centroids.astype(object)
    for row in whole.toLocalIterator():
        out[row.c, row.d] = sum(int(row[f"l{i}"]) << (LIMB * i) for i in range(LIMBS)) // row.n
    return out.astype(np.int64) if all(abs(v) < SMALL for v in out.flat) else out


def whole(vectors: DataFrame, width: int = WIDTH) -> DataFrame:
    """``(vec_id, embedding)`` of the vectors with exactly ``width`` components, none null or non-finite. Repeated rows stay."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where((F.size("embedding") == width) & F.coalesce(finite, F.lit(False))).select("vec_id", "embedding")


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that ``whole`` keeps.

    Centroids start as the ``k`` vectors whose ids have the smallest sha256; rows that repeat an id are told
    apart by their components, a null id comes last. Fewer vectors than ``k`` give fewer centroids, an empty
    table no rows. Vectors that are left out have no row. Repeated rows each have one and count each. A squared
    distance or a sum of them beyond 64 bits is given as the largest long. Other columns are ignored.
    """
    spark = vectors.sparkSession
    v = materialize(whole(vectors, width), "vectors")
    first = v.orderBy(F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")).cast("binary"), 256).asc_nulls_last(), "embedding").limit(k).collect()
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], schema)
    centroids = integers([r.embedding for r in first], scale)
    for _ in range(rounds):
        centroids = moved(v, centroids, scale)
    held = spark.sparkContext.broadcast(centroids)

    def assigned(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                number, distance, _ = nearest(integers(batch["embedding"], scale), held.value)
                yield pd.DataFrame({"vec_id": batch["vec_id"].astype("Int64"), "cluster": number, "distance": [min(int(d), LONGEST) for d in distance]})

    out = materialize(v.mapInPandas(assigned, "vec_id long, cluster int, distance long"), "assigned")
    each = out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own")).collect()
    own, limit = {r.cluster: int(r.own) for r in each}, lambda n: min(n, LONGEST)
    digest = lambda c: hashlib.sha256(",".join(str(int(x)) for x in centroids[c]).encode()).hexdigest()
    facts = spark.createDataFrame(
        [(c, limit(n), limit(sum(own.values())), digest(c)) for c, n in own.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    )
    # a row a centroid
    return out.join(F.broadcast(facts), "cluster").select(*(x.split()[0] for x in schema.split(", ")))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def _sql() -> str:
    """Rounds one after the other, with all distances."""
    steps = [f"""
        WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding::DOUBLE[], lambda x: floor({SCALE} * x)::BIGINT) AS x, embedding AS e FROM embeddings
                   WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
        c0 AS (SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id), e) - 1)::INTEGER AS cluster, x FROM v QUALIFY cluster < {CENTROIDS})"""]  # fmt: skip
    for i in range(ROUNDS + 1):
        steps.append(f"""
        a{i} AS (SELECT r, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM (
                    SELECT v.r, c.cluster, list_sum(list_transform(range(1, {WIDTH} + 1), lambda j: (v.x[j] - c.x[j]) * (v.x[j] - c.x[j])))::BIGINT AS d FROM v, c{i} c) GROUP BY r)""")  # fmt: skip
        if i < ROUNDS:
            steps.append(f"""
        m{i} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY j)::BIGINT[] AS x FROM (
                    SELECT a.cluster, j, sum(v.x[j])::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{i} a JOIN v USING (r), range(1, {WIDTH} + 1) t(j) GROUP BY ALL) GROUP BY cluster),
        c{i + 1} AS (SELECT c.cluster, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN m{i} m USING (cluster))""")  # fmt: skip
    return ",".join(steps) + f"""
        SELECT v.vec_id, a.cluster, a.distance, (sum(a.distance) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia, (sum(a.distance) OVER ())::BIGINT AS inertia,
               sha256(array_to_string(c.x, ',')) AS centroid_sha256
        FROM a{ROUNDS} a JOIN v USING (r) JOIN c{ROUNDS} c USING (cluster)"""  # fmt: skip


SQL = _sql()
