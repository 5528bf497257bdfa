"""Nearest neighbours by score-aware quantisation, four-bit table scans and exact reranking.

A vector becomes a four-bit code for each pair of components. Codes and code books are chosen under a
loss that weighs the part of the residual along the vector more than the rest, since that part is what
moves the large inner products that decide a search. With the vectors' exact lengths, distances follow
from inner products: |q - x|^2 = |q|^2 + |x|^2 - 2 q x. A query looks up its products with all code words
once; a scan then only adds up table entries, block of codes by block. The best of each query are
compared exactly, on the original vectors in double precision, and so is every other vector of the block
whose distance could still be among the nearest: |q - x| is at least |q - x'| - |x - x'| for the decoded x'.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

#: Neighbours asked for; queries are the rows whose id this divides.
NEIGHBOURS, EVERY = 10, 100
#: Components in a code, code words, and rounds of learning. Vectors learned from: a sample by hash, at most so many.
PART, WORDS, ROUNDS, SAMPLE = 2, 16, 10, 20_000
#: An inner product this share of the largest possible is what the loss cares for.
THRESHOLD = 0.2
#: Vectors in a block of codes, queries in a block, candidates of a query in a block that are compared exactly before the bound is used.
BLOCK, QUERIES, RERANKED = 32_768, 128, 100
#: Queries that are broadcast to the blocks at once, about.
BROADCAST_QUERIES = 4096


def learn(x: np.ndarray, seed: int = 5) -> np.ndarray:
    """Code books (parts, WORDS, PART) for vectors like ``x``, whose width is a multiple of PART."""
    n, d = x.shape
    parts, rng = d // PART, np.random.default_rng(seed)
    books = np.stack([x[rng.choice(n, WORDS, replace=n < WORDS), j * PART : (j + 1) * PART] + rng.normal(0, 1e-6, (WORDS, PART)) for j in range(parts)])
    unit, more = _units(x), _weight(d) - 1
    for _ in range(ROUNDS):
        codes = encode(x, books)
        residual = x - decode(codes, books)
        along = (residual * unit).sum(1)
        for j in range(parts):
            part = slice(j * PART, (j + 1) * PART)
            u, rest = unit[:, part], along - (residual[:, part] * unit[:, part]).sum(1)
            goal = x[:, part] + more * (rest + (x[:, part] * u).sum(1))[:, None] * u
            for c in range(WORDS):
                own = codes[:, j] == c
                if own.any():
                    books[j, c] = np.linalg.solve(own.sum() * np.eye(PART) + more * u[own].T @ u[own], goal[own].sum(0))
            residual[:, part] = x[:, part] - books[j, codes[:, j]]
            along = rest + (residual[:, part] * u).sum(1)
    return books


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _weight(d: int) -> float:
    """Weight of the residual along the vector against that across it, for uniform directions."""
    return max(1.0, (d - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))


def encode(x: np.ndarray, books: np.ndarray, sweeps: int = 2) -> np.ndarray:
    """Codes under the score-aware loss: part by part, each the best given the others."""
    parts, (n, d) = len(books), x.shape
    unit, more = _units(x), _weight(d) - 1
    codes = np.zeros((n, parts), np.uint8)
    for j in range(parts):
        codes[:, j] = ((x[:, None, j * PART : (j + 1) * PART] - books[j][None]) ** 2).sum(2).argmin(1)
    residual = x - decode(codes, books)
    along = (residual * unit).sum(1)
    for _ in range(sweeps):
        for j in range(parts):
            part = slice(j * PART, (j + 1) * PART)
            r = x[:, None, part] - books[j][None]
            moved = (r * unit[:, None, part]).sum(2)
            rest = along - (residual[:, part] * unit[:, part]).sum(1)
            codes[:, j] = ((r**2).sum(2) + more * (rest[:, None] + moved) ** 2).argmin(1)
            residual[:, part] = x[:, part] - books[j, codes[:, j]]
            along = rest + moved[np.arange(n), codes[:, j]]
    return codes


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return np.concatenate([books[j, codes[:, j]] for j in range(len(books))], axis=1)


def packed(codes: np.ndarray) -> np.ndarray:
    """Two codes to a byte."""
    if codes.shape[1] % 2:
        codes = np.pad(codes, ((0, 0), (0, 1)))
    return codes[:, ::2] | codes[:, 1::2] << 4


def scan(queries: np.ndarray, bytes_: np.ndarray, squares: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Approximate squared distances less the queries' own squares, queries by vectors."""
    tables = np.einsum("qjp,jcp->qjc", queries.reshape(len(queries), len(books), PART), books).astype(np.float32)
    if tables.shape[1] % 2:
        tables = np.pad(tables, ((0, 0), (0, 1), (0, 0)))
    pairs = (tables[:, ::2, None, :] + tables[:, 1::2, :, None]).reshape(len(queries), -1, WORDS * WORDS)
    total = np.zeros((len(queries), len(bytes_)), np.float32)
    for j in range(pairs.shape[1]):
        total += pairs[:, j].take(bytes_[:, j], axis=1)
    return squares[None].astype(np.float32) - 2 * total


def _wide(vectors: Iterable, width: int) -> np.ndarray:
    """Rows of doubles, padded to a multiple of PART."""
    x = np.array([*vectors], float).reshape(-1, width)
    return np.pad(x, ((0, 0), (0, -width % PART)))


def _block(held: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame([tuple(np.concatenate(x).tobytes() for x in zip(*held, strict=True))], columns=["ids", "keys", "squares", "residuals", "codes", "vectors"])


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Distances of ``q`` to the rows of ``x``; squares are added component by component, as SQL does."""
    total = np.zeros(len(x))
    for j in range(len(q)):
        total += (q[j] - x[:, j]) ** 2
    return np.sqrt(total)


def nearest(q: np.ndarray, near: np.ndarray, x: np.ndarray, ids: np.ndarray, squares: np.ndarray, residuals: np.ndarray, neighbours: int, reranked: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the block and distances of all ``neighbours`` nearest of ``q``, from its scan ``near`` (infinite where left out)."""
    allowed = np.flatnonzero(near != np.inf)
    first = allowed[np.argpartition(near[allowed], reranked - 1)[:reranked]] if len(allowed) > reranked else allowed
    distance = exact(q, x[first])
    limit = np.partition(distance, neighbours - 1)[neighbours - 1] if len(first) >= neighbours else np.inf
    if len(allowed) > len(first):
        own = float((q**2).sum())
        # the scan adds up single precision numbers; a scan that is not a number decides nothing
        slack = (x.shape[1] + 16) * 2.0**-22 * (np.sqrt(own) + np.sqrt(squares)) ** 2
        bound = np.sqrt(np.maximum(own + near - slack, 0)) - residuals
        left = np.ones(len(near), bool)
        left[first] = False
        more = allowed[left[allowed] & ~(bound[allowed] > limit * (1 + 1e-9))]
        first, distance = np.concatenate([first, more]), np.concatenate([distance, exact(q, x[more])])
    best = np.lexsort((ids[first], distance))[:neighbours]
    return first[best], distance[best]


def valid(vectors: DataFrame) -> DataFrame:
    """Distinct ``(vec_id, key, embedding)`` of the vectors that take part.

    Left out are null ids, null and zero vectors, those with null or non-finite components, and those
    whose width is not the most frequent one (of equally frequent, the larger): distances to them mean
    nothing. A row that repeats another's id and vector counts once.
    """
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & whole & F.exists("embedding", lambda x: x != 0))
    width = v.groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    v = v.where(F.size("embedding") == (width.width if width else 0))
    return v.select("vec_id", F.xxhash64("embedding").alias("key"), "embedding").dropDuplicates(["vec_id", "key"])


def search(vectors: DataFrame, neighbours: int = NEIGHBOURS, every: int = EVERY, reranked: int = RERANKED) -> DataFrame:
    """query_id, rank, vec_id and score, the distance: the ``neighbours`` nearest found of each query, fewer if there are fewer.

    Queries are the vectors whose id ``every`` divides, candidates all with another id. Of candidates at
    one distance the smaller id comes first. Of equal vectors only the ``neighbours`` + 1 with the smallest
    ids can be among a query's nearest, so a vector that very many rows share adds no more than those. An
    empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    v = materialize(valid(vectors), "vectors")
    first = v.select("embedding").limit(1).collect()
    if not first:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, n = len(first[0].embedding), v.count()
    rate = min(1.0, SAMPLE / n)
    chosen = v.where(F.pmod(F.xxhash64("vec_id", "key"), F.lit(1 << 20)) < max(1, int(rate * (1 << 20)))).orderBy("vec_id", "key").limit(SAMPLE).toPandas()
    books = spark.sparkContext.broadcast(learn(_wide(chosen["embedding"] if len(chosen) else [first[0].embedding], width)))

    def coded(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for batch in batches:
            for a in range(0, len(batch), 1024):
                part = batch.iloc[a : a + 1024]
                x = _wide(part["embedding"], width)
                codes = encode(x, books.value)
                y = decode(codes, books.value)
                held.append((part["vec_id"].to_numpy(np.int64), part["key"].to_numpy(np.int64), (y**2).sum(1), np.sqrt(((x - y) ** 2).sum(1)), packed(codes), x))
                if sum(len(h[0]) for h in held) >= BLOCK:
                    yield _block(held)
                    held = []
        if held:
            yield _block(held)

    copies = Window.partitionBy("key").orderBy("vec_id")
    candidates = v.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= neighbours + 1).drop("copy")
    # as many tasks as there are full blocks, so that what a query gets from each block is little
    candidates = candidates.coalesce(-(-n // BLOCK))
    blocks = materialize(candidates.mapInPandas(coded, "ids binary, keys binary, squares binary, residuals binary, codes binary, vectors binary"), "codes")

    def whole(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(part["block"].iloc[0], part["vec_id"].to_numpy(np.int64).tobytes(), part["key"].to_numpy(np.int64).tobytes(), _wide(part["embedding"], width).tobytes())], columns=["block", "q_ids", "q_keys", "q"])

    asked = v.where(F.col("vec_id") % every == 0)
    n_blocks = -(-asked.count() // BROADCAST_QUERIES) or 1
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)))
    queries = asked.repartition(n_blocks, "block").groupBy("block").applyInPandas(whole, "block long, q_ids binary, q_keys binary, q binary")
    queries = materialize(queries, "queries")

    def scanned(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                ids, keys = np.frombuffer(row.ids, np.int64), np.frombuffer(row.keys, np.int64)
                q_ids, q_keys = np.frombuffer(row.q_ids, np.int64), np.frombuffer(row.q_keys, np.int64)
                codes = np.frombuffer(row.codes, np.uint8).reshape(len(ids), -1)
                q, squares, residuals = np.frombuffer(row.q).reshape(len(q_ids), -1), np.frombuffer(row.squares), np.frombuffer(row.residuals)
                x = np.frombuffer(row.vectors).reshape(len(ids), -1)
                for a in range(0, len(q_ids), QUERIES):
                    part = slice(a, a + QUERIES)
                    score = scan(q[part], codes, squares, books.value)
                    score[~np.isfinite(score)] = np.nan
                    score[q_ids[part, None] == ids[None]] = np.inf
                    out = []
                    for i, s in enumerate(score, a):
                        best, distance = nearest(q[i], s, x, ids, squares, residuals, neighbours, reranked)
                        out.append(pd.DataFrame({"query_id": q_ids[i], "q_key": q_keys[i], "vec_id": ids[best], "key": keys[best], "score": distance}))
                    yield pd.concat(out, ignore_index=True)

    # every block of codes meets every block of queries: the stated queries against all rows; only queries move
    schema = "query_id long, q_key long, vec_id long, key long, score double"
    met = [blocks.crossJoin(F.broadcast(queries.where(F.col("block") == k))).mapInPandas(scanned, schema) for k in range(n_blocks)]
    found = reduce(DataFrame.unionByName, met)
    best = Window.partitionBy("query_id", "q_key").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= neighbours).select("query_id", "rank", "vec_id", "score")


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


#: The exact answer, which the search finds whole.
SQL = f"""
WITH v AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
d AS (SELECT q.vec_id AS query_id, v.vec_id, sqrt(list_reduce(list_transform(range(1, len(v.x) + 1), lambda i: (q.x[i] - v.x[i]) * (q.x[i] - v.x[i])), lambda a, b: a + b)) AS score
      FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % {EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= {NEIGHBOURS}
"""
