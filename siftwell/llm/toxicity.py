"""Toxicity by a factorization machine over hashed terms.

A text is the set of its terms' buckets. The machine adds to each bucket's weight the products of all
pairs of buckets' vectors, and so learns that two terms mean together what neither means alone. Bucket
counts come from all labelled rows that may be learned from; every bucket that is seen often enough in them
is an input, also one that tells nothing by itself. The machine is fitted on at most MOST_ROWS of those rows,
on the driver: a row is then its bucket numbers, and a step touches only the inputs that its rows have. Scores
are computed where the texts are.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import packed, table, text_batches

#: Buckets that terms are hashed to; the least frequency of those that become inputs; size of their vectors.
BUCKETS, LEAST, FACTORS = 1 << 18, 5, 8
#: Lengths of the beginnings of words that are terms too.
PREFIXES = (4, 5)
#: Rows that the machine is fitted on, at most: a sample by hash of doc_id. Steps, and the most passes that they may be; rows in a step, step, weight decay.
#: Inputs of all those rows together, at most (4 bytes each on the driver, so below 100 MB).
MOST_ELEMENTS = 20_000_000
MOST_ROWS, STEPS, PASSES, BATCH, STEP, DECAY = 20_000, 1500, 60, 256, 0.03, 1e-5
#: Labels are broadcast up to so many rows (an id and a number each, so below 64 MB), and joined by shuffle beyond.
BROADCAST_ROWS = 1_000_000
#: Standard deviation of the vectors' first values; z from which an input takes whole steps, and the share of a step that any input takes.
SPREAD, TELLING, SLOWEST = 0.01, 8, 0.03
#: A text with this score or more counts as toxic.
THRESHOLD = 0.3
#: Rows with this remainder of crc32(doc_id as text) by FOLDS are held out.
FOLDS, HELD_OUT = 4, 2

TERM = re.compile(r"[^\W_]+")


def terms(text: str) -> set[str]:
    """A text's distinct lower-case words, and the beginnings of the longer ones, which an insult's forms share."""
    words = set(TERM.findall(text.lower()))
    return words.union(*({f"{n}^{w[:n]}" for w in words if len(w) > n} for n in PREFIXES))


def buckets(text: str | None) -> np.ndarray:
    """The buckets of a text's distinct terms; none for null."""
    if not text:
        return np.empty(0, np.int64)
    return np.unique(np.fromiter((zlib.crc32(t.encode("utf-8", "replace")) % BUCKETS for t in terms(text)), np.int64))


@dataclass
class Machine:
    """``inputs`` maps a bucket to its input or -1."""

    inputs: np.ndarray
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def score(self, text: str | None) -> float:
        x = self.inputs[buckets(text)]
        x = x[x >= 0]
        v = self.vectors[x]
        y = self.bias + self.weights[x].sum() + 0.5 * float((v.sum(0) ** 2).sum() - (v**2).sum())
        return float(1 / (1 + np.exp(-np.clip(y, -40, 40))))


def train(rows: list[np.ndarray], labels: np.ndarray, inputs: np.ndarray, pace: np.ndarray | None = None, seed: int = 7, consume: bool = False) -> Machine:
    """Fit on ``rows`` of distinct input numbers by Adam on the logistic loss; the same rows give the same machine.

    With ``consume``, ``rows`` is emptied as the batches are made, so that its numbers are held once. ``pace`` is each input's share of the step, one if not given. A step updates the inputs of its rows
    only, with the moments that they had when last seen.
    """
    n, rng = max(1, int(inputs.max(initial=-1)) + 1), np.random.default_rng(seed)
    pace = np.ones(n, np.float32) if pace is None else pace.astype(np.float32)
    rate = np.clip(labels.mean() if len(labels) else 0.0, 1e-4, 1 - 1e-4)
    # an input's weight, then its vector
    theta = np.column_stack([np.zeros(n), rng.normal(0, SPREAD, (n, FACTORS))]).astype(np.float32)
    bias = float(np.log(rate / (1 - rate)))
    m, s, mb, sb, step = np.zeros_like(theta), np.zeros_like(theta), 0.0, 0.0, 0
    order, batches = rng.permutation(len(rows)), []
    for a in range(0, len(order), BATCH):
        part = order[a : a + BATCH]
        batches.append(_batch([rows[j] for j in part], labels[part]))
        for j in part if consume else ():
            rows[j] = None
    passes = min(PASSES, -(-STEPS // max(1, len(batches))))
    for _ in range(passes if len(set(labels.tolist())) > 1 else 0):
        for b in rng.permutation(len(batches)):
            y0, full, starts, used, at, of, firsts = batches[b]
            now = theta[used]
            v = now[:, 1:]
            total = np.zeros((len(y0), FACTORS + 2), np.float32)
            if len(at):
                total[full] = np.add.reduceat(np.column_stack([now, (v**2).sum(1)])[at], starts)
            xv = total[:, 1:-1]
            y = bias + total[:, 0] + 0.5 * ((xv**2).sum(1) - total[:, -1])
            g = ((1 / (1 + np.exp(-np.clip(y, -40, 40))) - y0) / len(y0)).astype(np.float32)
            gb, step = float(g.sum()), step + 1
            mb, sb = 0.9 * mb + 0.1 * gb, 0.999 * sb + 0.001 * gb**2
            fix = float(np.sqrt(1 - 0.999**step) / (1 - 0.9**step))
            bias -= STEP * fix * mb / (np.sqrt(sb) + 1e-8)
            if len(at):
                grad = np.add.reduceat(np.column_stack([g, g[:, None] * xv])[of], firsts)
                grad[:, 1:] -= grad[:, :1] * v
                grad += DECAY * now
                m[used] = mu = 0.9 * m[used] + 0.1 * grad
                s[used] = su = 0.999 * s[used] + 0.001 * grad**2
                theta[used] = now - (STEP * fix * pace[used])[:, None] * mu / (np.sqrt(su) + 1e-8)
    return Machine(inputs, float(bias), theta[:, 0].copy(), theta[:, 1:].copy())


def _batch(rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, ...]:
    """Labels; which rows have inputs and where these begin; the distinct inputs; each element's place among them; the elements' rows by input, and where an input's begin."""
    size = np.array([len(x) for x in rows])
    used, at = np.unique(np.concatenate(rows), return_inverse=True)
    # a batch has at most 256 rows, and mostly fewer distinct inputs than two bytes count
    of = np.repeat(np.arange(len(rows)).astype(np.uint8 if len(rows) <= 256 else np.int32), size)[np.argsort(at, kind="stable")]
    firsts = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(used)))[:-1]]).astype(np.int64)
    return labels, size > 0, (np.cumsum(size) - size)[size > 0], used.astype(np.int32), at.astype(np.uint16 if len(used) <= 1 << 16 else np.int32), of, firsts


def _counts(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
            seen[int(toxic), buckets(text)] += 1
    found = np.flatnonzero(seen.sum(0))
    yield pd.DataFrame({"bucket": found, "clean": seen[0, found], "toxic": seen[1, found]})


def _rows(inputs: np.ndarray):
    def rows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = [inputs[buckets(t)] for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "toxic": batch["toxic"], "x": [v[v >= 0].astype(np.int32).tobytes() for v in x]})

    return rows


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Machine:
    """A machine from the labelled ``docs(doc_id, text)`` that are not held out.

    ``labels(doc_id, toxic)`` may repeat a row; a document is toxic if any of its rows says so, and null
    labels and ids do not count. Without both labels, and so with empty tables, every score is the share of toxic rows. Null
    texts are empty, very long ones count whole. At most MOST_ROWS rows are learned from, the first by a hash of their ids,
    and of these as many as have MOST_ELEMENTS inputs together. Other columns are ignored.
    """
    text_batches(docs.sparkSession)
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    if labels.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    known = docs.select("doc_id", "text").where(~held_out(F.col("doc_id"))).join(known, "doc_id")
    counts = known.select("text", "toxic").mapInPandas(_counts, "bucket long, clean long, toxic long")
    counts = counts.groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(F.col("clean") + F.col("toxic") >= LEAST)
    n = known.groupBy("toxic").count().collect()
    clean, toxic = (max(1, sum(r["count"] for r in n if r["toxic"] == x)) for x in (0, 1))
    seen = counts.toPandas().sort_values("bucket")
    inputs = np.full(BUCKETS, -1, np.int32)
    inputs[seen["bucket"].to_numpy(np.int64)] = np.arange(len(seen))
    # z of the difference of two shares: what tells the labels apart by itself is learned faster, nothing is left out
    c, t = seen["clean"].to_numpy(float), seen["toxic"].to_numpy(float)
    share = (c + t) / (clean + toxic)
    z = np.abs(t / toxic - c / clean) / np.sqrt(np.maximum(share * (1 - share), 0) * (1 / toxic + 1 / clean) + 1e-12)
    pace = np.clip((z / TELLING) ** 2, SLOWEST, 1) if len(seen) else None
    rate = min(1.0, MOST_ROWS / (clean + toxic))
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(rate * (1 << 20)))
    rows = sample.mapInPandas(_rows(inputs), "doc_id long, toxic int, x binary")
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic", "x").limit(MOST_ROWS).withColumn("elements", F.length("x") / 4)
    held, elements = [], 0
    for row in rows.toLocalIterator():
        elements += row.elements
        if held and elements > MOST_ELEMENTS:
            break
        held.append((row.doc_id, row.toxic, bytes(row.x)))
    rows = pd.DataFrame(held, columns=["doc_id", "toxic", "x"]).sort_values(["doc_id", "toxic", "x"])
    del held
    toxic_, x = rows["toxic"].to_numpy(float), [np.frombuffer(v, np.int32) for v in rows["x"]]
    del rows
    return train(x, toxic_, inputs, pace, consume=True)


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """``docs`` with score in [0, 1] and predicted; a null text is an empty one, a very long one is scored whole.

    Every row of ``docs`` stays, also repeated ones; an empty table stays empty. Columns score and predicted of
    ``docs`` are replaced, others of any name pass through.
    """
    text_batches(docs.sparkSession)
    whole, unpack = packed(docs, "text")
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def scores(text: pd.Series) -> pd.Series:
        return text.map(shared.value.score).astype("float64")

    # the text goes to Python once; predicted reads the finished score
    out = whole.withColumn("score", scores(F.coalesce("text", F.lit("")))).withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
    return unpack(out, "score", "predicted")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, machine).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
