"""What the corpus operators share: tables, scratch storage that all executors see, and components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import materialize, shared_dir

__all__ = ["components", "grouped_map", "materialize", "mixed", "packed", "shared_dir", "shuffle_partitions", "table", "text_batches"]

#: Rows of an Arrow batch between Spark and Python where rows hold whole texts.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to BATCH_ROWS rows: with whole texts in the rows, larger ones fill a worker's memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def packed(docs: DataFrame, *used: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """``docs`` with its columns but ``used`` in one, whose name no column has, and a function that unpacks them.

    What an operator adds to ``docs`` can then clash with none of them; the function gives back the columns
    of ``docs`` in their order, with ``used`` as the operator left them, and behind them the columns it is told
    were added. A column of ``docs`` with the name of an added one is replaced.
    """
    name = "_rest"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    rest = [c for c in docs.columns if c not in used]
    whole = docs.select(*(F.col(f"`{c}`") for c in used), F.struct(*(F.col(f"`{c}`") for c in rest), F.lit(0).alias(name)).alias(name))

    def unpack(df: DataFrame, *added: str) -> DataFrame:
        kept = [c for c in docs.columns if c.lower() not in {a.lower() for a in added}]
        return df.select(*(F.col(f"`{c}`") if c in used else F.col(f"{name}.`{c}`") for c in kept), *added)

    return whole, unpack


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of ``links(a, b)``: one row ``(node, component)`` for each node of a link.

    ``component`` is the smallest node that can be reached. Alternates the large-star and small-star
    steps of Kiveris et al. (2014): every step keeps the number of links at most as large as before and
    groups by node only to take a minimum, which is combined before the shuffle, so a star with millions
    of leaves is no bottleneck. Each round is written to the shared folder, which cuts the lineage.
    """
    a, b = F.col("a"), F.col("b")
    links = materialize(links.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), name)
    while True:
        both = links.unionByName(links.select(b.alias("a"), a.alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: every larger neighbour of a node goes to the node's smallest
        large = both.where(b > a).join(low, "a").select(b.alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, name)
        # small star: every smaller neighbour of a node, and the node, go to the node's smallest
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(b.alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x"))
        small = materialize(small.select("x.*").where(a != b).distinct(), name)
        # done when it is a forest of stars: no node is both leaf and centre, and each leaf has one centre
        stats = small.groupBy("a").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        if stats <= 1 and small.select(F.col("b").alias("a")).distinct().join(small.select("a"), "a", "left_semi").isEmpty():
            break
        links = small
    return small.select(F.col("a").alias("node"), b.alias("component")).unionByName(small.select(b.alias("node"), b.alias("component")).distinct())


def grouped_map(df: DataFrame, keys: list[str], fn: Callable[[pd.DataFrame], list[tuple]], schema: str) -> DataFrame:
    """The rows that ``fn`` makes of each group of ``df``. Keys are never null and groups are bounded.

    Like ``groupBy(keys).applyInPandas``, but many small groups share one batch.
    """
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            if rest is not None:
                batch = pd.concat([rest, batch], ignore_index=True)
            if not len(batch):
                continue
            starts = np.flatnonzero(batch[keys].ne(batch[keys].shift()).any(axis=1).to_numpy())
            out = [row for a, b in zip(starts, starts[1:]) for row in fn(batch.iloc[a:b])]  # noqa: B905
            rest = batch.iloc[starts[-1] :]
            yield pd.DataFrame(out, columns=names)
        if rest is not None:
            yield pd.DataFrame(fn(rest), columns=names)

    return df.repartition(shuffle_partitions(df.sparkSession), *keys).sortWithinPartitions(*keys).mapInPandas(run, schema)
