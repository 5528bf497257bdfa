"""Byte patterns and words in text, by SQL expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def signatures(rows: DataFrame, key: str, text: str, patterns: Sequence[tuple[str, str]]) -> DataFrame:
    """All occurrences, overlapping ones too, of ``patterns`` (name, text): key, signature, start and end in bytes.

    A text is cut before each occurrence; the lengths of the pieces add up to the offsets. Every cut is an
    occurrence, and so is the beginning, where nothing is cut off, if the text begins with the pattern.
    All patterns share one scan of ``rows``; only lengths leave it. ``key`` is unique.
    """
    t = F.col(text)

    def cut(name: str, pattern: str) -> Column:
        lengths = F.transform(F.split(t, "(?=" + _quoted(pattern) + ")", -1), lambda piece: F.octet_length(piece).cast("long"))
        found = F.struct(F.lit(name).alias("signature"), F.lit(len(pattern.encode())).alias("size"), F.startswith(t, F.lit(pattern)).alias("at_once"), lengths.alias("lengths"))
        return F.when(F.contains(t, F.lit(pattern)), found)

    cuts = rows.select(key, F.explode(F.array_compact(F.array(*(cut(*p) for p in patterns)))).alias("c"))
    pieces = cuts.select(key, "c.signature", "c.size", "c.at_once", F.posexplode("c.lengths").alias("i", "n"))
    before = Window.partitionBy(key, "signature").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")))
    return pieces.where("i > 0 OR at_once").select(key, "signature", "start", (F.col("start") + F.col("size")).alias("end"))


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9\s])", r"\\\1", text)


def token_runs(rows: DataFrame, key: str, text: str, words: Sequence[str], least: int) -> DataFrame:
    """Maximal runs of at least ``least`` dictionary ``words``: key, first token, length. Only dictionary tokens leave their row."""
    tokens = F.filter(
        F.transform(F.split(F.lower(text), r"[ \t\n\r]+"), lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda t: t["w"].isin(*words)
    )
    t = rows.select(key, F.explode(tokens).alias("t")).select(key, F.col("t.i").alias("i"))
    t = t.withColumn("run", F.col("i") - F.row_number().over(Window.partitionBy(key).orderBy("i")))
    return t.groupBy(key, "run").agg(F.min("i").cast("long").alias("first_token"), F.count("*").alias("length")).where(F.col("length") >= least).drop("run")


def windows(runs: DataFrame, key: str, low: int, high: int) -> DataFrame:
    """Number of windows of each length from ``low`` to ``high`` in ``runs``."""
    lengths = runs.select(key, "length", F.explode(F.sequence(F.lit(low).cast("long"), F.least(F.col("length"), F.lit(high).cast("long")))).alias("words"))
    return lengths.groupBy(key, "words").agg(F.sum(F.col("length") - F.col("words") + 1).alias("windows"))


def markers(text: Column, names: Sequence[str]) -> list[Column]:
    return [F.contains(F.lower(text), F.lit(n)).alias("has_" + re.sub(r"\W", "", n)) for n in names]
