"""Half-open intervals [start, end) on a line of numbers: islands, overlaps, containment, coverage, merging.

A line (a byte source, a volume, a user's time) may hold a third of all rows, so nothing here sorts a
whole line in one task: lines are cut into stretches of fixed width, windows run within stretches, and
what crosses their borders comes from one summary row a stretch.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize


def _stretch(at: Column | str, width: int) -> Column:
    return F.floor((F.col(at) if isinstance(at, str) else at) / width)


def _with(df: DataFrame, stretches: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the columns of its stretch; a null key is a line like any other."""
    named = stretches.withColumnsRenamed({k: f"_of_{k}" for k in [*keys, "_stretch"]})
    on = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in [*keys, "_stretch"]]
    return df.join(named, on).drop(*(f"_of_{k}" for k in [*keys, "_stretch"]))


def islands(df: DataFrame, keys: list[str], gap: int, mode: str = "start", width: int = 1 << 30, order: tuple[str, ...] = ("start", "end")) -> DataFrame:
    """``df`` with ``island``, numbered from 0 along each line.

    Rows in ``order``, which begins with start, go on with the island before them unless

    * ``start``: they start more than ``gap`` after the row before starts;
    * ``end``: they start more than ``gap`` after the largest end so far;
    * ``component``: they start at or after the largest end so far (``gap`` is not used).

    ``df`` is computed once: its rows are stored with their stretches, and all passes read those.
    """
    whole, inside = Window.partitionBy(*keys).orderBy("_stretch"), Window.partitionBy(*keys, "_stretch").orderBy(*order)
    before, upto = (Window.unboundedPreceding, -1), (Window.unboundedPreceding, 0)
    d = materialize(df.withColumn("_stretch", _stretch("start", width)), "stretches")
    edges = d.groupBy(*keys, "_stretch").agg(F.max("start").alias("_last"), F.max("end").alias("_top"))
    edges = edges.select(*keys, "_stretch", F.lag("_last").over(whole).alias("_last"), F.max("_top").over(whole.rowsBetween(*before)).alias("_top"))
    d = _with(d, edges, keys)
    last = F.coalesce(F.lag("start").over(inside), F.col("_last"))
    top = F.greatest(F.max("end").over(inside.rowsBetween(*before)), F.col("_top"))
    cut = {"start": F.col("start") - last > gap, "end": F.col("start") - top > gap, "component": F.col("start") >= top}[mode]
    d = d.withColumn("_cut", F.coalesce(cut, F.lit(False)).cast("int"))
    cuts = d.groupBy(*keys, "_stretch").agg(F.sum("_cut").alias("_cuts"))
    cuts = cuts.select(*keys, "_stretch", F.coalesce(F.sum("_cuts").over(whole.rowsBetween(*before)), F.lit(0)).alias("_before"))
    d = _with(d, cuts, keys).withColumn("island", F.col("_before") + F.sum("_cut").over(inside.rowsBetween(*upto)))
    return d.drop("_stretch", "_last", "_top", "_cut", "_before")


def hotspots(hits: DataFrame, keys: list[str], gap: int, pad: int, low: Column, high: Column, width: int = 1 << 30) -> DataFrame:
    """Clusters of distinct ``hits(keys, start, end, hit_type)``, padded and held within ``low`` and ``high``."""
    hits = hits.select(*keys, "start", "end", "hit_type").distinct()
    found = islands(hits, keys, gap, "start", width, ("start", "end", "hit_type")).groupBy(*keys, "island")
    found = found.agg(F.min("start").alias("first_start"), F.max("start").alias("last_start"), F.max("end").alias("last_end"), F.count("*").alias("hits"), F.sort_array(F.collect_set("hit_type")).alias("hit_types"))
    return found.withColumns({"start": F.greatest(low, F.col("first_start") - pad), "end": F.least(high, F.col("last_end") + pad)})


def bounded(df: DataFrame) -> DataFrame:
    """``df`` whose intervals are checked: a null, negative or reversed bound is an error."""
    wrong = F.col("start").isNull() | F.col("end").isNull() | (F.col("start") < 0) | (F.col("end") < F.col("start"))
    text = F.concat(F.lit("bad interval: "), F.coalesce(F.col("start").cast("string"), F.lit("null")), F.lit(", "), F.coalesce(F.col("end").cast("string"), F.lit("null")))
    return df.withColumn("start", F.when(wrong, F.raise_error(text).cast("long")).otherwise(F.col("start")))


def overlapping(a: DataFrame, b: DataFrame, keys: list[str], width: int, condition: Column) -> DataFrame:
    """Inner join of ``a`` and ``b`` on keys and overlap, with both sides' columns under ``a`` and ``b``.

    Each interval goes to the stretches it touches; a pair is kept in the first stretch that both touch,
    so no pair comes twice. ``condition`` is checked besides. A null, negative or reversed bound is an error.
    """
    a, b = bounded(a), bounded(b)

    def dealt(df: DataFrame, name: str) -> DataFrame:
        first, last = _stretch("start", width), _stretch(F.greatest(F.col("end") - 1, F.col("start")), width)
        return df.withColumn("_first", first).withColumn("_stretch", F.explode(F.sequence(first, last))).alias(name)

    left, right = dealt(a, "a"), dealt(b, "b")
    on = F.col("a._stretch") == F.col("b._stretch")
    for k in keys:
        on &= F.col(f"a.{k}") == F.col(f"b.{k}")
    once = F.col("a._stretch") == F.greatest("a._first", "b._first")
    return left.join(right, on & once & (F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end")) & condition)


def relation() -> Column:
    """How ``a`` lies to ``b`` once they overlap: 0 exact, 1 inside, 2 partial."""
    exact = (F.col("a.start") == F.col("b.start")) & (F.col("a.end") == F.col("b.end"))
    return F.when(exact, 0).when((F.col("b.start") <= F.col("a.start")) & (F.col("a.end") <= F.col("b.end")), 1).otherwise(2)


def contained(points: DataFrame, extents: DataFrame, keys: list[str], width: int, how: str) -> DataFrame:
    """Semi, anti, left or inner join of ``points`` with the ``extents`` that contain them whole; extents are ``e``."""
    at = points.withColumn("_stretch", _stretch("start", width)).alias("p")
    held = extents.withColumn("_stretch", F.explode(F.sequence(_stretch("start", width), _stretch(F.greatest(F.col("end") - 1, F.col("start")), width)))).alias("e")
    on = (F.col("p._stretch") == F.col("e._stretch")) & (F.col("e.start") <= F.col("p.start")) & (F.col("p.end") <= F.col("e.end"))
    for k in keys:
        on &= F.col(f"p.{k}") == F.col(f"e.{k}")
    return at.join(held, on, how)


def coverage(units: DataFrame, keys: list[str], low: Column, high: Column, width: int = 1 << 30) -> DataFrame:
    """For each line: rows, gaps, overlaps and whether its rows cover [``low``, ``high``) without either."""
    whole, inside = Window.partitionBy(*keys).orderBy("_stretch"), Window.partitionBy(*keys, "_stretch").orderBy("start", "end")
    before = (Window.unboundedPreceding, -1)
    d = units.withColumn("_stretch", _stretch("start", width))
    edges = d.groupBy(*keys, "_stretch").agg(F.max("end").alias("_top"))
    edges = edges.select(*keys, "_stretch", F.max("_top").over(whole.rowsBetween(*before)).alias("_top"))
    top = F.greatest(F.max("end").over(inside.rowsBetween(*before)), F.col("_above"))
    d = _with(d, edges.withColumnRenamed("_top", "_above"), keys).withColumn("_top", top)
    d = d.groupBy(*keys).agg(
        F.count("*").alias("units"), F.count_if(F.col("start") > F.col("_top")).alias("gaps"), F.count_if(F.col("start") < F.col("_top")).alias("overlaps"),
        F.min("start").alias("low"), F.max("end").alias("high"),
    )
    return d.withColumn("complete", (F.col("gaps") == 0) & (F.col("overlaps") == 0) & (F.col("low") == low) & (F.col("high") == high))


def merged(windows: DataFrame, keys: list[str], cap: int, width: int = 1 << 30) -> DataFrame:
    """Touching windows merged while the merged one is at most ``cap`` long; a longer single window stays.

    Where a window doesn't touch what lies before it, merging starts anew. Within a run of touching windows
    each step depends on what was accepted before; a run is read once, in order, and nothing of it is held
    but the window that is growing.
    """
    runs = islands(windows.select(*keys, "start", "end"), keys, 0, "end", width)
    schema = runs.select(*keys, "start", "end", F.lit(0).cast("long").alias("parts")).schema

    def fold(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            out = []
            for *line, a, b, run in batch[[*keys, "start", "end", "island"]].itertuples(index=False, name=None):
                line = tuple(None if pd.isna(x) else x for x in line)
                if held and held[0] == (line, run) and a <= held[2] and max(held[2], b) - held[1] <= cap:
                    held = (held[0], held[1], max(held[2], b), held[3] + 1)
                else:
                    if held:
                        out.append((*held[0][0], *held[1:]))
                    held = ((line, run), a, b, 1)
            yield pd.DataFrame(out, columns=schema.names)
        if held:
            yield pd.DataFrame([(*held[0][0], *held[1:])], columns=schema.names)

    return runs.repartition(*keys, "island").sortWithinPartitions(*keys, "island", "start", "end").mapInPandas(fold, schema)
