"""Mixing sources to target weights by systematic sampling. DataFrame functions only.

Every document of a source has the same number of expected copies, target / size of the source. Within
the source the expected copies are summed up in a fixed order, one offset is added, and a document is
emitted once for each integer that its part of the sum crosses. The order goes by size, so what a source
gives lies within a few documents of its target.

The running sum must not put a large source into one task: documents are dealt to slots, (source, size
band, residue of doc_id, size), the slots' counts are summed in order, and ranks are taken within slots. So
there are as many slots as there are sizes and residues, more with every larger corpus.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, packed, table

#: Weights of the sources in order, repeating; share of all words that the mix takes; most copies of a source's words.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Residues of doc_id within a size band of a source.
SLOTS = 256
#: Names the one offset of each source.
SEED = "mix"


def words(text: Column) -> Column:
    """Number of maximal runs that are not ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``sizes(skey, source, source_size)``, a row for each source, with target.

    Sources in code point order, null last, take ``weights`` in turn and share ``share`` of all words by
    weight; a target above ``most`` times its source's size stops there and the excess goes to the others
    by weight. Sources are visited by the share at which they stop; the first that does not stop has the
    final share, and no later one a larger.
    """
    by_name, by_stop = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_stop.rowsBetween(Window.unboundedPreceding, -1)
    s = sizes.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1))
    s = s.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    everything = Window.partitionBy()
    s = s.withColumn("left", F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("level", F.col("left") / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    s = s.withColumn("stops", F.col("level") * F.col("weight") > F.col("cap"))
    s = s.withColumn("level", F.max(F.when(~F.col("stops"), F.col("level"))).over(everything))
    return s.withColumn("target", F.when(F.col("stops"), F.col("cap")).otherwise(F.col("level") * F.col("weight"))).select("skey", "source_size", "target")


def offset(skey: Column, seed: str = SEED) -> Column:
    """A fixed number in [0, 1) for each source."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), skey).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED, size: Column | None = None) -> DataFrame:
    """``docs`` with size, source_size, target and copies (0 or more).

    ``docs`` needs doc_id, source and text, or a ready ``size`` that is given as an expression. Null text has
    size 0, null source is a source of its own, and null doc_ids share a residue. Repeated rows are documents
    like any other; texts of one doc_id and size are ordered by their hashes, so that reruns agree. Without
    words every target is 0, and an empty table gives an empty one. Texts may be as long as a column's value
    can be. The columns added replace any of the same name; others pass through.
    """
    docs = docs.withColumn("size", words(F.col("text")) if size is None else size)
    whole, unpack = packed(docs, *(c for c in ("doc_id", "source", "text", "size") if c in docs.columns))
    bits = F.length(F.bin("size"))
    tie = [F.xxhash64("text")] if "text" in docs.columns else []
    d = whole.withColumns({
        "_skey": F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")),
        "_band": bits * 8 + F.expr("shiftright(size, greatest(length(bin(size)) - 3, 0))"),
        "_slot": F.coalesce(F.pmod("doc_id", F.lit(SLOTS)), F.lit(0)).cast("int"),
    })
    keys = ["_skey", "_band", "_slot", "size"]
    slots = materialize(d.groupBy(*keys).agg(F.first("source").alias("source"), F.count("*").alias("n"), F.sum("size").alias("words")), "slots")
    sizes = slots.groupBy(F.col("_skey").alias("skey")).agg(F.first("source").alias("source"), F.sum("words").alias("source_size"))
    starts = Window.partitionBy("_skey").orderBy("_band", "_slot", "size").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.select(*keys, F.coalesce(F.sum("n").over(starts), F.lit(0)).alias("_before")).join(targets(sizes, weights, share, most).withColumnRenamed("skey", "_skey"), "_skey")
    within = Window.partitionBy(*keys).orderBy(F.col("doc_id").asc_nulls_first(), *tie)
    d = d.join(slots, keys).withColumn("_rank", F.col("_before") + F.row_number().over(within))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = F.floor(F.col("_rank") * each + offset(F.col("_skey"), seed)) - F.floor((F.col("_rank") - 1) * each + offset(F.col("_skey"), seed))
    return unpack(d.withColumn("copies", copies.cast("int")), "size", "source_size", "target", "copies")


def emit(mixed: DataFrame) -> DataFrame:
    """Each row of ``mix`` as often as its copies say."""
    return mixed.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("_copy")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sizes = materialize(docs.select("doc_id", "source", words(F.col("text")).alias("size")), "sizes")
    return mix(sizes, size=F.col("size")).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
b AS (SELECT *, coalesce('s' || source, 'n') AS skey, length(bin(size)) AS bits, coalesce(((doc_id % {SLOTS}) + {SLOTS}) % {SLOTS}, 0) AS slot FROM d),
k AS (SELECT *, bits * 8 + (size >> greatest(bits - 3, 0)) AS band FROM b),
s AS (SELECT skey, any_value(source) AS source, sum(size)::BIGINT AS source_size FROM k GROUP BY skey),
w AS (SELECT *, [{", ".join(f"{x}.0::DOUBLE" for x in WEIGHTS)}][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}] AS weight,
             {MOST}.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, ({SHARE}::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER stop, 0.0::DOUBLE))
               / (sum(weight) OVER () - coalesce(sum(weight) OVER stop, 0.0::DOUBLE)) AS level
      FROM w WINDOW stop AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, level * weight > cap AS stops, max(CASE WHEN NOT level * weight > cap THEN level END) OVER () AS final FROM l),
t AS (SELECT skey, source_size, CASE WHEN stops THEN cap ELSE final * weight END AS target,
             ('0x' || substr(md5('{SEED}:' || skey), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM f),
r AS (SELECT k.*, row_number() OVER (PARTITION BY skey ORDER BY band, slot, size, doc_id NULLS FIRST) AS rank FROM k)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN floor(rank * (target / source_size) + u) - floor((rank - 1) * (target / source_size) + u) ELSE 0 END)::BIGINT * size AS taken
FROM r JOIN t USING (skey)
"""
