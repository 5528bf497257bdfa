"""Occurrences beside each other: which are variants of one region, and what is known about them from elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import intervals
from .store import materialize

#: Reasons that an occurrence is for review, in their order, and what cluster ids begin with. Fixed values of reports.
OVERLAP, SAME_START, SAME_END, DENSE, WORDLIST = (
    "MNEMONIC_OVERLAP_CLUSTER", "MNEMONIC_SAME_START_MULTIPLE_LENGTHS", "MNEMONIC_SAME_END_MULTIPLE_LENGTHS", "MNEMONIC_DENSE_SLIDING_WINDOWS", "MNEMONIC_WORDLIST_REGION_LIKELY",
)
CLUSTER = "mnemonic-cluster-"


def regular(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, distinct_starts, regular: whether four fifths of the steps between distinct starts are within twice the upper median, of two at least."""
    starts = df.select(*keys, "start").distinct()
    steps = starts.withColumn("_step", F.col("start") - F.lag("start").over(Window.partitionBy(*keys).orderBy("start")))
    placed = steps.where("_step IS NOT NULL").withColumns({"_at": F.row_number().over(Window.partitionBy(*keys).orderBy("_step")), "_n": F.count("*").over(Window.partitionBy(*keys))})
    # the upper median is the step at n div 2, counted from 0
    median = F.max(F.when(F.col("_at") == F.floor(F.col("_n") / 2) + 1, F.col("_step"))).over(Window.partitionBy(*keys))
    found = placed.withColumn("_median", median).groupBy(*keys).agg(F.count("*").alias("_n"), F.count_if(F.col("_step") <= 2 * F.col("_median")).alias("_near"))
    counted = starts.groupBy(*keys).agg(F.count("*").alias("distinct_starts"))
    out = counted.join(found, keys, "left")
    return out.select(*keys, "distinct_starts", F.coalesce((F.col("_n") >= 2) & (5 * F.col("_near") >= 4 * F.col("_n")), F.lit(False)).alias("regular"))


def correlate(found: DataFrame, line: str, gap: int, compact: int, each: int, width: int = 1 << 30) -> DataFrame:
    """``found(line, id, start, end, words, fingerprint)`` with region, overlap, same_start, same_end, dense, relevance and cluster.

    A region ends where the next occurrence starts more than ``gap`` after all ends so far. An occurrence
    overlaps another, or shares its start or end with one of other length. A region is dense, and so
    likely a word list, if it is compact (at most ``compact`` long, or ``each`` for every member) and has many
    variants or many regular starts. What is neither dense nor a variant is independent. A cluster is known by its
    members, whatever their order. ``line`` is not null.
    """
    keys = [line, "region"]
    d = intervals.islands(found, [line], gap, "end", width, ("start", "end", "id")).withColumnRenamed("island", "region")
    d = materialize(intervals.islands(d, [line], 0, "component", width, ("start", "end", "id")).withColumnRenamed("island", "component"), "regions")
    groups = {"overlap": [line, "component"], "same_start": [*keys, "start"], "same_end": [*keys, "end"]}
    for name, by in groups.items():
        wanted = F.count("*") > 1 if name == "overlap" else (F.count("*") > 1) & (F.countDistinct("words") > 1)
        # the variants of a place are few; flags come back by its key
        flags = d.groupBy(*by).agg(wanted.alias(name))
        d = d.join(flags, by)
    d = materialize(d, "flags")
    r = d.groupBy(*keys).agg(
        F.count("*").alias("n"), (F.max("end") - F.min("start")).alias("span"), F.countDistinct("words").alias("lengths"), F.countDistinct("fingerprint").alias("prints"),
        F.bool_or(F.col("same_start") | F.col("same_end")).alias("variant"), F.count_if("overlap").alias("overlaps"),
    ).join(regular(d, keys), keys)
    n = F.col("n")
    tight = F.col("span") <= F.greatest(F.lit(compact), n * each)
    dense = (
        ((n >= 3) & F.col("variant") & ((F.col("lengths") > 1) | (F.col("prints") > 1)))
        | ((n >= 4) & (F.col("distinct_starts") >= 3) & (F.col("prints") >= 3) & F.col("regular"))
        | ((n >= 16) & (F.col("distinct_starts") >= 8) & (F.col("overlaps") >= 16) & F.col("regular"))
    )
    d = d.join(r.select(*keys, (tight & dense).alias("dense")), keys)
    classified = F.col("dense") | F.col("overlap") | F.col("same_start") | F.col("same_end")
    relevance = F.when(F.col("dense"), "LIKELY_WORDLIST_FALSE_POSITIVE").when(classified, "CONTEXT_REVIEW").otherwise("INDEPENDENT_CANDIDATE")
    d = materialize(d.withColumn("relevance", relevance), "relevance")
    member = F.sha2(F.concat_ws("|", "start", "end", "words", "fingerprint"), 256)
    # sums keep repeated members apart, which an exclusive or would cancel
    part = lambda at: F.sum(F.conv(F.substring(member, at, 15), 16, 10).cast("decimal(38,0)"))
    clusters = d.where("relevance <> 'INDEPENDENT_CANDIDATE'").groupBy(*keys).agg(
        F.concat(F.lit(CLUSTER), F.substring(F.sha2(F.concat_ws("|", F.first(F.col(line).cast("string")), F.min("start"), F.count("*"), part(1), part(16)), 256), 1, 16)).alias("_cluster"),
        F.count("*").alias("_size"), F.min("start").alias("_low"), F.max("end").alias("_high"),
    )
    inside = F.col("relevance") != "INDEPENDENT_CANDIDATE"
    out = d.join(clusters, keys, "left")
    return out.withColumns({n: F.when(inside, F.col(f"_{c}")) for n, c in {"cluster": "cluster", "cluster_size": "size", "cluster_start": "low", "cluster_end": "high"}.items()}).drop("_cluster", "_size", "_low", "_high", "component")


def reasons() -> Column:
    """Why an occurrence of ``correlate`` is not independent, in order."""
    found = ((F.col("overlap"), OVERLAP), (F.col("same_start"), SAME_START), (F.col("same_end"), SAME_END), (F.col("dense"), DENSE), (F.col("dense"), WORDLIST))
    return F.array_compact(F.array(*(F.when(c, r) for c, r in found)))


def statistics(correlated: DataFrame) -> DataFrame:
    """One row of counters over ``correlate``'s rows."""
    likely = F.col("relevance") == "LIKELY_WORDLIST_FALSE_POSITIVE"
    return correlated.agg(
        F.count("*").alias("occurrences"), F.count_if(F.col("relevance") == "INDEPENDENT_CANDIDATE").alias("independent"),
        F.count_if(F.col("overlap") | F.col("same_start") | F.col("same_end")).alias("overlapping"), F.count_if(likely).alias("likely_wordlist"),
        F.countDistinct(F.when(likely, F.col("fingerprint"))).alias("likely_fingerprints"), F.countDistinct(F.when(~likely, F.col("fingerprint"))).alias("review_fingerprints"),
    )


def rolled_up(occurrences: DataFrame, keys: list[str], order: list[Column], ranks: dict[str, int]) -> DataFrame:
    """One candidate for each of ``keys``: the first occurrence's place, HIGH if any is, the best relevance, all reasons and clusters.

    ``occurrences(keys, start, end, confidence, relevance, reasons, cluster)``; reasons come from a closed vocabulary.
    """
    rank = F.lit(len(ranks))
    for word, r in ranks.items():
        rank = F.when(F.col("relevance") == word, r).otherwise(rank)
    first = F.struct(*order)
    g = occurrences.groupBy(*keys).agg(
        F.min_by(F.struct("start", "end", "confidence"), first).alias("_first"), F.bool_or(F.col("confidence") == "HIGH").alias("_high"), F.min_by("relevance", rank).alias("relevance"),
        F.count("*").alias("copies"), F.countDistinct("cluster").alias("clusters"), F.max("cluster").alias("_cluster"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("reasons")))).alias("reasons"),
    )
    confidence = F.when(F.col("_high"), "HIGH").otherwise(F.col("_first.confidence"))
    return g.select(*keys, "_first.start", "_first.end", confidence.alias("confidence"), "relevance", "copies", "clusters", F.when(F.col("clusters") == 1, F.col("_cluster")).alias("cluster"), "reasons")


def known(candidates: DataFrame, artifacts: DataFrame, keys: list[str], width: int) -> DataFrame:
    """``candidates(keys, id, start, end, digest)`` with the first artifact, by ``artifact``, that holds them or has their digest.

    ``artifacts(keys, artifact, start, end, digest, active)``. Two joins, one on places and one on digests, and the smaller artifact of both.
    """
    c = candidates.select(*keys, "id", "start", "end", "digest")
    place = intervals.contained(c.select(*keys, "id", "start", "end"), artifacts.select(*keys, "artifact", "start", "end", "active"), keys, width, "inner").select("p.id", "e.artifact", "e.active")
    same = c.where("digest IS NOT NULL").select("id", "digest").join(artifacts.where("digest IS NOT NULL").select("artifact", "digest", "active"), "digest").select("id", "artifact", "active")
    first = place.unionByName(same).groupBy("id").agg(F.min(F.struct("artifact", "active")).alias("_a"))
    state = F.when(F.col("_a").isNull(), "UNKNOWN").when(F.col("_a.active"), "ACTIVE_CURRENT").otherwise("UNKNOWN_REFERENCE")
    return candidates.join(first, "id", "left").withColumns({"artifact": F.col("_a.artifact"), "state": state}).drop("_a")


def assessed(hits: DataFrame, by: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``hits`` with ``columns`` as ``by`` has them where it has a row of the same ``keys``; ``by`` has each once."""
    found = by.select(*(F.col(k).alias(f"_k_{k}") for k in keys), *(F.col(c).alias(f"_c_{c}") for c in columns), F.lit(True).alias("_there"))
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    out = hits.join(found, on, "left")
    return out.select(*(F.when(F.col("_there"), F.col(f"_c_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in hits.columns))


def encryption(ckeys: Column, mkeys: Column) -> Column:
    return (
        F.when((ckeys > 0) & (mkeys > 0), "ENCRYPTED_COMPLETE_EVIDENCE").when(ckeys > 0, "ENCRYPTED_KEYS_WITHOUT_MASTER_KEY")
        .when(mkeys > 0, "MASTER_KEY_WITHOUT_CKEY").otherwise("NO_ENCRYPTION_EVIDENCE")
    )


def wallet_priority(keys: Column, ckeys: Column, mkeys: Column, private: Column, fragmentary: Column, conflicts: Column, proven: Column, truncated: Column) -> Column:
    """How urgent a candidate is: proven keys first, then whole encrypted evidence, then what is broken off but has payloads."""
    agreed = conflicts == 0
    return (
        F.when((proven > 0) & agreed, "CRITICAL")
        .when((ckeys > 0) & (mkeys > 0), F.when(fragmentary | ~agreed, "MEDIUM").otherwise("HIGH"))
        .when(keys > 0, F.when((private > 0) & (fragmentary | truncated) & agreed, "HIGH").otherwise("MEDIUM"))
        .when((ckeys > 0) | (mkeys > 0), "MEDIUM")
        .otherwise("LOW")
    )


def review_priority(survived: Column, known_: Column, copies: Column, occurrences: Column) -> Column:
    return F.when(survived > 0, F.when(known_ | ((copies == 1) & (occurrences <= 3)), "HIGH_REVIEW").when((copies <= 25) & (occurrences <= 25), "MEDIUM_REVIEW").otherwise("LOW_REVIEW"))


def triage(owner: Column, stale: Column, relation: Column, allocation: Column) -> Column:
    """Class and confidence of a find, from who owns its place now, who did, what it is like, and whether its clusters are in use."""
    found = (
        (owner, "ALLOCATED_OTHER_FILE", "HIGH"), ((relation == "BYTE_IDENTICAL") & allocation.isin("UNALLOCATED", "MIXED"), "LIKELY_ACTIVE_WALLET_OLD_COPY", "HIGH"),
        (stale, "POSSIBLE_HISTORICAL_WALLET", "HIGH"), (allocation == "UNALLOCATED", "POSSIBLE_HISTORICAL_WALLET", "MEDIUM"), (allocation == "UNKNOWN", "UNRESOLVED", "LOW"),
    )
    out = F.struct(F.lit("DISTINCT_UNKNOWN_WALLET").alias("class"), F.lit("MEDIUM").alias("confidence"))
    for when, kind, sure in reversed(found):
        out = F.when(when, F.struct(F.lit(kind).alias("class"), F.lit(sure).alias("confidence"))).otherwise(out)
    return out


def overall(structural: Column, fragments: Column) -> Column:
    return F.when(structural > 0, "STRUCTURAL").when(fragments > 0, "FRAGMENT").otherwise("REJECTED")


def reference_state(records: Column, number: Column, sequence: Column, current: Column) -> Column:
    """What a reference (number, sequence) points at now; ``current`` is the sequence of the record of that number, or null."""
    return (
        F.when(number >= records, "record_number_out_of_range").when(current.isNull(), "current_record_missing")
        .when(current == sequence, "current_reference_matches").otherwise("current_record_reused_sequence_differs")
    )


def prefix(units: DataFrame, keys: list[str], low: Column) -> DataFrame:
    """keys, units, prefix: how many rows in order follow on each other from ``low`` without gap or overlap. A line's units are counted in one window."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    broken = F.coalesce(F.lag("end").over(order), low) != F.col("start")
    d = units.withColumn("_broken", F.max(broken.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*keys).agg(F.count("*").alias("units"), F.count_if(F.col("_broken") == 0).alias("prefix"))
