"""Findings: dedup, admission policies, normalised states, roll-ups."""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import islands

#: Evidence strengths, weakest first.
STRENGTHS = ("WEAK", "CORROBORATING", "STRONG", "CRYPTO_VALID")

# The closed status vocabulary. Any other word is an error.
CRYPTO_VALID = (
    "CRYPTO_VALID", "BASE58CHECK_AND_SECP256K1_VALID", "SECP256K1_VALID", "CHECKSUM_VALID", "BIP39_VALID",
    "ELECTRUM_SEED_VALID", "ELECTRUM_V1_STRICT_VALID", "ELECTRUM_V1_COMPAT_VALID",
)
CRYPTO_INVALID = (
    "CHECKSUM_INVALID", "PRIVATE_SCALAR_INVALID", "PUBLIC_KEY_MISMATCH", "BIP39_CHECKSUM_INVALID",
    "ELECTRUM_SEED_VERSION_INVALID", "ELECTRUM_V1_ROUNDTRIP_INVALID",
)
STRUCTURAL_VALID = (
    "BERKELEY_METADATA_STRUCTURAL_VALID", "BITCOIN_RECORD_STRUCTURAL_VALID", "BITCOIN_RECORD_KEY_SIDE_VALID",
    "ELECTRUM_CONTAINER_STRUCTURAL_VALID", "PROTOBUF_STRUCTURAL_VALID", "ARMORY_HEADER_STRUCTURAL_VALID",
)
FRAGMENT_VALID = (
    "BERKELEY_METADATA_FRAGMENT", "ELECTRUM_CONTAINER_FRAGMENT_VALID", "PROTOBUF_FRAGMENT_VALID", "EXPORT_KEY_FORMAT_VALID",
    "ENCRYPTED_FRAGMENT", "JAVA_SERIALIZED_WALLET_FRAGMENT", "ARMORY_FRAGMENT_VALID",
)
REFUSED = (
    "BITCOIN_RECORD_KEY_SIDE_REJECTED", "REJECTED", "INSUFFICIENT_PROTOBUF_STRUCTURE", "INSUFFICIENT_EXPORT_STRUCTURE",
    "INSUFFICIENT_ENCRYPTED_STRUCTURE", "OUT_OF_SCOPE_MULTIBIT_HD", "INSUFFICIENT_JAVA_SERIALIZATION_STRUCTURE",
    "INSUFFICIENT_ARMORY_STRUCTURE", "BIP39_WORD_COUNT_INVALID", "BIP39_WORD_INVALID", "ELECTRUM_V1_WORD_COUNT_INVALID",
    "ELECTRUM_V1_WORD_INVALID", "ELECTRUM_V1_INVALID_ENTROPY_LENGTH", "BITCOIN_RECORD_KEY_COMPACTSIZE_INVALID",
    "BITCOIN_RECORD_PUBKEY_LENGTH_INVALID", "BITCOIN_RECORD_PUBKEY_PREFIX_INVALID",
)
STRUCTURAL_WORDS = (
    "RAW", "UNVALIDATED", "REJECTED", "CANDIDATE", "VALIDATED", "STRONG", "FRAGMENT", "COMPLETE", "STRUCTURAL", "ANCHOR_ONLY",
    "CONTEXT_ONLY", "NONE", "TRUNCATED", "STRUCTURAL_FRAGMENT", "SERIALIZATION_UNSUPPORTED",
)
VALIDATION_WORDS = (*STRUCTURAL_WORDS, *CRYPTO_VALID, *CRYPTO_INVALID, *STRUCTURAL_VALID, *FRAGMENT_VALID, *REFUSED)
COMPLETENESS_WORDS = ("NONE", "COMPLETE", "FRAGMENT", "TRUNCATED", "STRUCTURAL_FRAGMENT")
RELEVANCE_WORDS = ("INDEPENDENT", "CONTEXT_REVIEW", "LIKELY_FALSE_POSITIVE", "INDEPENDENT_CANDIDATE", "LIKELY_WORDLIST_FALSE_POSITIVE")
#: Statuses that prove a hit by its checksum or curve, whatever its target; the last one does so for secrets only.
PROVEN, PROVEN_SECRET = ("BASE58CHECK_AND_SECP256K1_VALID", "ELECTRUM_SEED_VALID", "ELECTRUM_V1_STRICT_VALID", "BIP39_VALID"), "SECP256K1_VALID"
#: Kinds that are context, and kinds that are secrets.
CONTEXT_KINDS = ("bitcoin_address", "bitcoin_public_key")
SECRET_KINDS = ("mnemonic", "wif_private_key", "ec_private_key_der", "private_key")


def checked(word: Column, vocabulary: tuple[str, ...]) -> Column:
    """``word``, or an error if it is not in the closed ``vocabulary``."""
    return F.when(word.isin(*vocabulary), word).otherwise(F.raise_error(F.concat(F.lit("unknown status: "), F.coalesce(word, F.lit("null")))))


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first in ``order``. Combines before the shuffle."""
    row = F.struct(*df.columns)
    return df.groupBy(*keys).agg(F.min_by(row, F.struct(*order)).alias("_row")).select("_row.*")


def conflicts(df: DataFrame, keys: list[str], payload: Column) -> DataFrame:
    """For each key its rows, distinct payloads and whether they conflict."""
    out = df.groupBy(*keys).agg(F.count("*").alias("copies"), F.countDistinct(payload).alias("payloads"))
    return out.withColumn("conflict", F.col("payloads") > 1)


def strength(target: Column, structural: Column, validation: Column) -> Column:
    """Rank of a hit's evidence in STRENGTHS; the first rule that holds counts.

    A refusal counts where the validation says so; a refused structure alone makes nothing but weak evidence.
    """
    v, s = F.upper(validation), F.upper(structural)
    return (
        F.when(v.isin(*PROVEN) | ((v == PROVEN_SECRET) & (target == "secrets")), 3)
        .when(v.isin(*STRUCTURAL_VALID), 2)
        .when(v.rlike("REJECTED|INVALID|INSUFFICIENT|OUT_OF_SCOPE"), 0)
        .when(s.isin("STRONG", "STRUCTURAL", "COMPLETE") & (v != "UNVALIDATED"), 2)
        .when((s == "FRAGMENT") | (target == "unknown"), 1)
        .otherwise(0)
    )


def reasons(hits: Column, types: Column, strongest: Column, known: Column, pairs: Column, required: Column, span: Column, min_hits: int = 1, min_types: int = 1, max_span: int | None = None) -> Column:
    """Why a cluster of hits is not admitted, in fixed order; empty if it is.

    A strong hit waives the two minimums; a cluster with a known target and no strong hit needs two
    distinct kinds of evidence. ``required`` says whether the required groups are there.
    """
    weak = strongest < 2
    too_long = span > max_span if max_span is not None else F.lit(False)
    found = (
        (weak & (hits < min_hits), "insufficient_hits"),
        (weak & (types < min_types), "insufficient_distinct_types"),
        (weak & known & (pairs < 2), "weak_evidence_requires_independent_corroboration"),
        (~required, "missing_required_group"),
        (too_long, "signal_span_too_large"),
    )
    return F.array_compact(F.array(*(F.when(c, r) for c, r in found)))


def policy(
    hits: DataFrame, keys: list[str], min_hits: int = 2, min_types: int = 2, max_span: int | None = None, required: Sequence[Collection[str]] = ()
) -> DataFrame:
    """keys, hits, hit_types, span, strongest and reasons of each cluster of ``hits(keys, start, hit_type, target, kind, strength)``; admitted without reasons.

    A known target is any but ``unknown`` and null. A cluster without one has no strength and needs no corroboration; any other
    without a strong hit needs two distinct (kind, hit type) pairs under one known target. Of every required group one
    hit type must be there. Hit types come from a closed vocabulary.
    """
    if min_hits < 1 or min_types < 1 or (max_span is not None and max_span < 0):
        raise ValueError("minimums are at least one, and a span is not negative")
    if any(isinstance(g, str) or not g or not all(isinstance(n, str) and n for n in g) for g in required):
        raise ValueError("a required group is a set of names")
    known = F.coalesce(F.col("target") != "unknown", F.lit(False))
    # one row a cluster and target first, so that a cluster with very many hits is no large group
    each = hits.groupBy(*keys, "target").agg(
        F.count("*").alias("hits"), F.collect_set("hit_type").alias("types"), F.min("start").alias("low"), F.max("start").alias("high"), F.max("strength").alias("strongest"),
        F.countDistinct(F.when(known, F.struct("kind", "hit_type"))).alias("pairs"), F.bool_or(known).alias("known"),
    )
    g = each.groupBy(*keys).agg(
        F.sum("hits").alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("types")))).alias("hit_types"), (F.max("high") - F.min("low")).alias("span"),
        F.max("strongest").alias("strongest"), F.max("pairs").alias("pairs"), F.bool_or("known").alias("known"),
    )
    strongest = F.when(F.col("known"), F.coalesce(F.col("strongest"), F.lit(0))).otherwise(0)
    there = F.lit(True)
    for group in required:
        there &= F.arrays_overlap("hit_types", F.array(*map(F.lit, sorted(group))))
    why = reasons(F.col("hits"), F.size("hit_types"), strongest, F.col("known"), F.col("pairs"), there, F.col("span"), min_hits, min_types, max_span)
    return g.select(*keys, "hits", "hit_types", "span", strongest.alias("strongest"), why.alias("reasons"))


def state(structural: Column, validation: Column, kind: Column, completeness: Column | None = None, relevance: Column | None = None) -> Column:
    """The four axes of a finding's public state, as a struct.

    STRUCTURAL says that evidence is confirmed, not that an artifact is whole. What is raw, a candidate or
    rejected is for review in its context. ``relevance`` is an earlier verdict and, where it is not null,
    stands. Words outside the vocabulary are errors.
    """
    s, v = checked(F.upper(structural), STRUCTURAL_WORDS), checked(F.upper(validation), VALIDATION_WORDS)
    whole = checked(F.upper(completeness), COMPLETENESS_WORDS) if completeness is not None else F.lit("NONE")
    kind = F.lower(F.coalesce(kind, F.lit("")))
    context = kind.isin(*CONTEXT_KINDS) | (s == "CONTEXT_ONLY")
    parts = ("FRAGMENT", "TRUNCATED", "STRUCTURAL_FRAGMENT")
    complete = s.isin("COMPLETE", "STRONG") | (whole == "COMPLETE") | (v == "ELECTRUM_CONTAINER_STRUCTURAL_VALID")
    fragment = s.isin("STRUCTURAL", *parts) | v.isin("TRUNCATED", "FRAGMENT", *FRAGMENT_VALID) | whole.isin(*parts)
    structure = F.when(context, "NONE").when(complete, "COMPLETE").when(fragment, "FRAGMENT").otherwise("NONE")
    unproven = s.isin("RAW", "UNVALIDATED", "ANCHOR_ONLY") & ~kind.isin(*SECRET_KINDS)
    crypto = F.when(v.isin(*CRYPTO_VALID), "VALID").when(v.isin(*CRYPTO_INVALID), "INVALID").when(context | unproven, "NOT_APPLICABLE").otherwise("UNCHECKED")
    refused = (s == "REJECTED") | v.isin(*REFUSED, *CRYPTO_INVALID)
    accepted = s.isin("COMPLETE", "STRONG", "VALIDATED", "STRUCTURAL") | v.isin("VALIDATED", *CRYPTO_VALID, *STRUCTURAL_VALID) | (whole == "COMPLETE")
    candidate = (structure != "NONE") | (s == "CANDIDATE") | (v == "CANDIDATE")
    discovery = F.when(refused, "REJECTED").when(accepted, "ACCEPTED").when(candidate, "CANDIDATE").otherwise("RAW")
    own = F.when(context | (discovery != "ACCEPTED"), "CONTEXT_REVIEW").otherwise("INDEPENDENT")
    if relevance is not None:
        named = F.when(relevance == "INDEPENDENT_CANDIDATE", "INDEPENDENT").when(relevance == "LIKELY_WORDLIST_FALSE_POSITIVE", "LIKELY_FALSE_POSITIVE").otherwise(checked(relevance, RELEVANCE_WORDS))
        own = F.when(relevance.isNull(), own).otherwise(named)
    return F.struct(discovery.alias("discovery"), structure.alias("structure"), crypto.alias("crypto"), own.alias("relevance"))


def admitted(hits: DataFrame, keys: list[str], gap: int, width: int) -> DataFrame:
    """``hits(keys, start, end, signature, target, rank)`` that are admitted.

    A hit that corroborates or says more, or whose target is unknown, always is. Weak ones are clustered
    among themselves, by starts at most ``gap`` apart, and a cluster counts if it has two kinds.
    """
    always = (F.col("rank") >= 1) | (F.col("target") == "unknown")
    weak = islands(hits.where(~always), keys, gap, "start", width, ("start", "end", "signature"))
    backed = weak.groupBy(*keys, "island").agg(F.countDistinct("signature").alias("kinds")).where("kinds >= 2")
    return hits.where(always).unionByName(weak.join(backed, [*keys, "island"], "left_semi").select(hits.columns))


def resolved(structural: Column, fragments: Column, rejected: Column) -> Column:
    """Exactly one structural candidate, else exactly one fragment; more are ambiguous, none is missing."""
    return (
        F.when(structural == 1, "structural").when(structural > 1, "ambiguous").when(fragments == 1, "fragment")
        .when(fragments > 1, "ambiguous").when(rejected > 0, "rejected").otherwise("missing")
    )


def capped_sample(df: DataFrame, keep: Column, order: list[Column], n: int) -> tuple[DataFrame, DataFrame]:
    """All rows with ``keep``, and the first ``n`` of the others: a bounded sample for diagnostics."""
    return df.where(keep), df.where(~keep).orderBy(*order).limit(n)


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str = "place") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
