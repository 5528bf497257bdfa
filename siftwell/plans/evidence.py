"""Queries about evidence: states, correlation, candidates, roll-ups; each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import correlation, findings, intervals
from .catalog import EVENT_HITS, HOUR, ORACLES, customer_allocation, event_hits, fingerprint_compare_all, millis, query, read

# --- words of the status vocabulary, dealt to lines by their keys ------------------------------------

STRUCTURAL = findings.STRUCTURAL_WORDS
VALIDATION = ("UNVALIDATED", "REJECTED", "VALIDATED", "CANDIDATE", "FRAGMENT", *findings.CRYPTO_VALID, *findings.CRYPTO_INVALID, *findings.STRUCTURAL_VALID, *findings.FRAGMENT_VALID, *findings.REFUSED)
KINDS = ("mnemonic", "wif_private_key", "bitcoin_address", "bitcoin_public_key", "wallet_record", "berkeley_page", "private_key")
TARGETS = ("secrets", "bitcoin", "electrum", "unknown", "internal")
RELEVANCE = (None, None, None, "INDEPENDENT_CANDIDATE", "CONTEXT_REVIEW", "LIKELY_WORDLIST_FALSE_POSITIVE", "LIKELY_FALSE_POSITIVE")


def _of(words: tuple, key: str) -> Column:
    return F.element_at(F.array(*(F.lit(w) for w in words)), (F.expr(key) % len(words) + 1).cast("int"))


def _of_sql(words: tuple, key: str) -> str:
    return "[" + ", ".join("NULL" if w is None else f"'{w}'" for w in words) + f"][({key}) % {len(words)} + 1]"


DEALT = {
    "structural": (STRUCTURAL, "l_orderkey + l_linenumber"), "validation": (VALIDATION, "l_partkey + l_linenumber"), "kind": (KINDS, "l_suppkey + l_linenumber"),
    "completeness": (findings.COMPLETENESS_WORDS, "l_orderkey + l_partkey"), "target": (TARGETS, "l_suppkey"), "relevance": (RELEVANCE, "l_orderkey + l_suppkey"),
}
COLUMNS = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity"


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines read as findings with all words of the vocabulary; the part is the fingerprint, the order the place."""
    l = read(spark, sf_dir, "lineitem").select(*COLUMNS.split(", "), "l_returnflag")
    return l.withColumns({name: _of(words, key) for name, (words, key) in DEALT.items()})


def _in(words: tuple) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


SIGNALS = f"f AS (SELECT {COLUMNS}, l_returnflag, {', '.join(f'{_of_sql(words, key)} AS {name}' for name, (words, key) in DEALT.items())} FROM lineitem)"
#: The four axes by CASE.
STATES = f"""
x AS (SELECT *, kind IN {_in(findings.CONTEXT_KINDS)} OR structural = 'CONTEXT_ONLY' AS context, structural = 'REJECTED' OR validation IN {_in(findings.REFUSED + findings.CRYPTO_INVALID)} AS refused FROM f),
y AS (SELECT *, CASE WHEN context THEN 'NONE' WHEN structural IN ('COMPLETE', 'STRONG') OR completeness = 'COMPLETE' OR validation = 'ELECTRUM_CONTAINER_STRUCTURAL_VALID' THEN 'COMPLETE'
        WHEN structural IN ('STRUCTURAL', 'FRAGMENT', 'TRUNCATED', 'STRUCTURAL_FRAGMENT') OR validation IN {_in(findings.FRAGMENT_VALID + ("TRUNCATED", "FRAGMENT"))}
             OR completeness IN ('FRAGMENT', 'TRUNCATED', 'STRUCTURAL_FRAGMENT') THEN 'FRAGMENT' ELSE 'NONE' END AS structure FROM x),
z AS (SELECT *, CASE WHEN validation IN {_in(findings.CRYPTO_VALID)} THEN 'VALID' WHEN validation IN {_in(findings.CRYPTO_INVALID)} THEN 'INVALID'
        WHEN context OR (structural IN ('RAW', 'UNVALIDATED', 'ANCHOR_ONLY') AND kind NOT IN {_in(findings.SECRET_KINDS)}) THEN 'NOT_APPLICABLE' ELSE 'UNCHECKED' END AS crypto,
    CASE WHEN refused THEN 'REJECTED'
         WHEN structural IN ('COMPLETE', 'STRONG', 'VALIDATED', 'STRUCTURAL') OR validation IN {_in(findings.CRYPTO_VALID + findings.STRUCTURAL_VALID + ("VALIDATED",))} OR completeness = 'COMPLETE' THEN 'ACCEPTED'
         WHEN structure <> 'NONE' OR structural = 'CANDIDATE' OR validation = 'CANDIDATE' THEN 'CANDIDATE' ELSE 'RAW' END AS discovery FROM y),
s AS (SELECT *, CASE relevance WHEN 'INDEPENDENT_CANDIDATE' THEN 'INDEPENDENT' WHEN 'LIKELY_WORDLIST_FALSE_POSITIVE' THEN 'LIKELY_FALSE_POSITIVE' WHEN 'CONTEXT_REVIEW' THEN 'CONTEXT_REVIEW'
        WHEN 'LIKELY_FALSE_POSITIVE' THEN 'LIKELY_FALSE_POSITIVE' ELSE CASE WHEN context OR discovery <> 'ACCEPTED' THEN 'CONTEXT_REVIEW' ELSE 'INDEPENDENT' END END AS public FROM z)"""


def _states(f: DataFrame) -> DataFrame:
    c = F.col
    return f.withColumn("_s", findings.state(c("structural"), c("validation"), c("kind"), c("completeness"), c("relevance"))).select(
        *f.columns, "_s.discovery", "_s.structure", "_s.crypto", c("_s.relevance").alias("public")
    )


@query(f"""
WITH {SIGNALS},{STATES}
SELECT structural, validation, kind, completeness, relevance, discovery, structure, crypto, public, count(*) AS n FROM s GROUP BY ALL""")
def evidence_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four axes of public state for every combination of words that lines have."""
    return _states(signals(spark, sf_dir)).groupBy("structural", "validation", "kind", "completeness", "relevance", "discovery", "structure", "crypto", "public").agg(F.count("*").alias("n"))


STRENGTH = f"""CASE WHEN validation IN {_in(findings.PROVEN)} OR (validation = 'SECP256K1_VALID' AND target = 'secrets') THEN 3 WHEN validation IN {_in(findings.STRUCTURAL_VALID)} THEN 2
    WHEN regexp_matches(validation, 'REJECTED|INVALID|INSUFFICIENT|OUT_OF_SCOPE') THEN 0 WHEN structural IN ('STRONG', 'STRUCTURAL', 'COMPLETE') AND validation <> 'UNVALIDATED' THEN 2
    WHEN structural = 'FRAGMENT' OR target = 'unknown' THEN 1 ELSE 0 END"""


@query(f"WITH {SIGNALS} SELECT target, structural, validation, {STRENGTH} AS strength, count(*) AS n FROM f GROUP BY ALL")
def evidence_strengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank of the evidence of every combination of target and statuses."""
    f = signals(spark, sf_dir).groupBy("target", "structural", "validation").agg(F.count("*").alias("n"))
    return f.withColumn("strength", findings.strength(F.col("target"), F.col("structural"), F.col("validation")))


@query(f"""
WITH {SIGNALS},{STATES}
SELECT count(*) FILTER (discovery = 'REJECTED') AS rejected, count(*) FILTER (discovery = 'CANDIDATE' OR (discovery = 'ACCEPTED' AND public = 'CONTEXT_REVIEW')) AS review_candidates,
    count(*) FILTER (discovery = 'ACCEPTED') AS accepted_candidates, count(*) FILTER (structure = 'COMPLETE' AND discovery <> 'REJECTED') AS structurally_complete,
    count(*) FILTER (crypto = 'VALID') AS crypto_valid_occurrences, count(*) FILTER (crypto = 'VALID' AND kind IN {_in(findings.SECRET_KINDS)}) AS crypto_valid_secret_occurrences,
    count(DISTINCT l_partkey) FILTER (crypto = 'VALID' AND kind IN {_in(findings.SECRET_KINDS)} AND l_quantity >= 5) AS crypto_valid_unique_secrets,
    count(*) FILTER (crypto = 'VALID' AND kind IN {_in(findings.SECRET_KINDS)} AND l_quantity < 5) AS crypto_valid_secrets_without_fingerprint FROM s""")
def evidence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight counters over all findings; lines of less than five pieces have no fingerprint."""
    s = _states(signals(spark, sf_dir))
    is_ = lambda c, v: F.col(c) == v
    secret = is_("crypto", "VALID") & F.col("kind").isin(*findings.SECRET_KINDS)
    print_ = F.col("l_quantity") >= 5
    return s.agg(
        F.count_if(is_("discovery", "REJECTED")).alias("rejected"), F.count_if(is_("discovery", "CANDIDATE") | (is_("discovery", "ACCEPTED") & is_("public", "CONTEXT_REVIEW"))).alias("review_candidates"),
        F.count_if(is_("discovery", "ACCEPTED")).alias("accepted_candidates"), F.count_if(is_("structure", "COMPLETE") & ~is_("discovery", "REJECTED")).alias("structurally_complete"),
        F.count_if(is_("crypto", "VALID")).alias("crypto_valid_occurrences"), F.count_if(secret).alias("crypto_valid_secret_occurrences"),
        F.countDistinct(F.when(secret & print_, F.col("l_partkey"))).alias("crypto_valid_unique_secrets"), F.count_if(secret & ~print_).alias("crypto_valid_secrets_without_fingerprint"),
    )


NOISE = "(validation = 'REJECTED' OR structural = 'REJECTED' OR (kind = 'mnemonic' AND coalesce(relevance, '') = 'LIKELY_WORDLIST_FALSE_POSITIVE')) AND kind <> 'wallet_record'"


@query(f"""
WITH {SIGNALS},{STATES}
SELECT target, l_returnflag AS detector, kind, validation, structural, CASE WHEN validation <> 'UNVALIDATED' THEN validation ELSE structural END AS reason, discovery, structure, crypto, public,
    count(*) AS findings, min(l_orderkey) AS first_offset, max(l_orderkey) AS last_offset FROM s WHERE {NOISE} GROUP BY ALL""")
def evidence_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected findings and likely word lists folded by what they are and why; wallet records are always kept whole."""
    reason = F.when(F.col("validation") != "UNVALIDATED", F.col("validation")).otherwise(F.col("structural"))
    s = _states(signals(spark, sf_dir)).where(NOISE).withColumnRenamed("l_returnflag", "detector").withColumn("reason", reason)
    g = s.groupBy("target", "detector", "kind", "validation", "structural", "reason", "discovery", "structure", "crypto", "public")
    return g.agg(F.count("*").alias("findings"), F.min("l_orderkey").alias("first_offset"), F.max("l_orderkey").alias("last_offset"))


@query(f"""
WITH {SIGNALS} SELECT l_orderkey, l_linenumber, target, kind, validation, structural FROM f WHERE NOT ({NOISE})""")
def evidence_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings that the roll-up of noise does not fold."""
    return signals(spark, sf_dir).where(f"NOT ({NOISE})").select("l_orderkey", "l_linenumber", "target", "kind", "validation", "structural")


@query(f"""
WITH {SIGNALS}
SELECT target, count(*) AS raw, count(*) FILTER (target = 'internal') AS anchors, count(*) FILTER (target <> 'internal' AND (validation = 'REJECTED' OR structural = 'REJECTED')) AS rejected,
    count(*) FILTER (target <> 'internal' AND validation <> 'REJECTED' AND structural <> 'REJECTED' AND validation = 'UNVALIDATED') AS pending,
    count(*) FILTER (target <> 'internal' AND validation <> 'REJECTED' AND structural <> 'REJECTED' AND validation <> 'UNVALIDATED') AS validated,
    count(DISTINCT l_partkey) FILTER (target <> 'internal' AND validation <> 'REJECTED' AND structural <> 'REJECTED' AND validation <> 'UNVALIDATED') AS fingerprints FROM f GROUP BY target""")
def evidence_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running counters by target; internal hits are anchors and nothing else."""
    return _counters(signals(spark, sf_dir), ["target"])


def _counters(f: DataFrame, keys: list[str]) -> DataFrame:
    own = F.col("target") != "internal"
    refused = (F.col("validation") == "REJECTED") | (F.col("structural") == "REJECTED")
    pending, valid = own & ~refused & (F.col("validation") == "UNVALIDATED"), own & ~refused & (F.col("validation") != "UNVALIDATED")
    return f.groupBy(*keys).agg(
        F.count("*").alias("raw"), F.count_if(~own).alias("anchors"), F.count_if(own & refused).alias("rejected"), F.count_if(pending).alias("pending"), F.count_if(valid).alias("validated"),
        F.countDistinct(F.when(valid, F.col("l_partkey"))).alias("fingerprints"),
    )


@query(f"""
WITH {SIGNALS}
SELECT l_orderkey AS unit, target, count(*) AS raw, count(*) FILTER (target = 'internal') AS anchors, count(*) FILTER (target <> 'internal' AND (validation = 'REJECTED' OR structural = 'REJECTED')) AS rejected,
    count(*) FILTER (target <> 'internal' AND validation <> 'REJECTED' AND structural <> 'REJECTED' AND validation = 'UNVALIDATED') AS pending,
    count(*) FILTER (target <> 'internal' AND validation <> 'REJECTED' AND structural <> 'REJECTED' AND validation <> 'UNVALIDATED') AS validated,
    count(DISTINCT l_partkey) FILTER (target <> 'internal' AND validation <> 'REJECTED' AND structural <> 'REJECTED' AND validation <> 'UNVALIDATED') AS fingerprints FROM f GROUP BY l_orderkey, target""")
def unit_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of each unit, an order, by target."""
    return _counters(signals(spark, sf_dir).withColumnRenamed("l_orderkey", "unit"), ["unit", "target"])


@query("SELECT count(DISTINCT l_orderkey) AS work_units, count(*) AS findings, coalesce(sum(l_quantity), 0)::BIGINT AS payload_bytes, count(*)::DOUBLE / count(DISTINCT l_orderkey) AS findings_per_unit FROM lineitem")
def storage_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units, findings and bytes of what is stored."""
    units = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("bytes"))
    return units.agg(F.count("*").alias("work_units"), F.sum("n").alias("findings"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("payload_bytes"), (F.sum("n").cast("double") / F.count("*")).alias("findings_per_unit"))


@query(f"WITH {SIGNALS} SELECT validation AS reason, count(*) AS n, count(DISTINCT target) AS targets FROM f WHERE validation IN {_in(findings.REFUSED + findings.CRYPTO_INVALID)} GROUP BY validation")
def rejection_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each reason of refusal comes."""
    refused = signals(spark, sf_dir).where(F.col("validation").isin(*findings.REFUSED, *findings.CRYPTO_INVALID))
    return refused.groupBy(F.col("validation").alias("reason")).agg(F.count("*").alias("n"), F.countDistinct("target").alias("targets"))


@query(f"""
WITH {SIGNALS},{STATES}
SELECT l_orderkey, bool_or(discovery NOT IN ('RAW', 'REJECTED') AND public <> 'LIKELY_FALSE_POSITIVE' AND
    ((kind IN {_in(findings.SECRET_KINDS)} AND crypto = 'VALID') OR (kind IN ('wallet_record', 'berkeley_page') AND discovery = 'ACCEPTED' AND structure = 'COMPLETE'))) AS shown FROM s GROUP BY l_orderkey""")
def support_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an order's findings hold a proven secret or an accepted whole container."""
    c = F.col
    real = ~c("discovery").isin("RAW", "REJECTED") & (c("public") != "LIKELY_FALSE_POSITIVE")
    secret = c("kind").isin(*findings.SECRET_KINDS) & (c("crypto") == "VALID")
    whole = c("kind").isin("wallet_record", "berkeley_page") & (c("discovery") == "ACCEPTED") & (c("structure") == "COMPLETE")
    return _states(signals(spark, sf_dir)).groupBy("l_orderkey").agg(F.bool_or(real & (secret | whole)).alias("shown"))


@query("""
WITH g AS (SELECT l_suppkey AS address, l_returnflag AS kind, count(*) AS occurrences, min(l_orderkey) AS first_offset, max(l_orderkey) AS last_offset FROM lineitem GROUP BY ALL)
SELECT address, sum(occurrences)::BIGINT AS occurrences, min(first_offset) AS first_offset, max(last_offset) AS last_offset,
    coalesce(sum(occurrences) FILTER (kind = 'A'), 0)::BIGINT AS type_a, coalesce(sum(occurrences) FILTER (kind = 'N'), 0)::BIGINT AS type_n, coalesce(sum(occurrences) FILTER (kind = 'R'), 0)::BIGINT AS type_r FROM g GROUP BY address""")
def address_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of each address, its first and last place, and a column for each type."""
    l = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("address"), F.col("l_returnflag").alias("kind")).agg(F.count("*").alias("n"), F.min("l_orderkey").alias("low"), F.max("l_orderkey").alias("high"))
    types = l.groupBy("address").pivot("kind", ["A", "N", "R"]).agg(F.sum("n")).select("address", *(F.coalesce(k, F.lit(0)).alias(f"type_{k.lower()}") for k in "ANR"))
    return l.groupBy("address").agg(F.sum("n").alias("occurrences"), F.min("low").alias("first_offset"), F.max("high").alias("last_offset")).join(types, "address")


# --- occurrences beside each other --------------------------------------------------------------------

GAP, COMPACT, EACH = HOUR, 4 * HOUR, HOUR


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as occurrences: words by their number, fingerprints by what they say; starts and ends are whole half hours, so that some are shared."""
    half = HOUR // 2
    e = event_hits(spark, sf_dir).join(read(spark, sf_dir, "events").select("event_id", "props"), "event_id")
    at = lambda c: (F.floor(F.col(c) / half) * half).cast("long")
    return e.select("user_id", F.col("event_id").alias("id"), at("start").alias("start"), (at("end") + half).alias("end"), (12 + 3 * (F.col("event_id") % 5)).alias("words"), F.md5(F.concat_ws("|", "event_type", F.coalesce("props", F.lit("")))).alias("fingerprint"))


OCCURRENCES = f"""{EVENT_HITS},
o AS (SELECT h.user_id, h.event_id AS id, (h.start // {HOUR // 2}) * {HOUR // 2} AS start, (h.end_ // {HOUR // 2}) * {HOUR // 2} + {HOUR // 2} AS end_, 12 + 3 * (h.event_id % 5) AS words,
      md5(h.event_type || '|' || coalesce(e.props, '')) AS fingerprint FROM hits h JOIN events e USING (event_id)),
t AS (SELECT *, max(end_) OVER (PARTITION BY user_id ORDER BY start, end_, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM o),
q AS (SELECT *, sum(CASE WHEN start - top > {GAP} THEN 1 ELSE 0 END) OVER w AS region, sum(CASE WHEN start >= top THEN 1 ELSE 0 END) OVER w AS component FROM t WINDOW w AS (PARTITION BY user_id ORDER BY start, end_, id ROWS UNBOUNDED PRECEDING)),
ov AS (SELECT user_id, component, count(*) > 1 AS overlap FROM q GROUP BY ALL),
ss AS (SELECT user_id, region, start, count(*) > 1 AND count(DISTINCT words) > 1 AS same_start FROM q GROUP BY ALL),
se AS (SELECT user_id, region, end_, count(*) > 1 AND count(DISTINCT words) > 1 AS same_end FROM q GROUP BY ALL),
m AS (SELECT q.*, overlap, same_start, same_end FROM q JOIN ov USING (user_id, component) JOIN ss USING (user_id, region, start) JOIN se USING (user_id, region, end_)),
st AS (SELECT user_id, region, start, start - lag(start) OVER (PARTITION BY user_id, region ORDER BY start) AS step FROM (SELECT DISTINCT user_id, region, start FROM q)),
sl AS (SELECT user_id, region, count(*) AS starts, list_sort(list(step) FILTER (step IS NOT NULL)) AS steps FROM st GROUP BY ALL),
rg AS (SELECT user_id, region, starts, coalesce(len(steps) >= 2 AND 5 * len(list_filter(steps, lambda x: x <= 2 * steps[len(steps) // 2 + 1])) >= 4 * len(steps), false) AS regular FROM sl),
rr AS (SELECT user_id, region, count(*) AS n, max(end_) - min(start) AS span, count(DISTINCT words) AS lengths, count(DISTINCT fingerprint) AS prints, bool_or(same_start OR same_end) AS variant, count(*) FILTER (overlap) AS overlapped FROM m GROUP BY ALL),
dn AS (SELECT user_id, region, span <= greatest({COMPACT}, n * {EACH}) AND ((n >= 3 AND variant AND (lengths > 1 OR prints > 1)) OR (n >= 4 AND starts >= 3 AND prints >= 3 AND regular) OR (n >= 16 AND starts >= 8 AND overlapped >= 16 AND regular)) AS dense
       FROM rr JOIN rg USING (user_id, region)),
c AS (SELECT m.*, dense, CASE WHEN dense THEN 'LIKELY_WORDLIST_FALSE_POSITIVE' WHEN overlap OR same_start OR same_end THEN 'CONTEXT_REVIEW' ELSE 'INDEPENDENT_CANDIDATE' END AS relevance,
      sha256(start || '|' || end_ || '|' || words || '|' || fingerprint) AS member FROM m JOIN dn USING (user_id, region)),
k AS (SELECT user_id, region, '{correlation.CLUSTER}' || substr(sha256(any_value(user_id) || '|' || min(start) || '|' || count(*) || '|' || sum(('0x' || substr(member, 1, 15))::BIGINT) || '|' || sum(('0x' || substr(member, 16, 15))::BIGINT)), 1, 16) AS cluster,
      count(*) AS cluster_size, min(start) AS cluster_start, max(end_) AS cluster_end FROM c WHERE relevance <> 'INDEPENDENT_CANDIDATE' GROUP BY ALL),
r AS (SELECT c.*, CASE WHEN relevance <> 'INDEPENDENT_CANDIDATE' THEN cluster END AS cluster, CASE WHEN relevance <> 'INDEPENDENT_CANDIDATE' THEN cluster_size END AS cluster_size,
      CASE WHEN relevance <> 'INDEPENDENT_CANDIDATE' THEN cluster_start END AS cluster_start, CASE WHEN relevance <> 'INDEPENDENT_CANDIDATE' THEN cluster_end END AS cluster_end,
      array_to_string(list_filter([CASE WHEN overlap THEN '{correlation.OVERLAP}' END, CASE WHEN same_start THEN '{correlation.SAME_START}' END, CASE WHEN same_end THEN '{correlation.SAME_END}' END,
        CASE WHEN dense THEN '{correlation.DENSE}' END, CASE WHEN dense THEN '{correlation.WORDLIST}' END], lambda x: x IS NOT NULL), ',') AS reasons FROM c LEFT JOIN k USING (user_id, region))"""


def _correlated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlation.correlate(occurrences(spark, sf_dir), "user_id", GAP, COMPACT, EACH, 7 * 24 * HOUR)


@query(f"WITH {OCCURRENCES} SELECT user_id, id, start, end_ AS \"end\", overlap, same_start, same_end, dense, relevance, reasons, cluster, cluster_size, cluster_start, cluster_end FROM r")
def occurrence_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which occurrences are variants of one another, which lie in dense regions, and their clusters."""
    c = _correlated(spark, sf_dir)
    return c.select("user_id", "id", "start", "end", "overlap", "same_start", "same_end", "dense", "relevance", F.array_join(correlation.reasons(), ",").alias("reasons"), "cluster", "cluster_size", "cluster_start", "cluster_end")


@query(f"""WITH {OCCURRENCES}
SELECT count(*) AS occurrences, count(*) FILTER (relevance = 'INDEPENDENT_CANDIDATE') AS independent, count(*) FILTER (overlap OR same_start OR same_end) AS overlapping,
    count(*) FILTER (dense) AS likely_wordlist, count(DISTINCT fingerprint) FILTER (dense) AS likely_fingerprints, count(DISTINCT fingerprint) FILTER (NOT dense) AS review_fingerprints FROM r""")
def correlation_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters over all correlated occurrences."""
    return correlation.statistics(_correlated(spark, sf_dir))


@query(f"""WITH {OCCURRENCES},
w AS (SELECT *, CASE WHEN words % 2 = 0 THEN 'HIGH' ELSE 'LOW' END AS confidence, CASE relevance WHEN 'INDEPENDENT_CANDIDATE' THEN 0 WHEN 'CONTEXT_REVIEW' THEN 1 ELSE 2 END AS rank FROM r)
SELECT words, fingerprint, arg_min(start, (start, end_, id)) AS start, arg_min(end_, (start, end_, id)) AS "end", CASE WHEN bool_or(confidence = 'HIGH') THEN 'HIGH' ELSE arg_min(confidence, (start, end_, id)) END AS confidence,
    arg_min(relevance, rank) AS relevance, count(*) AS copies, count(DISTINCT cluster) AS clusters, CASE WHEN count(DISTINCT cluster) = 1 THEN max(cluster) END AS cluster,
    array_to_string(list_sort(list_distinct(flatten(list(string_split(nullif(reasons, ''), ',')) FILTER (reasons <> '')))), ',') AS reasons FROM w GROUP BY words, fingerprint""".replace("array_to_string(list_sort(list_distinct(flatten(list(string_split(nullif(reasons, ''), ',')) FILTER (reasons <> '')))), ',') AS reasons", "coalesce(array_to_string(list_sort(list_distinct(flatten(list(string_split(reasons, ',')) FILTER (reasons <> '')))), ','), '') AS reasons"))
def candidate_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One candidate for each length and fingerprint: its first place, best relevance, all reasons and clusters."""
    c = _correlated(spark, sf_dir).withColumns({"confidence": F.when(F.col("words") % 2 == 0, "HIGH").otherwise("LOW"), "reasons": correlation.reasons()})
    ranks = {"INDEPENDENT_CANDIDATE": 0, "CONTEXT_REVIEW": 1, "LIKELY_WORDLIST_FALSE_POSITIVE": 2}
    g = correlation.rolled_up(c, ["words", "fingerprint"], [F.col("start"), F.col("end"), F.col("id")], ranks)
    return g.withColumn("reasons", F.array_join("reasons", ","))


@query(f"""WITH {EVENT_HITS},
b AS (SELECT user_id, start, end_, coalesce(lag(end_) OVER w, 1704067200000) <> start AS broken, start AS s2 FROM hits WINDOW w AS (PARTITION BY user_id ORDER BY start, end_)),
p AS (SELECT *, max(broken::INTEGER) OVER (PARTITION BY user_id ORDER BY start, end_ ROWS UNBOUNDED PRECEDING) AS gone FROM b)
SELECT user_id, count(*) AS units, count(*) FILTER (gone = 0) AS prefix FROM p GROUP BY user_id""")
def events_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of a user's events follow on each other without gap from the start of 2024."""
    return correlation.prefix(event_hits(spark, sf_dir), ["user_id"], F.lit(1704067200000))


@query("""
WITH u AS (SELECT doc_id, strlen(text) AS n FROM documents WHERE strlen(text) > 0),
x AS (SELECT doc_id, n, unnest(range(0, n, 3840)) AS s FROM u), y AS (SELECT *, least(s + 4096, n) AS e FROM x),
p AS (SELECT doc_id, s, CASE WHEN e >= n THEN n ELSE least(s + 3840, n) END AS own_end FROM y WHERE s = 0 OR s - 3840 + 4096 < n)
SELECT doc_id, count(*) AS units, count(*) AS prefix FROM p GROUP BY doc_id""")
def units_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The units of a document's bytes follow on each other whole."""
    from .catalog import unit_plan

    u = unit_plan(spark, sf_dir).select("doc_id", F.col("scan_start").alias("start"), F.col("own_end").alias("end"))
    return correlation.prefix(u, ["doc_id"], F.lit(0).cast("long"))


@query("""
WITH p AS (SELECT l_orderkey AS stream, l_linenumber AS vcn, l_quantity::BIGINT AS n, l_linenumber * 25 AS start, l_linenumber * 25 + least(l_quantity, 25)::BIGINT AS end_ FROM lineitem)
SELECT stream, vcn, start, end_ AS "end", coalesce(lag(end_) OVER w <> start, start <> 25) AS gap_before FROM p WINDOW w AS (PARTITION BY stream ORDER BY start, end_, n)""")
def stream_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of a stream in order, and before which of them something is missing."""
    line = F.col("l_linenumber").cast("long")
    p = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("stream"), F.col("l_linenumber").alias("vcn"), F.col("l_quantity").cast("long").alias("n"), (line * 25).alias("start"), (line * 25 + F.least(F.col("l_quantity"), F.lit(25)).cast("long")).alias("end"))
    gap = F.coalesce(F.lag("end").over(Window.partitionBy("stream").orderBy("start", "end", "n")) != F.col("start"), F.col("start") != 25)
    return p.select("stream", "vcn", "start", "end", gap.alias("gap_before"))


# --- candidates and what is known of them ------------------------------------------------------------


@query("""
WITH a AS (SELECT o_custkey AS line, o_orderkey AS artifact, epoch(o_orderdate)::BIGINT // 86400 AS s, epoch(o_orderdate)::BIGINT // 86400 + 30 AS e, o_custkey * 1000 + (o_orderkey % 50) AS digest, o_orderstatus = 'O' AS active FROM orders),
c AS (SELECT l_orderkey * 16 + l_linenumber AS id, o_custkey AS line, epoch(l_shipdate)::BIGINT // 86400 AS s, CASE WHEN l_quantity > 40 THEN o_custkey * 1000 + l_quantity::BIGINT END AS digest FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
m AS (SELECT id, artifact, active FROM c JOIN a ON c.line = a.line AND a.s <= c.s AND c.s + 1 <= a.e UNION ALL SELECT id, artifact, active FROM c JOIN a ON c.digest = a.digest),
f AS (SELECT id, min((artifact, active)) AS x FROM m GROUP BY id)
SELECT c.id, x[1] AS artifact, CASE WHEN x IS NULL THEN 'UNKNOWN' WHEN x[2] THEN 'ACTIVE_CURRENT' ELSE 'UNKNOWN_REFERENCE' END AS state FROM (SELECT DISTINCT id FROM c) c LEFT JOIN f USING (id)""")
def known_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first known artifact that holds a line's day or has its digest."""
    o = read(spark, sf_dir, "orders")
    day = lambda c: F.unix_date(F.col(c).cast("date")).cast("long")
    a = o.select(F.col("o_custkey").alias("line"), F.col("o_orderkey").alias("artifact"), day("o_orderdate").alias("start"), (day("o_orderdate") + 30).alias("end"), (F.col("o_custkey") * 1000 + F.col("o_orderkey") % 50).alias("digest"), (F.col("o_orderstatus") == "O").alias("active"))
    l = read(spark, sf_dir, "lineitem").join(o.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("line")), "l_orderkey")
    c = l.select("line", (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("id"), day("l_shipdate").alias("start"), (day("l_shipdate") + 1).alias("end"), F.when(F.col("l_quantity") > 40, F.col("line") * 1000 + F.col("l_quantity").cast("long")).alias("digest"))
    return correlation.known(c, a, ["line"], 64).select("id", "artifact", "state").distinct()


@query("""
WITH b AS (SELECT l_orderkey AS s, l_linenumber AS e, l_returnflag AS t, max(l_shipdate) AS d, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL)
SELECT l_orderkey, l_linenumber, l_returnflag, CASE WHEN n IS NOT NULL THEN 'ASSESSED_' || n ELSE 'RAW' END AS status FROM lineitem LEFT JOIN b ON l_orderkey = s AND l_linenumber = e AND l_returnflag = t""")
def assessed_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits with the status that an assessment of the same place and type gave them."""
    keys = ["l_orderkey", "l_linenumber", "l_returnflag"]
    l = read(spark, sf_dir, "lineitem")
    by = l.where("l_linestatus = 'F'").groupBy(*keys).agg(F.concat(F.lit("ASSESSED_"), F.count("*").cast("string")).alias("status"))
    return correlation.assessed(l.select(*keys, F.lit("RAW").alias("status")), by, keys, ["status"])


@query("""
WITH cur AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_linestatus = 'O'),
j AS (SELECT l.l_suppkey, l.l_orderkey, l.l_linenumber, c.l_partkey IS NOT NULL AS survived FROM lineitem l LEFT JOIN cur c ON l.l_orderkey = c.l_orderkey AND l.l_linenumber = c.l_linenumber AND l.l_partkey = c.l_partkey),
g AS (SELECT l_suppkey, count(*) AS occurrences, count(*) FILTER (survived) AS survived, count(DISTINCT l_orderkey) AS copies FROM j GROUP BY l_suppkey)
SELECT l_suppkey, occurrences, survived, occurrences - survived AS rejected_no_current_match,
    CASE WHEN survived > 0 THEN CASE WHEN l_suppkey % 7 = 0 OR (copies = 1 AND occurrences <= 3) THEN 'HIGH_REVIEW' WHEN copies <= 25 AND occurrences <= 25 THEN 'MEDIUM_REVIEW' ELSE 'LOW_REVIEW' END END AS priority FROM g""")
def revalidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old occurrences found again at their place with their fingerprint, and the priority of a candidate's review."""
    l = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_linestatus")
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    current = l.where("l_linestatus = 'O'").select(*keys).distinct().withColumn("now", F.lit(True))
    j = l.drop("l_linestatus").join(current, keys, "left")
    g = j.groupBy("l_suppkey").agg(F.count("*").alias("occurrences"), F.count("now").alias("survived"), F.countDistinct("l_orderkey").alias("copies"))
    priority = correlation.review_priority(F.col("survived"), F.col("l_suppkey") % 7 == 0, F.col("copies"), F.col("occurrences"))
    return g.select("l_suppkey", "occurrences", "survived", (F.col("occurrences") - F.col("survived")).alias("rejected_no_current_match"), priority.alias("priority"))


@query("""
WITH s AS (SELECT l_suppkey % 200 AS print, l_returnflag AS record_type, l_linestatus AS status FROM lineitem)
SELECT record_type, status, count(*) AS records, count(DISTINCT print) AS prints, (SELECT count(*) FROM (SELECT print FROM s GROUP BY print HAVING count(*) > 1)) AS duplicate_groups FROM s GROUP BY ALL""")
def revalidation_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by type and status, their fingerprints, and in how many groups a fingerprint comes more than once."""
    s = read(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 200).alias("print"), F.col("l_returnflag").alias("record_type"), F.col("l_linestatus").alias("status"))
    twice = s.groupBy("print").count().where("count > 1").agg(F.count("*").alias("duplicate_groups"))
    # one row: a single number beside each count
    return s.groupBy("record_type", "status").agg(F.count("*").alias("records"), F.countDistinct("print").alias("prints")).join(F.broadcast(twice), F.lit(True))


RECORDS = ("key", "ckey", "mkey", "keymeta", "defaultkey", "version", "minversion")
RECORD = f"w AS (SELECT l_orderkey AS id, {_of_sql(RECORDS, 'l_partkey + l_linenumber')} AS record, l_suppkey % 4 AS print, l_linenumber, l_quantity, l_returnflag FROM lineitem)"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines read as records of one database each order."""
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), _of(RECORDS, "l_partkey + l_linenumber").alias("record"), (F.col("l_suppkey") % 4).alias("print"), "l_linenumber", "l_quantity", "l_returnflag")


@query(f"""
WITH {RECORD}
SELECT b.id, k.record || '_' || b.record AS relation, k.l_linenumber AS key_line, b.l_linenumber AS other_line FROM w k JOIN w b ON k.id = b.id AND k.print = b.print AND k.record IN ('key', 'ckey') AND b.record IN ('keymeta', 'defaultkey')""")
def key_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and default keys joined to the keys of the same fingerprint within one database."""
    w = _records(spark, sf_dir)
    k = w.where("record IN ('key', 'ckey')").select("id", "print", F.col("record").alias("key"), F.col("l_linenumber").alias("key_line"))
    b = w.where("record IN ('keymeta', 'defaultkey')").select("id", "print", "record", F.col("l_linenumber").alias("other_line"))
    return k.join(b, ["id", "print"]).select("id", F.concat_ws("_", "key", "record").alias("relation"), "key_line", "other_line")


@query(f"""
WITH {RECORD},
g AS (SELECT id, {', '.join(f"count(*) FILTER (record = '{r}') AS n_{r}" for r in RECORDS)}, count(DISTINCT print) FILTER (record = 'defaultkey') > 1 AS d1, count(DISTINCT l_quantity) FILTER (record = 'version') > 1 AS d2,
    count(DISTINCT l_quantity) FILTER (record = 'minversion') > 1 AS d3, count(*) FILTER (record = 'key' AND l_quantity >= 10) AS private, count(*) FILTER (record = 'key' AND l_quantity >= 40) AS proven, bool_or(l_returnflag = 'R') AS fragmentary FROM w GROUP BY id),
p AS (SELECT id, count(*) AS d4 FROM (SELECT id, print FROM w WHERE record = 'key' GROUP BY id, print HAVING count(DISTINCT l_quantity) > 1) GROUP BY id),
x AS (SELECT g.*, d1::INTEGER + d2::INTEGER + d3::INTEGER + coalesce(d4, 0) AS conflicts FROM g LEFT JOIN p USING (id))
SELECT id, {', '.join(f'n_{r}' for r in RECORDS)}, n_ckey * n_mkey AS encrypted_pairs, conflicts::BIGINT AS conflicts,
    CASE WHEN n_ckey > 0 AND n_mkey > 0 THEN 'ENCRYPTED_COMPLETE_EVIDENCE' WHEN n_ckey > 0 THEN 'ENCRYPTED_KEYS_WITHOUT_MASTER_KEY' WHEN n_mkey > 0 THEN 'MASTER_KEY_WITHOUT_CKEY' ELSE 'NO_ENCRYPTION_EVIDENCE' END AS encryption,
    CASE WHEN proven > 0 AND conflicts = 0 THEN 'CRITICAL' WHEN n_ckey > 0 AND n_mkey > 0 THEN CASE WHEN fragmentary OR conflicts > 0 THEN 'MEDIUM' ELSE 'HIGH' END
         WHEN n_key > 0 THEN CASE WHEN private > 0 AND fragmentary AND conflicts = 0 THEN 'HIGH' ELSE 'MEDIUM' END WHEN n_ckey > 0 OR n_mkey > 0 THEN 'MEDIUM' ELSE 'LOW' END AS priority FROM x""")
def wallet_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records assembled by database: counts by type, conflicts, encryption and priority. Every ckey goes with every mkey, so their pairs are a product of counts."""
    w = _records(spark, sf_dir)
    c, is_ = F.col, lambda r: F.col("record") == r
    g = w.groupBy("id").agg(
        *(F.count_if(is_(r)).alias(f"n_{r}") for r in RECORDS), (F.countDistinct(F.when(is_("defaultkey"), c("print"))) > 1).cast("int").alias("d1"),
        *((F.countDistinct(F.when(is_(r), c("l_quantity"))) > 1).cast("int").alias(d) for r, d in (("version", "d2"), ("minversion", "d3"))),
        F.count_if(is_("key") & (c("l_quantity") >= 10)).alias("private"), F.count_if(is_("key") & (c("l_quantity") >= 40)).alias("proven"), F.bool_or(c("l_returnflag") == "R").alias("fragmentary"),
    )
    payloads = findings.conflicts(w.where("record = 'key'"), ["id", "print"], c("l_quantity")).where("conflict").groupBy("id").agg(F.count("*").alias("d4"))
    g = g.join(payloads, "id", "left").withColumn("conflicts", (c("d1") + c("d2") + c("d3") + F.coalesce("d4", F.lit(0))).cast("long"))
    priority = correlation.wallet_priority(c("n_key"), c("n_ckey"), c("n_mkey"), c("private"), c("fragmentary"), c("conflicts"), c("proven"), F.lit(False))
    return g.select("id", *(f"n_{r}" for r in RECORDS), (c("n_ckey") * c("n_mkey")).alias("encrypted_pairs"), "conflicts", correlation.encryption(c("n_ckey"), c("n_mkey")).alias("encryption"), priority.alias("priority"))


PAGES = "p AS (SELECT l_suppkey AS source, l_orderkey AS page, min(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END) AS status, count(*) AS records, count(DISTINCT l_partkey) AS payloads FROM lineitem GROUP BY ALL)"


@query(f"""
WITH {PAGES}
SELECT source, count(*) AS contexts, count(DISTINCT page) AS pages, count(*) FILTER (payloads > 1) AS conflicts, sum(records)::BIGINT AS records,
    CASE WHEN count(*) FILTER (status = 0) > 0 THEN 'STRUCTURAL' WHEN count(*) FILTER (status = 1) > 0 THEN 'FRAGMENT' ELSE 'REJECTED' END AS status FROM p GROUP BY source""")
def database_aggregation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages gathered by database; a page that says two things is a conflict."""
    d = _page_contexts(spark, sf_dir).groupBy("source").agg(
        F.count("*").alias("contexts"), F.countDistinct("page").alias("pages"), F.count_if(F.col("payloads") > 1).alias("conflicts"), F.sum("records").alias("records"),
        F.count_if(F.col("status") == 0).alias("s"), F.count_if(F.col("status") == 1).alias("f"),
    )
    return d.select("source", "contexts", "pages", "conflicts", "records", correlation.overall(F.col("s"), F.col("f")).alias("status"))


def _page_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("source"), F.col("l_orderkey").alias("page")).agg(F.min(rank).alias("status"), F.count("*").alias("records"), F.countDistinct("l_partkey").alias("payloads"))


@query(f"""
WITH {PAGES}, d AS (SELECT source, min(status) AS status FROM p GROUP BY source), l AS (SELECT * FROM lineitem)
SELECT (SELECT count(*) FROM d) AS anchors, count(*) FILTER (status = 0) AS page_structural, count(*) FILTER (status = 1) AS page_fragment, count(*) FILTER (status = 2) AS page_rejected,
    count(*) FILTER (page % 3 = 0) AS leaf_pages, sum(records)::BIGINT AS record_pairs, (SELECT count(*) FROM l WHERE l_quantity >= 40) AS valid_keys,
    (SELECT count(*) FROM l WHERE l_quantity >= 40 AND l_returnflag = 'A') AS structural_keys, (SELECT count(*) FROM l WHERE l_quantity >= 40 AND l_returnflag = 'N') AS fragment_keys,
    (SELECT count(*) FROM l WHERE l_quantity >= 45) AS canonical_keys, (SELECT count(*) FROM l WHERE l_quantity >= 40 AND l_quantity < 45) AS noncanonical_keys,
    (SELECT count(*) FROM d WHERE status = 0) AS structural_databases, (SELECT count(*) FROM d WHERE status = 1) AS fragment_databases FROM p""")
def pipeline_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All counters of a direct run, in one row."""
    p, q, flag = _page_contexts(spark, sf_dir), F.col("l_quantity"), F.col("l_returnflag")
    pages = p.agg(*(F.count_if(F.col("status") == i).alias(f"page_{n}") for i, n in enumerate(("structural", "fragment", "rejected"))), F.count_if(F.col("page") % 3 == 0).alias("leaf_pages"), F.sum("records").alias("record_pairs"))
    keys = read(spark, sf_dir, "lineitem").agg(
        F.count_if(q >= 40).alias("valid_keys"), F.count_if((q >= 40) & (flag == "A")).alias("structural_keys"), F.count_if((q >= 40) & (flag == "N")).alias("fragment_keys"),
        F.count_if(q >= 45).alias("canonical_keys"), F.count_if((q >= 40) & (q < 45)).alias("noncanonical_keys"),
    )
    bases = p.groupBy("source").agg(F.min("status").alias("status")).agg(F.count("*").alias("anchors"), F.count_if(F.col("status") == 0).alias("structural_databases"), F.count_if(F.col("status") == 1).alias("fragment_databases"))
    # three single rows side by side
    return pages.join(F.broadcast(keys), F.lit(True)).join(F.broadcast(bases), F.lit(True))


@query("""
SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F' AND o_totalprice > 200000) AS structural, count(*) FILTER (o_orderstatus = 'O' AND o_totalprice > 200000) AS fragments,
    CASE WHEN count(*) FILTER (o_orderstatus = 'F' AND o_totalprice > 200000) > 0 THEN 'STRUCTURAL' WHEN count(*) FILTER (o_orderstatus = 'O' AND o_totalprice > 200000) > 0 THEN 'FRAGMENT' ELSE 'REJECTED' END AS status,
    CASE WHEN count(*) FILTER (o_orderstatus = 'F' AND o_totalprice > 200000) > 0 THEN '' WHEN count(*) FILTER (o_orderstatus = 'O' AND o_totalprice > 200000) > 0 THEN 'partial_evidence' ELSE 'no_confirmed_evidence' END AS reasons FROM orders GROUP BY o_custkey""")
def overall_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural evidence before fragments before none, for each customer's orders."""
    big = F.col("o_totalprice") > 200000
    g = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_if(big & (F.col("o_orderstatus") == "F")).alias("structural"), F.count_if(big & (F.col("o_orderstatus") == "O")).alias("fragments"))
    g = g.withColumn("status", correlation.overall(F.col("structural"), F.col("fragments")))
    return g.withColumn("reasons", F.when(F.col("status") == "STRUCTURAL", "").when(F.col("status") == "FRAGMENT", "partial_evidence").otherwise("no_confirmed_evidence"))


@query(f"""
WITH m AS ({ORACLES["fingerprint_compare_all"]}), a AS ({ORACLES["customer_allocation"]}),
d AS (SELECT l_orderkey, l_linenumber, l_partkey, min(class) AS relation FROM m GROUP BY ALL),
x AS (SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_quantity > 45 AS owner, l.l_tax > 0.06 AS stale, relation, CASE WHEN l.l_discount = 0 THEN 'UNKNOWN' ELSE coalesce(a.state, 'UNKNOWN') END AS allocation
      FROM lineitem l JOIN orders o ON o_orderkey = l_orderkey JOIN d ON d.l_orderkey = l.l_orderkey AND d.l_linenumber = l.l_linenumber AND d.l_partkey = l.l_partkey LEFT JOIN a ON a.c_custkey = o_custkey),
y AS (SELECT *, CASE WHEN owner THEN ['ALLOCATED_OTHER_FILE', 'HIGH'] WHEN relation = 'BYTE_IDENTICAL' AND allocation IN ('UNALLOCATED', 'MIXED') THEN ['LIKELY_ACTIVE_WALLET_OLD_COPY', 'HIGH'] WHEN stale THEN ['POSSIBLE_HISTORICAL_WALLET', 'HIGH']
      WHEN allocation = 'UNALLOCATED' THEN ['POSSIBLE_HISTORICAL_WALLET', 'MEDIUM'] WHEN allocation = 'UNKNOWN' THEN ['UNRESOLVED', 'LOW'] ELSE ['DISTINCT_UNKNOWN_WALLET', 'MEDIUM'] END AS t FROM x)
SELECT t[1] AS class, t[2] AS confidence, relation, allocation, count(*) AS finds FROM y GROUP BY ALL""")
def triage_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as finds: what they are, from who owns their place, what they are like, and whether their clusters are in use."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    d = fingerprint_compare_all(spark, sf_dir).groupBy(*keys).agg(F.min("class").alias("relation"))
    l = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")), "l_orderkey").join(d, keys)
    l = l.join(customer_allocation(spark, sf_dir).select("c_custkey", "state"), "c_custkey", "left")
    l = l.withColumn("allocation", F.when(F.col("l_discount") == 0, "UNKNOWN").otherwise(F.coalesce("state", F.lit("UNKNOWN"))))
    t = correlation.triage(F.col("l_quantity") > 45, F.col("l_tax") > 0.06, F.col("relation"), F.col("allocation"))
    return l.withColumn("t", t).groupBy("t.class", "t.confidence", "relation", "allocation").agg(F.count("*").alias("finds"))


@query("""
WITH n AS (SELECT count(*) * 9 // 10 AS records FROM part), c AS (SELECT p_partkey AS number, p_size % 5 AS sequence FROM part WHERE p_size % 7 <> 0)
SELECT l_orderkey, l_linenumber, l_partkey AS number, CASE WHEN l_partkey >= records THEN 'record_number_out_of_range' WHEN c.number IS NULL THEN 'current_record_missing'
    WHEN c.sequence = l_suppkey % 5 THEN 'current_reference_matches' ELSE 'current_record_reused_sequence_differs' END AS state FROM lineitem CROSS JOIN n LEFT JOIN c ON c.number = l_partkey""")
def reference_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the part that a line names, with a sequence, is now."""
    part = read(spark, sf_dir, "part")
    records = part.agg(F.floor(F.count("*") * 9 / 10).alias("records"))  # one row
    current = part.where("p_size % 7 <> 0").select(F.col("p_partkey").alias("number"), (F.col("p_size") % 5).alias("current"))
    l = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("number"), (F.col("l_suppkey") % 5).alias("sequence"))
    l = l.join(current, "number", "left").join(F.broadcast(records), F.lit(True))
    return l.select("l_orderkey", "l_linenumber", "number", correlation.reference_state(F.col("records"), F.col("number"), F.col("sequence"), F.col("current")).alias("state"))


@query("""
WITH e AS (SELECT *, event_id % 40 AS ref, lower(event_type) AS name, user_id % 6 AS parent, epoch_us(ts) // 1000 AS t FROM events),
k AS (SELECT DISTINCT ref FROM e WHERE event_type = 'signup'),
g AS (SELECT ref, name, parent, min(t) AS first_seen, max(t) AS last_seen, count(*) AS events, bool_or(event_type = 'error') AS deleted FROM e GROUP BY ALL)
SELECT g.*, CASE WHEN u.s_suppkey IS NOT NULL THEN 'ACTIVE_CURRENT' WHEN deleted THEN 'DELETED' WHEN k.ref IS NOT NULL THEN 'HISTORICAL' ELSE 'UNKNOWN_REFERENCE' END AS state
FROM g LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000) u ON u.s_suppkey = g.ref LEFT JOIN k ON k.ref = g.parent""")
def reference_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes by reference, name and parent: first and last seen, and the state; what is active now comes before deletion, and that before a known parent."""
    e = read(spark, sf_dir, "events").select((F.col("event_id") % 40).alias("ref"), F.lower("event_type").alias("name"), (F.col("user_id") % 6).alias("parent"), millis("ts").alias("t"), "event_type")
    known = e.where("event_type = 'signup'").select(F.col("ref").alias("parent")).distinct().withColumn("known", F.lit(True))
    active = read(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("ref")).distinct().withColumn("active", F.lit(True))
    g = e.groupBy("ref", "name", "parent").agg(F.min("t").alias("first_seen"), F.max("t").alias("last_seen"), F.count("*").alias("events"), F.bool_or(F.col("event_type") == "error").alias("deleted"))
    state = F.when(F.col("active"), "ACTIVE_CURRENT").when(F.col("deleted"), "DELETED").when(F.col("known"), "HISTORICAL").otherwise("UNKNOWN_REFERENCE")
    return g.join(active, "ref", "left").join(known, "parent", "left").withColumn("state", state).drop("active", "known")


@query("""
WITH s AS (SELECT c_nationkey, c_custkey, lower(c_mktsegment) AS family FROM customer), g AS (SELECT c_nationkey, family, count(*) AS n FROM s GROUP BY ALL), t AS (SELECT c_nationkey, sum(n)::BIGINT AS total FROM g GROUP BY c_nationkey)
SELECT c_custkey, total - 1 AS siblings, n - 1 AS of_family FROM s JOIN g USING (c_nationkey, family) JOIN t USING (c_nationkey)""")
def sibling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Siblings under the same parent, and those of the same family, from counts: no pair is formed."""
    s = read(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.lower("c_mktsegment").alias("family"))
    g = s.groupBy("c_nationkey", "family").agg(F.count("*").alias("n"))
    t = g.groupBy("c_nationkey").agg(F.sum("n").alias("total"))
    return s.join(g, ["c_nationkey", "family"]).join(t, "c_nationkey").select("c_custkey", (F.col("total") - 1).alias("siblings"), (F.col("n") - 1).alias("of_family"))


@query("""
WITH l AS (SELECT lower(event_type) AS family, user_id % 50 AS volume, count(*) AS entries, min(event_id) AS first_entry FROM events GROUP BY ALL),
m AS (SELECT DISTINCT lower(c_mktsegment) AS name, c_custkey % 50 AS volume FROM customer), u AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'view' WHEN 'O' THEN 'click' ELSE 'error' END AS family, o_custkey % 50 AS volume, count(*) AS changes FROM orders GROUP BY ALL)
SELECT l.family, l.volume, entries, first_entry, coalesce(changes, 0) AS changes, array_to_string(list_filter([CASE WHEN changes IS NOT NULL THEN 'USN' END, CASE WHEN m.volume IS NOT NULL THEN 'MFT' END, 'LOG'], lambda x: x IS NOT NULL), ',') AS sources
FROM l LEFT JOIN u USING (family, volume) LEFT JOIN (SELECT volume, count(*) AS n FROM m WHERE name = 'building' GROUP BY volume) m ON m.volume = l.volume""")
def log_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log entries by family and volume, with what the change journal and the records say of the same."""
    l = read(spark, sf_dir, "events").groupBy(F.lower("event_type").alias("family"), (F.col("user_id") % 50).alias("volume")).agg(F.count("*").alias("entries"), F.min("event_id").alias("first_entry"))
    family = F.when(F.col("o_orderstatus") == "F", "view").when(F.col("o_orderstatus") == "O", "click").otherwise("error")
    u = read(spark, sf_dir, "orders").groupBy(family.alias("family"), (F.col("o_custkey") % 50).alias("volume")).agg(F.count("*").alias("n"))
    m = read(spark, sf_dir, "customer").where(F.lower("c_mktsegment") == "building").select((F.col("c_custkey") % 50).alias("volume")).distinct().withColumn("record", F.lit(True))
    sources = F.array_compact(F.array(F.when(F.col("n").isNotNull(), "USN"), F.when(F.col("record"), "MFT"), F.lit("LOG")))
    return l.join(u, ["family", "volume"], "left").join(m, "volume", "left").select("family", "volume", "entries", "first_entry", F.coalesce("n", F.lit(0)).alias("changes"), F.array_join(sources, ",").alias("sources"))
