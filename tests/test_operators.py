import random

import pytest
from pyspark.sql import functions as F

from siftwell.operators import correlation, findings, graph, intervals, text


def spans(seed, n=120, lines=3):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        a = r.randrange(0, 2000)
        rows.append((r.randrange(lines), a, a + r.choice([0, 1, 5, 40, 300])))
    return rows


def naive_islands(rows, gap, mode):
    out = []
    for line in sorted({r[0] for r in rows}):
        island, last, top = 0, None, None
        for _, a, b in sorted(r for r in rows if r[0] == line):
            if last is not None and (a - last > gap if mode == "start" else a - top > gap if mode == "end" else a >= top):
                island += 1
            out.append((line, a, b, island))
            last, top = a, b if top is None else max(top, b)
    return sorted(out)


@pytest.mark.parametrize("mode", ["start", "end", "component"])
@pytest.mark.parametrize("width", [7, 64, 1 << 30])
def test_islands(spark, mode, width):
    rows = list(set(spans(hash(mode) % 100)))
    df = spark.createDataFrame(rows, "line long, start long, end long")
    for gap in (0, 10, 50):
        got = intervals.islands(df, ["line"], gap, mode, width).select("line", "start", "end", "island").collect()
        assert sorted(map(tuple, got)) == naive_islands(rows, gap, mode)


def test_gap_at_the_limit_joins_and_one_more_splits(spark):
    df = spark.createDataFrame([("a", 0, 1), ("a", 10, 11), ("a", 21, 22)], "line string, start long, end long")
    got = {r.start: r.island for r in intervals.islands(df, ["line"], 10, "start", 4).collect()}
    assert got == {0: 0, 10: 0, 21: 1}


def test_overlapping_and_contained(spark):
    a, b = list(set(spans(1, 60))), list(set(spans(2, 60)))
    fa, fb = (spark.createDataFrame(x, "line long, start long, end long") for x in (a, b))
    got = intervals.overlapping(fa, fb, ["line"], 50, F.lit(True)).select("a.line", "a.start", "a.end", "b.start", "b.end", intervals.relation()).collect()
    want = [(x[0], x[1], x[2], y[1], y[2], 0 if x == y else 1 if y[1] <= x[1] and x[2] <= y[2] else 2) for x in a for y in b if x[0] == y[0] and x[1] < y[2] and y[1] < x[2]]
    assert sorted(map(tuple, got)) == sorted(want)
    semi = intervals.contained(fa, fb, ["line"], 50, "left_semi").select("line", "start", "end").collect()
    inside = [x for x in a if any(x[0] == y[0] and y[1] <= x[1] and x[2] <= y[2] for y in b)]
    assert sorted(map(tuple, semi)) == sorted(inside)
    anti = intervals.contained(fa, fb, ["line"], 50, "left_anti").select("line", "start", "end").collect()
    assert sorted(map(tuple, anti)) == sorted(set(a) - set(inside))


def test_merged(spark):
    rows = list(set(spans(5, 100, 2)))
    got = intervals.merged(spark.createDataFrame(rows, "line long, start long, end long"), ["line"], 200, 64).collect()
    want = []
    for line in (0, 1):
        at = None
        for _, a, b in sorted(r for r in rows if r[0] == line):
            if at and a <= at[1] and max(at[1], b) - at[0] <= 200:
                at = [at[0], max(at[1], b), at[2] + 1]
                want[-1] = (line, *at)
            else:
                at = [a, b, 1]
                want.append((line, *at))
    assert sorted(map(tuple, got)) == sorted(want)


def test_coverage(spark):
    df = spark.createDataFrame([("a", 0, 5), ("a", 5, 9), ("b", 0, 5), ("b", 6, 9), ("c", 0, 5), ("c", 4, 9)], "line string, start long, end long")
    got = {r.line: (r.gaps, r.overlaps, r.complete) for r in intervals.coverage(df, ["line"], F.lit(0), F.lit(9), 3).collect()}
    assert got == {"a": (0, 0, True), "b": (1, 0, False), "c": (0, 1, False)}


def test_unknown_status_word_fails(spark):
    df = spark.createDataFrame([("NEW",)], "s string").select(findings.checked(F.col("s"), findings.STRUCTURAL_WORDS))
    with pytest.raises(Exception, match="unknown status"):
        df.collect()


def test_policy_reasons_keep_their_order(spark):
    df = spark.range(1).select(findings.reasons(F.lit(1), F.lit(1), F.lit(0), F.lit(True), F.lit(1), F.lit(False), F.lit(9), 2, 2, 5).alias("r"))
    assert df.first().r == ["insufficient_hits", "insufficient_distinct_types", "weak_evidence_requires_independent_corroboration", "missing_required_group", "signal_span_too_large"]
    strong = spark.range(1).select(findings.reasons(F.lit(1), F.lit(1), F.lit(2), F.lit(True), F.lit(1), F.lit(True), F.lit(0), 2, 2).alias("r"))
    assert strong.first().r == []


def test_ancestors(spark):
    rows = [("a", None, "A", False), ("b", "a", "B", False), ("c", "b", "C", True), ("x", "y", "X", True), ("y", "x", "Y", False), ("q", "gone", "Q", True)]
    got = {r.node: ("/".join(r.path), r.state) for r in graph.ancestors(spark.createDataFrame(rows, "node string, parent string, name string, wanted boolean")).collect()}
    assert got == {"c": ("A/B/C", "complete"), "x": ("Y/X", "cycle"), "q": ("Q", "missing")}


def test_tree_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 3)], "parent long, child long")
    got = graph.tree(edges, spark.createDataFrame([(7, 1)], "tree long, page long")).collect()
    assert sorted((r.page, r.level, r.parents) for r in got) == [(1, 0, 1), (2, 1, 1), (3, 1, 2)]


def test_links(spark):
    rows = [("l", 1, 2, 0), ("l", 2, 3, 1), ("l", 3, 0, 9), ("l", 4, 8, 0), ("l", 5, 5, 5), ("l", 5, 6, 4)]
    got = {r.page: r.link for r in graph.reciprocal_links(spark.createDataFrame(rows, "line string, page long, next long, prev long"), ["line"]).collect()}
    assert got == {1: "confirmed", 2: "mismatch", 3: "end", 4: "missing"}


def test_signatures_overlap_and_count_bytes(spark):
    rows = [(1, "aaa"), (2, "éaa€aa"), (3, None), (4, ""), (5, "x.*y"), (6, "aXa")]
    got = text.signatures(spark.createDataFrame(rows, "k long, t string"), "k", "t", [("aa", "aa"), ("dot", ".*")]).collect()
    assert sorted(map(tuple, got)) == [(1, "aa", 0, 2), (1, "aa", 1, 3), (2, "aa", 2, 4), (2, "aa", 7, 9), (5, "dot", 1, 3)]


def test_null_lines_stay(spark):
    df = spark.createDataFrame([(None, 0, 5), (None, 3, 9), ("a", 0, 1)], "line string, start long, end long")
    got = intervals.islands(df, ["line"], 1, "start", 4).select("line", "start", "island").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(None, 0, 0), (None, 3, 1), ("a", 0, 0)]))
    got = {r.line: (r.units, r.overlaps) for r in intervals.coverage(df, ["line"], F.lit(0), F.lit(9), 4).collect()}
    assert got == {None: (2, 1), "a": (1, 0)}


def test_bad_bounds_raise(spark):
    good = spark.createDataFrame([("a", 0, 5)], "line string, start long, end long")
    for a, b in ((5, 4), (-1, 3)):
        bad = spark.createDataFrame([("a", a, b)], "line string, start long, end long")
        with pytest.raises(Exception, match="bad interval"):
            intervals.overlapping(good, bad, ["line"], 4, F.lit(True)).collect()


def test_deep_paths_and_trees(spark):
    n = 30
    nodes = [(i, i - 1 if i else None, str(i), i == n) for i in range(n + 1)]
    frame = spark.createDataFrame(nodes, "node long, parent long, name string, wanted boolean")
    assert [(r.hops, r.state) for r in graph.ancestors(frame).collect()] == [(n, "complete")]
    assert [(r.hops, r.state) for r in graph.ancestors(frame, 3).collect()] == [(3, "too_deep")]
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)], "parent long, child long")
    assert graph.tree(edges, spark.createDataFrame([(1, 0)], "tree long, page long")).count() == n + 1


STATES = [
    # structural, validation, kind, completeness, relevance -> discovery, structure, crypto, relevance
    (("STRUCTURAL", "UNVALIDATED", "x", "NONE", None), ("ACCEPTED", "FRAGMENT", "UNCHECKED", "INDEPENDENT")),
    (("COMPLETE", "CHECKSUM_VALID", "mnemonic", "NONE", None), ("ACCEPTED", "COMPLETE", "VALID", "INDEPENDENT")),
    (("RAW", "UNVALIDATED", "x", "NONE", None), ("RAW", "NONE", "NOT_APPLICABLE", "CONTEXT_REVIEW")),
    (("RAW", "UNVALIDATED", "mnemonic", "NONE", None), ("RAW", "NONE", "UNCHECKED", "CONTEXT_REVIEW")),
    (("FRAGMENT", "BIP39_CHECKSUM_INVALID", "mnemonic", "NONE", None), ("REJECTED", "FRAGMENT", "INVALID", "CONTEXT_REVIEW")),
    (("CONTEXT_ONLY", "CHECKSUM_VALID", "bitcoin_address", "COMPLETE", None), ("ACCEPTED", "NONE", "VALID", "CONTEXT_REVIEW")),
    (("NONE", "ELECTRUM_CONTAINER_STRUCTURAL_VALID", "x", "NONE", None), ("ACCEPTED", "COMPLETE", "UNCHECKED", "INDEPENDENT")),
    (("CANDIDATE", "UNVALIDATED", "x", "TRUNCATED", None), ("CANDIDATE", "FRAGMENT", "UNCHECKED", "CONTEXT_REVIEW")),
    (("COMPLETE", "BIP39_VALID", "mnemonic", "NONE", "LIKELY_WORDLIST_FALSE_POSITIVE"), ("ACCEPTED", "COMPLETE", "VALID", "LIKELY_FALSE_POSITIVE")),
]
STRENGTHS = [
    (("secrets", "NONE", "SECP256K1_VALID"), 3), (("bitcoin", "NONE", "SECP256K1_VALID"), 0), (("bitcoin", "REJECTED", "BIP39_VALID"), 3), (("bitcoin", "REJECTED", "BERKELEY_METADATA_STRUCTURAL_VALID"), 2),
    (("bitcoin", "STRUCTURAL", "CHECKSUM_INVALID"), 0), (("bitcoin", "STRUCTURAL", "UNVALIDATED"), 0), (("bitcoin", "STRONG", "FRAGMENT"), 2), (("bitcoin", "COMPLETE", "ELECTRUM_V1_COMPAT_VALID"), 2),
    (("bitcoin", "FRAGMENT", "UNVALIDATED"), 1), (("unknown", "RAW", "UNVALIDATED"), 1), (("bitcoin", "REJECTED", "UNVALIDATED"), 0), (("unknown", "RAW", "REJECTED"), 0),
]


def test_states_and_strengths(spark):
    rows = spark.createDataFrame([(*a, *b) for a, b in STATES], "s string, v string, k string, c string, r string, d string, t string, y string, l string")
    got = rows.select(findings.state(F.col("s"), F.col("v"), F.col("k"), F.col("c"), F.col("r")).alias("x"), F.struct("d", "t", "y", "l").alias("want")).collect()
    assert [tuple(r.x) for r in got] == [tuple(r.want) for r in got]
    rows = spark.createDataFrame([(*a, b) for a, b in STRENGTHS], "t string, s string, v string, want int")
    got = rows.select(findings.strength(F.col("t"), F.col("s"), F.col("v")).alias("x"), "want").collect()
    assert [r.x for r in got] == [r.want for r in got]


def test_admission(spark):
    rows = [("a", 0, 1, "x", "t", 0), ("a", 5, 6, "y", "t", 0), ("a", 100, 101, "x", "t", 0), ("a", 101, 102, "z", "t", 1), ("a", 500, 501, "u", "unknown", 0)]
    hits = spark.createDataFrame(rows, "line string, start long, end long, signature string, target string, rank int")
    # a strong hit beside a weak one doesn't back it
    assert sorted(r.start for r in findings.admitted(hits, ["line"], 10, 64).collect()) == [0, 5, 101, 500]


def test_policy_counts_pairs_within_one_known_target(spark):
    schema = "c long, start long, hit_type string, target string, kind string, strength int"
    hit = lambda c, types, targets=None, kinds=None, strengths=None, starts=None: [
        (c, (starts or range(0, 10 * len(types), 10))[i], t, (targets or ["unknown"] * 9)[i], (kinds or ["k"] * 9)[i], (strengths or [0] * 9)[i]) for i, t in enumerate(types)
    ]
    rows = (
        hit(1, ["A", "B"]) + hit(2, ["A"]) + hit(3, ["N"] * 5) + hit(4, ["A", "B"], ["x", "y"]) + hit(5, ["A", "B"], ["x", "x"]) + hit(6, ["A"], ["x"], strengths=[2])
        + hit(7, ["A", "B", "B"], ["x", "unknown", "unknown"]) + hit(8, ["A", "A", "B"], ["x", "x", "y"], ["k", "l", "k"]) + hit(9, ["A", "B"], ["unknown", "unknown"], strengths=[2, 2]) + hit(10, ["A", "B"], starts=[0, 101])
    )
    df = spark.createDataFrame(rows, schema)
    got = {r.c: list(r.reasons) for r in findings.policy(df, ["c"], max_span=100).collect()}
    weak = "weak_evidence_requires_independent_corroboration"
    assert got == {1: [], 2: ["insufficient_hits", "insufficient_distinct_types"], 3: ["insufficient_distinct_types"], 4: [weak], 5: [], 6: [], 7: [weak], 8: [], 9: [], 10: ["signal_span_too_large"]}
    one = df.where("c = 1")
    assert findings.policy(one, ["c"], required=[{"A", "OTHER"}, {"B"}]).first().reasons == []
    assert findings.policy(one, ["c"], required=[{"A"}, {"OTHER"}]).first().reasons == ["missing_required_group"]
    for wrong in ({"min_hits": 0}, {"min_types": 0}, {"max_span": -1}, {"required": ["A"]}, {"required": [set()]}, {"required": [{""}]}):
        with pytest.raises(ValueError):
            findings.policy(one, ["c"], **wrong)


def test_cluster_ids_tell_repeated_members_apart(spark):
    rows = [(1, 0, 10, 12, "a"), (2, 0, 10, 12, "a"), (3, 5000, 9000, 24, "b"), (4, 5000, 9000, 24, "b"), (5, 20000, 20010, 12, "c")]
    found = spark.createDataFrame([(7, *r) for r in rows], "line long, id long, start long, end long, words long, fingerprint string")
    out = {r.id: r for r in correlation.correlate(found, "line", 100, 4096, 200).collect()}
    assert out[1].cluster == out[2].cluster != out[3].cluster == out[4].cluster and out[5].cluster is None
    assert out[1].cluster.startswith("mnemonic-cluster-") and out[1].cluster_size == 2
    plan = correlation.correlate(found, "line", 100, 4096, 200)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") + plan.count("Scan parquet") <= 6
