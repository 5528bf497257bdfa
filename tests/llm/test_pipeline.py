import math
from collections import Counter, defaultdict

from siftwell.llm import toxicity
from siftwell.llm.common import materialize

import corpus_pipeline

from .test_line_dedup import brute as brute_lines
from .test_ngram_join import brute as brute_join


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    columns = docs.columns
    want = docs.collect()
    machine = toxicity.fit(docs, labels)
    for name, stage in corpus_pipeline.STAGES:
        before = want
        out = materialize(stage(spark, docs, sf), "stage")
        got = out.collect()
        if name == "toxicity":
            want = [r for r in before if machine.score(r.text) < toxicity.THRESHOLD]
        elif name == "line dedup":
            texts = dict(brute_lines([(r.doc_id, r.text) for r in before], 2, 20))
            want = [docs_row(r, texts[r.doc_id]) for r in before if texts[r.doc_id] == r.text or texts[r.doc_id].strip()]
        elif name == "n-gram Jaccard join":
            first = {d: c for d, n, c in brute_join([(r.doc_id, r.text) for r in before], 5, 80) if n}
            want = [r for r in before if first.get(r.doc_id, r.doc_id) == r.doc_id]
        elif name.startswith("mixing"):
            size, copies = defaultdict(int), Counter(r.doc_id for r in got)
            taken = defaultdict(int)
            for r in before:
                n = len([w for w in r.text.split() if w])
                size[r.source] += n
                taken[r.source] += n * copies[r.doc_id]
            target = targets(size)
            for s in size:
                most = max(len(r.text.split()) for r in before if r.source == s)
                assert abs(taken[s] - target[s]) <= 2 * most + 0.1 * target[s], s
            assert set(copies.values()) <= {1, 2}
            kept = {r.doc_id: r for r in before}
            assert all(kept[r.doc_id] == r for r in got)
            want = got
        else:
            assert Counter(r.doc_id for r in got if r.piece == 0) == Counter(r.doc_id for r in before)
            used = defaultdict(int)
            for r in got:
                used[r.sequence_id] += r.length
                assert len(r.ids) == r.length
            assert max(used.values()) <= 1024 and len(used) <= 1.05 * math.ceil(sum(used.values()) / 1024) + 1
            return
        assert sorted(map(key, got)) == sorted(map(key, want)), name
        assert out.columns == columns
        docs = out


def test_stages_on_odd_rows(spark, sf):
    """Nulls, empty and very long texts, repeated rows, an empty table and columns named like those that operators add."""
    line = "a line of some length that more than one of the documents has, more or less"
    rows = [(1, line, "s"), (1, line, "s"), (2, None, None), (None, line + "!", "s"), (3, "", "t"), (4, "w " * 200_000, "t"), (None, None, None), (5, " \n", "s"), (6, "one two three four five six seven", "t"), (7, "one two three four five six seven", None)]
    extra = "size int, score string, predicted int, n_removed int, n_lines int, component_id string, n_shingles int, target int, copies int, source_size int, lang string, piece int, _rest int, rid int, t1 int"
    names = ["doc_id", "text", "source", *(x.split()[0] for x in extra.split(", "))]
    docs = spark.createDataFrame([(*r, *(("x" if x.endswith("string") else 9) for x in extra.split(", "))) for r in rows], "doc_id long, text string, source string, " + extra)
    kept = {"toxicity": None, "line dedup": None, "n-gram Jaccard join": None}
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, sf), "odd")
        got = out.collect()
        again = stage(spark, docs.repartition(3), sf).collect()
        assert stage(spark, docs.limit(0), sf).count() == 0
        if name.startswith("best-fit"):
            same = [Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in x) for x in (got, again)]
            assert same[0] == same[1] and len({(r.doc_id, r.ids_crc32) for r in got if r.piece == 0}) == len({(r.doc_id, r.text or "") for r in docs.collect()})
            break
        assert out.columns == names and Counter(map(repr, got)) == Counter(map(repr, again)), name
        assert all(r.size == 9 and r.score == "x" and r.component_id == "x" and r._rest == 9 for r in got)
        if name == "line dedup":
            assert sorted((str(r.doc_id), r.text) for r in got if r.text and line in r.text) == [("None", line + "!")]
        if name == "n-gram Jaccard join":
            assert [r.doc_id for r in got if r.text and r.text.startswith("one")] == [6]
        docs = out


def key(r):
    return (r.doc_id, r.text, r.lang, r.source, r.n_chars)


def docs_row(r, text):
    return type(r)(**(r.asDict() | {"text": text}))


def targets(size):
    names = sorted(size)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(size.values()), set(names), {}
    while True:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if share * weight[s] > 2 * size[s]}
        if not over:
            return out | {s: share * weight[s] for s in open_}
        out |= {s: 2 * size[s] for s in over}
        left -= sum(2 * size[s] for s in over)
        open_ -= over
