"""Columns of any name pass through every operator; limits of what is broadcast change nothing."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.llm import licenses, line_dedup, mixing, ngram_join, packing, pii, toxicity, url_filter

NAMES = ["_text", "f_email", "_slot", "_skey", "_band", "_rank", "_before", "_t1", "_t2", "gone", "rid", "node", "block", "word", "_verdict", "words", "hits", "_at", "k1", "line_no", "_rest", "n", "text_key"]


def table(spark, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return df.select("*", *(F.lit(f"own {n}").alias(n) for n in NAMES))


def kept(out, n):
    rows = out.select(*NAMES).collect()
    assert len(rows) == n and all(r[c] == f"own {c}" for r in rows for c in NAMES)


DOCS = [(1, "mail me at a@b.org\nsame line that is long enough\nsame line that is long enough", "x"), (2, "under the mit license", "y"), (2, "under the mit license", "y"), (None, None, None), (3, "", "x")]


def test_other_columns_pass_through(spark):
    docs = table(spark, DOCS, "doc_id long, text string, source string")
    machine = toxicity.fit(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"))
    results = {
        "spans": pii.spans(docs), "copies": mixing.mix(docs), "n_removed": line_dedup.dedup(docs), "component_id": ngram_join.join(docs), "predicted": toxicity.score(docs, machine), "places": licenses.scan(docs),
    }
    for added, out in results.items():
        assert added in out.columns and set(docs.columns) <= set(out.columns)
        kept(out, len(DOCS))
        if added != "n_removed":
            assert Counter(r.text for r in out.collect()) == Counter(t for _, t, _ in DOCS)


def test_pages_and_pieces(spark):
    pages = table(spark, [(1, "http://a.spam-farm.org/x"), (2, None), (3, "http://e.net/" + "x" * 100_000)], "page_id long, url string")
    out = url_filter.judge(pages, url_filter.listed_urls(pages))
    kept(out, 3)
    assert sorted((r.page_id, r.verdict) for r in out.collect()) == [(1, "block"), (2, "allow"), (3, "block")]
    assert url_filter.judge(pages.limit(0), url_filter.listed_urls(pages)).collect() == []
    pieces = table(spark, [(i, 0, 10 + i, 7) for i in range(9)], "doc_id long, piece int, length long, ids_crc32 long")
    kept(packing.place(pieces), 9)


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, source string").limit(0)
    assert pii.spans(docs).collect() == [] and licenses.scan(docs).collect() == []
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, labels)).collect() == []


def test_filter_by_shuffle_gives_the_same(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"http://{'a.spam-farm' if i % 3 else 'b'}.org/p{i % 50}") for i in range(300)] + [(900, None)], "page_id long, url string")
    want = sorted(map(tuple, url_filter.judge(pages, url_filter.listed_urls(pages)).collect()), key=str)
    monkeypatch.setattr(url_filter, "BROADCAST_WORDS", 0)
    assert sorted(map(tuple, url_filter.judge(pages, url_filter.listed_urls(pages)).collect()), key=str) == want


def test_texts_by_shuffle_link_the_same(spark, monkeypatch):
    rows = [(i, " ".join(f"w{j}" for j in range(i % 4, 60 + i % 7))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted((r.doc_id, r.component_id) for r in ngram_join.join(docs).collect())
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 0)
    assert sorted((r.doc_id, r.component_id) for r in ngram_join.join(docs).collect()) == want


def test_scores_are_those_of_the_formula(spark):
    """The score from terms, buckets, weights and all pairs of vectors, one by one."""
    docs = spark.createDataFrame([(i, f"{'vile' if i % 2 else 'kind'} people number {i % 7} and words {i % 3}") for i in range(80)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    m = toxicity.fit(docs, labels)
    for text in ("vile people and more", "kind words", "", "nothing known here", "vile vile VILE people number 3"):
        words = set(re.findall(r"[^\W_]+", text.lower()))
        found = words | {f"{n}^{w[:n]}" for w in words for n in toxicity.PREFIXES if len(w) > n}
        own = sorted({int(m.inputs[b]) for b in {zlib.crc32(t.encode()) % toxicity.BUCKETS for t in found} if m.inputs[b] >= 0})
        y = float(m.bias) + sum(float(m.weights[i]) for i in own)
        y += sum(float(np.dot(m.vectors[a].astype(float), m.vectors[b].astype(float))) for k, a in enumerate(own) for b in own[k + 1 :])
        got = toxicity.score(spark.createDataFrame([(text,)], "text string"), m).first()
        assert got.score == pytest.approx(1 / (1 + math.exp(-y)), abs=1e-5) and got.predicted == int(got.score >= 0.3)
