import zlib

import numpy as np
import pytest

from siftwell.llm import toxicity

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def scored(spark):
    return toxicity.op10_toxicity(spark, SF).toPandas()


def test_held_out_accuracy(spark, scored):
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().groupby("doc_id", as_index=False).toxic.max()
    assert (scored.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in scored.doc_id]).all()
    assert scored.score.between(0, 1).all() and (scored.predicted == (scored.score >= 0.3)).all()
    held = scored[scored.held_out].merge(labels, on="doc_id")
    toxic, clean = held[held.toxic == 1], held[held.toxic == 0]
    # some 3,000 rows to learn from; with 15,000 it is 0.99 and 0
    assert toxic.predicted.mean() >= 0.8 and clean.predicted.mean() <= 0.01


def test_pairs():
    """Two inputs that only together make a text toxic are learned as a pair."""
    r = np.random.default_rng(0)
    rows = [np.flatnonzero(r.random(6) < 0.5) for _ in range(3000)]
    labels = np.array([float(0 in x and 1 in x) for x in rows])
    m = toxicity.train(rows, labels, np.arange(6, dtype=np.int32))
    y = [m.bias + m.weights[x].sum() + 0.5 * ((m.vectors[x].sum(0) ** 2).sum() - (m.vectors[x] ** 2).sum()) for x in rows]
    assert np.mean((np.array(y) > 0) == (labels > 0)) > 0.99
    exclusive = np.array([float((0 in x) != (1 in x)) for x in rows])
    m = toxicity.train(rows, exclusive, np.arange(6, dtype=np.int32))
    y = [m.bias + m.weights[x].sum() + 0.5 * ((m.vectors[x].sum(0) ** 2).sum() - (m.vectors[x] ** 2).sum()) for x in rows]
    assert np.mean((np.array(y) > 0) == (exclusive > 0)) > 0.99


def test_odd_rows(spark):
    rows = [(i, f"word{i % 7} " + ("nasty " if i % 3 == 0 else "nice ") * 2, "x") for i in range(400)]
    rows += [(None, "nasty", "x"), (1, None, "x"), (1, "", "x"), (3, rows[3][1], "x"), (1000, "nasty " * 50_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(None, 1), (5, None), (6, 1), (6, 1)], "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(out) == len(rows)
    assert all(r.predicted == int("nasty" in (r.text or "")) for r in out if r.text)
    nothing = toxicity.fit(docs, labels.limit(0))
    assert all(0 <= r.score < 0.3 for r in toxicity.score(docs, nothing).collect())
    assert toxicity.score(docs.limit(0), nothing).count() == 0


def test_pair_among_thousands_of_words(spark):
    """Only a pair of words tells the labels: each word alone is as frequent in toxic rows as in clean ones."""
    r = np.random.default_rng(3)
    words = ["".join(r.choice(list("bcdfghjklmnpqrstvwxz"), 3)) for _ in range(3000)]
    rows = []
    for i in range(8000):
        a, b = r.integers(2, size=2)
        rows.append((i, " ".join([*r.choice(words, 10), ("aab", "aac")[a], ("uub", "uuc")[b]]), int(a == b)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    machine = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    assert (machine.inputs >= 0).sum() > 2000
    out = toxicity.score(docs, machine).where(toxicity.held_out(docs["doc_id"])).toPandas()
    assert len(out) > 1000 and ((out.score >= 0.5) == (out.toxic == 1)).mean() > 0.85


def test_rare_insults(spark):
    """Many insults, each in a few rows only, beyond the number that a short list of inputs would hold."""
    r = np.random.default_rng(4)
    insults = ["u" + "".join(r.choice(list("bcdfghjklmnp"), 7)) for _ in range(800)]
    rows = [(i, " ".join([*(f"w{k}" for k in r.integers(500, size=8)), *([insults[i // 2 % 800]] if i % 2 else [])]), i % 2) for i in range(19200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    machine = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    held = toxicity.score(docs, machine).where(toxicity.held_out(docs["doc_id"])).toPandas()
    assert ((held.score >= 0.5) == (held.toxic == 1)).mean() > 0.9
