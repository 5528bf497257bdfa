import random
import re
from collections import Counter
from math import floor, log

import pytest

from siftwell.llm import licenses


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(texts, passages=licenses.PASSAGES, rare=6, agree=3):
    """Every passage at every place, and the words that stand there."""
    listed = [words(t) for t in texts]
    count = Counter(w for own in listed for w in set(own))
    weight = lambda w: 1 + floor(100 * log((len(texts) + 1) / (count[w] + 1)))
    out = []
    for own in listed:
        found = []
        for t, (label, text, phrases) in enumerate(passages):
            p = text.split()
            chosen = sorted(set(p), key=lambda w: (-weight(w), w))[:rare]
            keys = set()
            for phrase in (x.split() for x in phrases):
                at = next(i for i in range(len(p)) if p[i : i + len(phrase)] == phrase)
                keys |= set(range(at, at + len(phrase)))
            for s in range(-len(p), len(own)):
                there = [0 <= s + q < len(own) and own[s + q] == w for q, w in enumerate(p)]
                if all(there[q] for q in keys) and sum(there[p.index(w)] for w in chosen) >= min(agree, len(chosen)):
                    found.append((s, t, label, sum(weight(w) for w, y in zip(p, there, strict=True) if y) / sum(map(weight, p))))
        out.append((len(own), sorted(found)))
    return out


def got(df):
    return [(r.n_words, [tuple(p) for p in r.places]) for r in df.orderBy("doc_id").collect()]


def test_against_brute_force(spark):
    r = random.Random(2)
    pieces = [text for _, text, _ in licenses.PASSAGES]
    texts = [None, "", "Under the MIT License", "under THE mit licensé", "CC-BY_NC 4.0 cc by nc cc by cc by nc", "apache license, version 2", "apache license version 20"]
    for _ in range(60):
        p = r.choice(pieces).split()
        for _ in range(r.choice((0, 0, 1, 3))):  # words changed, lost or put in
            at = r.randrange(len(p))
            p[at : at + r.choice((0, 1))] = r.choice(([], ["other"], ["license"]))
        cut = p[r.choice((0, 0, 2)) :]
        texts.append(" ".join([*r.choices(("the", "license", "lorem", "version", "gnu"), k=r.randrange(6)), *cut, *r.choices(("by", "nc", "mit"), k=2)]).title() + r.choice((".", "", "\n")))
    texts.append("license gnu mit " * 4000 + pieces[4])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute(texts)
    assert got(licenses.scan(df)) == want
    assert sum(bool(found) for _, found in want) > 30


def test_clean_texts_have_no_labels(spark):
    texts = ["the license of the poet is public", "a permission granted free of charge", "we work under the apache helicopters version 2", "mit license under the", "nc by cc"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert all(places == [] for _, places in got(licenses.scan(df)))


def test_odd_tables(spark):
    rows = [(1, "under the mit license", "own", 5, "w")] * 3 + [(None, "cc by nc", "own", 5, "w"), (2, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, places string, words long, begins string")
    out = licenses.scan(df)
    assert out.columns == ["doc_id", "text", "words", "begins", "n_words", "places"]
    kept = sorted(out.select("doc_id", "text", "words", "begins", "n_words").collect(), key=str)
    assert [tuple(r) for r in kept] == sorted([(1, "under the mit license", 5, "w", 4)] * 3 + [(None, "cc by nc", 5, "w", 3), (2, None, None, None, 0)], key=str)
    assert licenses.scan(df.limit(0)).collect() == []


def test_phrase_must_be_in_its_passage(spark):
    with pytest.raises(ValueError, match="is not in the passage"):
        licenses.keyed([("x", "a b c", ("c d",))])
