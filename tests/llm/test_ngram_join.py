import random

import numpy as np

from siftwell.llm import ngram_join


def shingles(text, k):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    at = list(range(len(rows)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                at[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(d, low.get(root(i), d))
    return sorted(((d, len(s), low.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def check(spark, rows, k=4, percent=85):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in ngram_join.join(docs, k, percent).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(got, key=str) == brute(rows, k, percent)


def corpus(seed, n):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    passage = [r.choice(words) for _ in range(60)]
    rows, texts = [], []
    for i in range(n):
        kind = r.random()
        if texts and kind < 0.5:
            t = list(r.choice(texts[-40:]))
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                t[r.randrange(len(t))] = r.choice(words)
        elif kind < 0.6:
            t = passage + [r.choice(words) for _ in range(r.randrange(12))]
        else:
            t = [r.choice(words) for _ in range(r.choice([1, 2, 3, 4, 7, 30, 60, 120]))]
        texts.append(t)
        rows.append((i, r.choice([" ", "\n", "  ", "\t"]).join(t)))
    return rows


def test_random(spark):
    check(spark, corpus(1, 250))
    check(spark, corpus(2, 150), 5, 80)


def test_without_likely_partners(spark, monkeypatch):
    """The prefix search alone finds every link, with and without frequent tokens put last."""
    monkeypatch.setattr(ngram_join, "FREQUENT_FROM", 3)
    monkeypatch.setattr(ngram_join, "KEYS", 1)
    monkeypatch.setattr(ngram_join, "GROUP", 2)
    monkeypatch.setattr(ngram_join, "QUERIES", 3)
    check(spark, corpus(3, 200))
    check(spark, corpus(5, 150), 5, 80)


def test_prefixes_of_similar_sets_meet():
    """Of similar sets the prefixes share as many tokens as the smaller of their numbers says, whatever is frequent."""
    r = random.Random(9)
    for _ in range(300):
        pool = np.array([r.getrandbits(64) for _ in range(r.randrange(2, 200))], np.uint64)
        frequent = np.unique(pool[[r.random() < 0.6 for _ in pool]])
        order = ngram_join.Order(frequent, np.array([r.randrange(16, 5000) for _ in frequent], np.int64))
        x = np.unique(pool)
        y = np.unique(np.concatenate([x[[r.random() < 0.95 for _ in x]], np.array([r.getrandbits(64) for _ in range(len(x) // 20)], np.uint64)]))
        common = len(np.intersect1d(x, y))
        if common and 100 * common >= 80 * (len(x) + len(y) - common):
            (a, s), (b, t) = order.prefix(x, 80), order.prefix(y, 80)
            assert len(np.intersect1d(a, b)) >= min(s, t) >= 1
            limit = ngram_join.matrix_limit(80)
            assert len(np.setdiff1d(x[x < limit], y)) <= len(x) - ngram_join.least(len(x), 80)


def test_tokens():
    import pyarrow as pa

    texts = ["a b c d e", " A  b\tC d ", "a b", "", None, "\x0b\x0c", "é É x y z\x1c", "a b a b a b"]
    sets = ngram_join.tokens(pa.array(texts), 3)
    want = [shingles(t, 3) for t in texts]
    assert [len(x) for x in sets] == [len(x) for x in want]
    for i in range(len(texts)):
        for j in range(i):
            assert len(np.intersect1d(sets[i], sets[j])) == len(want[i] & want[j])


def test_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(30000))
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "A B C D E F"), (3, "A B C D E F"), (4, None), (4, ""), (5, " \n"), (None, None), (6, "a b"), (7, "A\tB"), (8, "É b"), (9, "é b"), (10, long), (11, long + " y"), (None, "solo text of null id")]
    check(spark, rows)
    check(spark, [])


def test_other_columns(spark):
    rows = [(1, "a b c d e", "x", 7), (2, "a b c d e", "y", 8), (2, "a b c d e", "y", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string, rid int")
    out = ngram_join.join(docs)
    assert out.columns == ["doc_id", "text", "rid", "n_shingles", "component_id"]
    assert sorted(map(tuple, out.collect())) == [(1, "a b c d e", 7, 2, 1), (2, "a b c d e", 8, 2, 1), (2, "a b c d e", 8, 2, 1)]
    assert ngram_join.join(docs.select("doc_id", "text")).columns == ["doc_id", "text", "n_shingles", "component_id"]


def test_one_large_group_of_near_copies(spark):
    """Copies that share no min-hash key with their original still join its component, and few of them ask other groups."""
    r = random.Random(21)
    base = [f"o{i}" for i in range(120)]
    rows = []
    for i in range(400):
        t = list(base)
        for _ in range(r.randrange(5)):
            t[r.randrange(len(t))] = f"c{r.randrange(50)}"
        rows.append((i, " ".join(t)))
    check(spark, rows)
