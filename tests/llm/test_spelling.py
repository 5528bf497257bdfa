import random
import re
import zlib
from collections import Counter

from siftwell.llm import spelling


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts, times=2):
    near = {w: [v for v in counts if v != w and one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        if best is not None and counts[best] >= times * counts[w]:
            form[w] = best
    out = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), counts.get(form.get(w))))
    return sorted(out)


def brute_vocabulary(docs):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def rows(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()))


def test_index_finds_all_that_share_a_half():
    r = random.Random(3)
    for n, letters, longest in ((300, "abé", 7), (30, "ab", 4), (1, "a", 3), (2, "ab", 2), (300, "abcdefgh", 5)):
        words = sorted({"".join(r.choice(letters) for _ in range(r.randint(1, longest))) for _ in range(n)})
        r.shuffle(words)
        asked, index = [*words, "zzzq", "abz"], spelling.Index(words)
        for scheme in (0, 1):
            got = [(asked[q], words[w]) for q, w in index.near(asked, scheme)]
            half = lambda q, w: w.startswith(q[: len(q) // 2]) if scheme == 0 else w.endswith(q[len(q) // 2 :])  # noqa: B023, E731
            assert sorted(got) == sorted((q, w) for q in asked for w in words if one_edit(q, w) and half(q, w))


def test_variants(spark, monkeypatch):
    r = random.Random(8)
    counts = {"".join(r.choice("abcé") for _ in range(r.randint(1, 8))): r.choice((3, 3, 5, 6, 12, 40, 100)) for _ in range(700)}
    counts |= {"hotkey" + "".join(r.choice("xyz") for _ in range(r.randint(1, 5))): r.choice((3, 9, 30)) for _ in range(300)}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    want = brute_variants(counts)
    assert rows(spelling.variants(df)) == want
    # beginnings and endings that need several shards
    monkeypatch.setattr(spelling, "FEW", 40)
    monkeypatch.setattr(spelling, "MANY", 40)
    assert rows(spelling.variants(df)) == want


def test_long_chains_and_long_words(spark):
    chain = {"a" * 5 + "b" * i: 3 * 2**i for i in range(12)}
    long = {"x" * 3000 + "y": 3, "x" * 3000 + "z": 30, "x" * 2999 + "y": 4}
    df = spark.createDataFrame([*chain.items(), *long.items()], "word string, n long")
    assert rows(spelling.variants(df)) == brute_variants(chain | long)
    assert rows(spelling.variants(df.limit(0))) == []
    assert rows(spelling.variants(df.limit(1))) == [("aaaaa", None, "aaaaa", 3, 0, None)]


def test_vocabulary(spark):
    r = random.Random(9)
    words = ["".join(r.choice("abÉé÷ß") for _ in range(r.randint(3, 9))) for _ in range(60)]
    docs = [(i, " ".join(w.upper() if r.random() < 0.3 and w.isascii() else w for w in r.choices(words, k=80)) + "-Ünder_score,x2yzabc") for i in range(40)]
    docs += [(None, None), (None, ""), (5, "12 34"), (None, "nulls nulls nulls"), (1, "repeated " * 20000)] + [(2, "twice again")] * 3
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute_vocabulary(docs)
    assert dict(map(tuple, spelling.vocabulary(df).collect())) == want
    assert rows(spelling.variants(spelling.vocabulary(df))) == brute_variants(want)
    assert spelling.vocabulary(df.limit(0)).collect() == []
