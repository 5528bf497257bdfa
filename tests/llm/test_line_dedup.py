import random

from siftwell.llm import line_dedup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def near(a, b, edits, per_edit):
    most = min(edits, min(len(a), len(b)) // per_edit)
    return a == b or most > 0 and abs(len(a) - len(b)) <= most and distance(a, b) <= most


def brute(rows, edits, per_edit):
    lines = [(d, i, x.strip(" \t\r")) for d, t in rows if t is not None for i, x in enumerate(t.split("\n"))]
    lines = sorted(x for x in set(lines) if x[2])
    at = list(range(len(lines)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i, (_, _, a) in enumerate(lines):
        for j in range(i):
            if near(a, lines[j][2], edits, per_edit):
                x, y = root(i), root(j)
                at[max(x, y)] = min(x, y)
    gone = {lines[i][:2] for i in range(len(lines)) if root(i) != i}
    return sorted((d, t if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone)) for d, t in rows)


def test_distance():
    r = random.Random(3)
    for _ in range(4000):
        a = "".join(r.choice("abc") for _ in range(r.randrange(12)))
        b = list(a)
        for _ in range(r.randrange(5)):
            i = r.randrange(len(b) + 1)
            b[i : i + r.randrange(2)] = r.choice(["", "a", "b", "ca"])
        b = "".join(b)
        for k in range(4):
            assert line_dedup.within(a, b, k) == (distance(a, b) <= k), (a, b, k)


def test_near_lines_share_a_key():
    """Each kind of key brings every near pair together, one of the two as an entry; the same content has the same key."""
    r = random.Random(8)
    for find, per_edit in ((line_dedup.probes, 4), (line_dedup.fine_probes, 6)):
        for _ in range(1500):
            edits = r.choice([1, 2, 3]) if find is line_dedup.probes else r.choice([1, 2])
            a = "".join(r.choice("abé") for _ in range(r.randrange(4, 30)))
            b = list(a)
            for _ in range(r.randrange(edits + 1)):
                i = r.randrange(len(b) + 1)
                b[i : i + r.randrange(2)] = r.choice(["", "a", "b", "é"])
            b = "".join(b)
            if a != b and near(a, b, edits, per_edit):
                key, of, entry = line_dedup.Probes(lambda n: find(n, edits, per_edit)).keys([a, b])
                keys = [{(k, e) for k, o, e in zip(key.tolist(), of, entry, strict=True) if o == i} for i in (0, 1)]
                assert {k for k, _ in keys[0]} & {k for k, e in keys[1] if e} or {k for k, _ in keys[1]} & {k for k, e in keys[0] if e}, (a, b)


def corpus(seed, n, sizes):
    r = random.Random(seed)
    seen, rows = [], []
    for d in range(n):
        lines = []
        for _ in range(r.randrange(6)):
            if seen and r.random() < 0.6:
                x = list(r.choice(seen))
                for _ in range(r.randrange(4)):
                    i = r.randrange(len(x) + 1)
                    x[i : i + r.randrange(2)] = r.choice(["", "é", "b", "c"])
                x = "".join(x)
            else:
                x = "".join(r.choice("abcdefgh é") for _ in range(r.choice(sizes)))
            x = x.strip()
            seen.append(x)
            lines.append(r.choice(["", " "]) + x)
        rows.append((d, "\n".join(lines)))
    return rows


def run(spark, rows, edits, per_edit):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((r.doc_id, r.text) for r in line_dedup.dedup(docs, edits, per_edit).collect())


def test_random(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BLOCK", 3)
    for seed, edits, per_edit, hot in ((1, 2, 4, 256), (2, 1, 6, 4), (3, 3, 4, 256), (4, 2, 6, 3)):
        monkeypatch.setattr(line_dedup, "HOT", hot)
        rows = corpus(seed, 120, [0, 5, 11, 12, 13, 20, 21, 40])
        assert run(spark, rows, edits, per_edit) == brute(rows, edits, per_edit)


def test_short_lines(spark):
    """Lines of 5 to 45 characters under the query's own parameters."""
    rows = corpus(7, 150, [1, 5, 18, 19, 20, 21, 22, 38, 39, 40, 41, 42, 45])
    assert run(spark, rows, line_dedup.EDITS, line_dedup.PER_EDIT) == brute(rows, line_dedup.EDITS, line_dedup.PER_EDIT)


def test_odd_rows(spark):
    line = "a line that is long enough to be compared, of some eighty characters in all, ok"
    docs = [(1, line), (1, line), (2, None), (3, ""), (4, line + "\n" + line[:-1]), (None, line), (5, "x" * 300_000), (6, "x" * 299_999 + "\n\n"), (7, "}\n}\n" * 3), (8, " \r\n\t")]
    frame = spark.createDataFrame([(*x, "t", 1, 5) for x in docs], "doc_id long, text string, line string, n_removed int, t1 int")
    out = line_dedup.dedup(frame)
    assert out.columns == ["doc_id", "text", "line", "t1", "n_lines", "n_removed"]
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in out.collect()), key=str)
    want = [(1, "", 1, 1), (1, "", 1, 1), (2, None, 0, 0), (3, "", 1, 0), (4, "", 2, 2), (None, line, 1, 0), (5, "x" * 300_000, 1, 0), (6, "\n", 3, 1), (7, "}\n", 7, 5), (8, " \r\n\t", 2, 0)]
    assert got == sorted(want, key=str)
    assert line_dedup.dedup(frame.limit(0)).count() == 0
