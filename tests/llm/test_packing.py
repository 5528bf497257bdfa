import random
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import pytest

from siftwell.llm import packing


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_ids(reference, spark, sf):
    encode = packing.encoder(packing.tokenizer_path())
    r = random.Random(4)
    texts = [x.text for x in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    for low, high in ((0, 0x250), (0x250, 0x3000), (0x3000, 0xD000), (0xE000, 0x20000), (0x20, 0x7F)):
        texts += ["".join(chr(r.randrange(low, high)) if r.random() < 0.8 else r.choice(" \n\t\r  '") for _ in range(60)) for _ in range(300)]
    texts += ["", " ", "   a  b\n\n c ", "<|endoftext|>", "x <|endoftext|> y", "<|endoftext|><|endoftext|>\n <|endoftext|", "it's we'LL 12 345٣", "a" * 5000]
    for text in texts:
        assert encode(text).tolist() == reference(text), text


@pytest.mark.parametrize("piece", ["a", "ab ", "1", "!", "é", "😀", "\t\n", " ", "\n", "\u3000", "中", "\u0301", "a" + " " * 60_000])
def test_very_long_texts(reference, piece):
    text = (piece * (2_000_000 // len(piece) + 1))[:2_000_000]
    ids = packing.encoder(packing.tokenizer_path())(text)
    assert ids.tolist() == reference(text)


def test_cut():
    assert packing.cut(5, 4) == [(0, 1), (1, 4)] and packing.cut(4, 4) == [(0, 4)] and packing.cut(8, 4) == [(0, 4), (4, 4)] and packing.cut(1, 4) == [(0, 1)]


def filled(runs, counts, used, capacity):
    assert Counter({n: c for n, c in counts.items() if c}) == sum((Counter({r.length: r.count}) for r in runs), Counter())
    bins = defaultdict(list)
    for r in runs:
        for i in range(r.count):
            bins[r.first + i // r.per].append((r.offset + i % r.per * r.length, r.length))
    assert sorted(bins) == list(range(used))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity


def best_fit_decreasing(counts, capacity):
    rooms = []
    for length in sorted(counts.elements(), reverse=True):
        at = bisect_left(rooms, length)
        insort(rooms, (rooms.pop(at) if at < len(rooms) else capacity) - length)
    return len(rooms)


def test_plan_of_the_tables():
    """Not more sequences than best fit decreasing, on the lengths of a table; configurations are in use."""
    r = random.Random(12)
    counts = Counter(min(1024, 1 + int(r.lognormvariate(5.5, 1.0))) for _ in range(20_000))
    counts[1024] += 3000
    runs, used = packing.plan(dict(counts))
    filled(runs, counts, used, 1024)
    assert used <= best_fit_decreasing(counts, 1024)


@pytest.mark.parametrize("seed", range(6))
def test_plan(seed):
    r = random.Random(seed)
    draw = [lambda: r.randrange(1, 1025), lambda: min(1024, int(r.expovariate(1 / 300)) + 1), lambda: r.choice([600, 500, 10, 700]), lambda: 1024, lambda: r.randrange(1, 40), lambda: r.randrange(400, 700)][seed]
    counts = Counter(draw() for _ in range(5000))
    runs, used = packing.plan(dict(counts))
    filled(runs, counts, used, 1024)
    assert used <= best_fit_decreasing(counts, 1024)
    if seed in (0, 1, 4):
        assert used <= 1.02 * sum(n * c for n, c in counts.items()) / 1024 + 2


def test_plan_of_nothing():
    assert packing.plan({}) == ([], 0)


def test_pack(spark, reference):
    rows = [(1, None, "x"), (1, None, "x"), (None, "a b", "y"), (2, "", "z"), (3, "hello world " * 900, "w"), (4, "some text", "v"), (4, "some text", "v"), (4, "other text", "v")]
    rows += [(10 + i, "filler words here " * (i % 40), "t") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset string")
    got = packing.pack(docs).collect()
    want = Counter()
    for doc_id, text, _ in rows:
        ids = [*reference(text or ""), 2]
        for k, (s, n) in enumerate(packing.cut(len(ids), 1024)):
            want[(doc_id, k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()))] += 1
    assert Counter((g.doc_id, g.piece, g.start, g.length, g.ids_crc32) for g in got) == want
    bins = defaultdict(list)
    for g in got:
        assert len(g.ids) == g.length
        bins[g.sequence_id].append((g.offset, g.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(docs.limit(0)).count() == 0
