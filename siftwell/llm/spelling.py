r"""Spelling variants of a vocabulary: words one code point apart, found with bidirectional FM indexes.

A word that differs from another by one inserted, deleted or replaced code point shares the whole first or
the whole second half of it. So two search schemes find all: match the first half exactly, outward from the
middle to the delimiter before it, then extend to the right over the second half and its delimiter with one
error; and the mirror image. An index over the delimited words of a shard keeps the intervals of suffix
ranks of a pattern in the text and in the reversed text in step, so that a pattern grows on either side.

A shard holds the words that can share a half: those with a beginning (first scheme) or an ending (second
scheme) of up to four code points in common, as many as half of the searching word has. Frequent beginnings
and endings are dealt to several shards, and their searching words go to each of them in blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import grouped_map, materialize, shuffle_partitions, table

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A run whose checksum this divides loses a letter. Code points and occurrences that a word has at least; a form is so many times as frequent.
LOSES, LENGTH, OCCURRENCES, TIMES = 97, 5, 3, 2
#: Code points of the key that brings words to a shard, at most; words of a shard, between these as the shuffle has partitions.
KEY, FEW, MANY = 4, 2048, 16_384
#: Searches that go through an index together.
TOGETHER = 1024


class Side:
    """Ranks over the last column of the sorted rotations of one direction of a text."""

    def __init__(self, text: np.ndarray, letters: int) -> None:
        n = len(text)
        rank, step = text.astype(np.int64), 1
        while True:
            # rotations are sorted by twice as many letters each time
            pair = rank * (int(rank.max()) + 1) + np.roll(rank, -step)
            self.rotations = np.argsort(pair, kind="stable")
            grown = np.concatenate([[0], np.cumsum(np.diff(pair[self.rotations]) != 0)])
            rank = np.empty(n, np.int64)
            rank[self.rotations] = grown
            step *= 2
            if grown[-1] == n - 1 or step >= n:
                break
        last = text[self.rotations - 1]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=letters))])[:letters]
        blocks = n // 64 + 1
        self.bits, ones = np.zeros((blocks, letters), np.uint64), np.zeros((blocks + 1, letters), np.int64)
        at = np.arange(n)
        np.bitwise_or.at(self.bits, (at >> 6, last), np.uint64(1) << (at & 63).astype(np.uint64))
        ones[1:] = np.cumsum(np.bitwise_count(self.bits), axis=0)
        self.before = ones[:-1]

    def every(self, i: np.ndarray) -> np.ndarray:
        """How often each letter is among the first ``i`` of the last column."""
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.bits[i >> 6] & mask[:, None])

    def one(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often letter ``c`` is among the first ``i``."""
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6, c] + np.bitwise_count(self.bits[i >> 6, c] & mask)


class Index:
    """A bidirectional FM index of distinct, delimited words, none of which holds NUL. The work grows with the number of letters."""

    def __init__(self, words: list[str]) -> None:
        self.words = words
        points = np.frombuffer(("\0" + "\0".join(words)).encode("utf-32-le"), np.uint32)
        self.alphabet, text = np.unique(points, return_inverse=True)
        self.n, letters = len(text), len(self.alphabet)
        #: 0 grows a pattern to the left, 1 to the right.
        self.sides = Side(text, letters), Side(text[::-1], letters)
        self.ended = np.cumsum(text == 0)

    def coded(self, text: str) -> np.ndarray:
        """Letters of ``text``, -1 for one that no word has."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == points, at, -1)

    def halves(self, side: int, patterns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Intervals on the other side, and their sizes, of patterns that grow from nothing on ``side``."""
        own, longest = self.sides[side], max(map(len, patterns))
        p = _rows(patterns, longest)
        here, there, size = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64), np.full(len(p), self.n)
        lengths = np.array([len(x) for x in patterns])
        for j in range(longest):
            size[(lengths > j) & (p[:, j] < 0)] = 0
            go = np.flatnonzero((lengths > j) & (size > 0))
            c, rows = p[go, j], np.arange(len(go))
            a, b = own.every(here[go]), own.every(here[go] + size[go])
            within = np.cumsum(b - a, axis=1)
            here[go], size[go] = own.starts[c] + a[rows, c], b[rows, c] - a[rows, c]
            there[go] += within[rows, c] - size[go]
        return there, size

    def with_error(self, side: int, at: np.ndarray, size: np.ndarray, patterns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(pattern, word) numbers of the words that the intervals grow to on ``side`` over the patterns with exactly one error."""
        own, longest = self.sides[side], max(map(len, patterns))
        p, lengths = _rows(patterns, longest), np.array([len(x) for x in patterns])
        alive, held = np.flatnonzero(size > 0), []
        lo, n = at[alive], size[alive]
        for j in range(longest):
            going = lengths[alive] > j
            alive, lo, n = alive[going], lo[going], n[going]
            if not len(alive):
                break
            wanted, a = p[alive, j], own.every(lo)
            sizes, los = own.every(lo + n) - a, own.starts + a
            i, c = np.nonzero(sizes[:, 1:])  # the delimiter, 0, is no error
            c += 1
            replaced = (c != wanted[i]) & (wanted[i] != 0)
            held += [(alive[i], np.full(len(i), j), los[i, c], sizes[i, c]), (alive[i][replaced], np.full(replaced.sum(), j + 1), los[i, c][replaced], sizes[i, c][replaced])]
            inner = wanted != 0
            held.append((alive[inner], np.full(inner.sum(), j + 1), lo[inner], n[inner]))
            rows = np.flatnonzero(wanted >= 0)
            rows = rows[sizes[rows, wanted[rows]] > 0]
            alive, lo, n = alive[rows], los[rows, wanted[rows]], sizes[rows, wanted[rows]]
        found = [np.zeros((2, 0), np.int64)]
        if held:
            q, j, lo, n = (np.concatenate(x) for x in zip(*held, strict=True))
            while len(q):
                ended = j == lengths[q]
                found.append(np.stack([q[ended], self._words(side, lo[ended])]))
                q, j, lo, n = q[~ended], j[~ended], lo[~ended], n[~ended]
                c = p[q, j]
                q, j, lo, n, c = (x[c >= 0] for x in (q, j, lo, n, c))
                a = own.one(c, lo)
                n, lo, j = own.one(c, lo + n) - a, own.starts[c] + a, j + 1
                q, j, lo, n = q[n > 0], j[n > 0], lo[n > 0], n[n > 0]
        q, w = np.unique(np.concatenate(found, axis=1), axis=1)
        return q, w

    def _words(self, side: int, rank: np.ndarray) -> np.ndarray:
        """The word behind (side 0) or before (side 1) the delimiter at which the rotation of this rank begins."""
        place = self.sides[side].rotations[rank]
        return self.ended[place] - 1 if side == 0 else (self.ended[self.n - 1 - place] - 2) % len(self.words)

    def near(self, queries: list[str], scheme: int) -> list[tuple[int, int]]:
        """(query, word) numbers of words one edit from a query that share its first (scheme 0) or second half (scheme 1), once each."""
        out = []
        for a in range(0, len(queries), TOGETHER):
            part, stop = queries[a : a + TOGETHER], np.zeros(1, np.int64)
            cut = [(q[: len(q) // 2][::-1], q[len(q) // 2 :]) for q in part]
            if scheme:
                cut = [(second, first) for first, second in cut]
            exact: dict[str, int] = {}
            which = np.array([exact.setdefault(x, len(exact)) for x, _ in cut])
            there, size = self.halves(scheme, [np.concatenate([self.coded(x), stop]) for x in exact])
            q, w = self.with_error(1 - scheme, there[which], size[which], [np.concatenate([self.coded(x), stop]) for _, x in cut])
            out += zip((q + a).tolist(), w.tolist(), strict=True)
        return out


def _rows(patterns: list[np.ndarray], longest: int) -> np.ndarray:
    out = np.zeros((len(patterns), longest), np.int64)
    for i, x in enumerate(patterns):
        out[i, : len(x)] = x
    return out


def _order(word: str) -> list[int]:
    """Greatest for the first word in code-point order."""
    return [*(-ord(c) for c in word), 1]


def _searched(group: pd.DataFrame) -> list[tuple]:
    """For each searching word of a shard: how many are near, and the most frequent of them."""
    index = group[~group["asks"]].drop_duplicates("word")
    asks = group[group["asks"]].drop_duplicates("word")
    if not len(index) or not len(asks):
        return []
    scheme, words, counts, queries = int(group["scheme"].iloc[0]), index["word"].tolist(), index["n"].tolist(), asks["word"].tolist()
    best: dict[str, tuple[int, int, str]] = {}
    for q, w in Index(words).near(queries, scheme):
        word, other = queries[q], words[w]
        if scheme and other.startswith(word[: len(word) // 2]):
            continue  # the first scheme has it
        near, n, form = best.get(word, (0, -1, ""))
        best[word] = (near + 1, *max((n, form), (counts[w], other), key=lambda x: (x[0], _order(x[1]))))
    return [(word, *x) for word, x in best.items()]


def near_words(vocabulary: DataFrame) -> DataFrame:
    """word, n_near, form and form_n of each word of ``vocabulary(word, n)`` that has a near one.

    Words are distinct, none is null or holds NUL. form is the near word of largest n, of equally frequent
    ones the first in code-point order. A word of any length is searched whole.
    """
    v = vocabulary.select("word", "n", F.length("word").alias("size"))
    spark = v.sparkSession
    words = max(1, v.count())
    target = min(MANY, max(FEW, words // shuffle_partitions(spark)))
    cut = lambda size: F.least(F.greatest(F.floor(size / 2), F.lit(0)), F.lit(KEY)).cast("int")
    length = F.col("size")
    # a word is indexed for searching words that are one shorter, as long, or one longer
    lengths = F.array_distinct(F.array(cut(length - 1), cut(length), cut(length + 1)))
    index = v.select("word", "n", F.explode(lengths).alias("k"), F.lit(False).alias("asks"))
    rows = index.unionByName(v.select("word", "n", cut(length).alias("k"), F.lit(True).alias("asks")))
    key = F.when(F.col("scheme") == 0, F.expr("left(word, k)")).otherwise(F.expr("right(word, k)"))
    rows = rows.withColumn("scheme", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("key", F.concat(F.col("scheme").cast("string"), F.lit(":"), key))
    # at most 4 keys of a word have more rows than a shard is to hold, so the table of those has at most 4 / target as many rows as the vocabulary
    hot = rows.where("not asks").groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > target)
    hot = materialize(hot.select("key", F.ceil(F.col("rows") / target).cast("int").alias("parts")), "hot")
    if hot.count() <= 100_000:
        hot = F.broadcast(hot)
    rows = rows.join(hot, "key", "left")
    own = F.pmod(F.xxhash64(F.lit("part"), "word"), F.col("parts")).cast("int")
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    pairs = F.when(F.col("asks"), F.transform(every, lambda i: F.struct(i.alias("i"), own.alias("j")))).otherwise(F.transform(every, lambda j: F.struct(own.alias("i"), j.alias("j"))))
    buckets = max(1, -(-4 * words // target))
    bucket = F.concat(F.col("scheme").cast("string"), F.lit("#"), F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("string"))
    shard = F.concat_ws("\0", "key", F.col("p.i").cast("string"), F.col("p.j").cast("string"))
    dealt = rows.where("parts is null").withColumn("shard", bucket).select("shard", "scheme", "asks", "word", "n")
    dealt = dealt.unionByName(rows.where("parts is not null").withColumn("p", F.explode(pairs)).withColumn("shard", shard).select("shard", "scheme", "asks", "word", "n"))
    found = grouped_map(dealt, ["shard"], _searched, "word string, n_near long, form_n long, form string")
    first = F.struct("form_n", F.concat(F.transform(F.split("form", ""), lambda c: -F.ascii(c)), F.array(F.lit(1))).alias("order"), "form")
    out = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.max(first).alias("best"))
    return out.select("word", "n_near", "best.form", "best.form_n")


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for ``forms(word, form)``: the end of each chain, whose way is halved in every round. No chain is a ring."""
    r = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = r.select(F.col("word").alias("root"), F.col("root").alias("next"))
        r = materialize(r.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if r.where("moved").isEmpty():
            return r.select("word", "root")
        r = r.select("word", "root")


def vocabulary(docs: DataFrame) -> DataFrame:
    """``(word, n)``: the words of ``docs(doc_id, text)`` with at least LENGTH code points and OCCURRENCES.

    A null text has no words; a null id counts as empty where it decides which letters go. Repeated rows count each.
    """
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUN), F.lit(0))).alias("run"),
    ).where(F.length("run") >= LENGTH)
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    runs = runs.withColumn("h", h)
    shorter = F.expr("concat(left(run, cast(h % length(run) AS INT)), substring(run, cast(h % length(run) AS INT) + 2))")
    words = runs.select(F.when(F.col("h") % LOSES == 0, shorter).otherwise(F.col("run")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).where((F.length("word") >= LENGTH) & (F.col("n") >= OCCURRENCES))


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """``words(word, n)`` with form, root, n_near and form_n.

    A word's form is its most frequent near word if that is at least ``times`` (two or more) as frequent, its root the end
    of the chain of forms, itself if it has none. An empty vocabulary gives no rows.
    """
    v = materialize(words.select("word", "n"), "vocabulary")
    near = v.join(near_words(v), "word", "left")
    form = F.col("form_n") >= times * F.col("n")
    near = near.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(form, F.col("form")).alias("form"), F.when(form, F.col("form_n")).alias("form_n"))
    near = materialize(near, "near")
    ends = roots(near.where("form is not null").select("word", "form"))
    return near.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(vocabulary(table(spark, sf_dir, "documents").select("doc_id", "text")))


#: Near words by the deletions that they share; a checksum by the table of its 256 remainders.
SQL = f"""
WITH RECURSIVE
crc AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{RUN}')) AS run FROM documents),
each AS (SELECT id, run, count(*) AS n, hex(encode(id || ':' || run)) AS x FROM runs WHERE length(run) >= {LENGTH} GROUP BY ALL),
h AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: (instr('0123456789ABCDEF', x[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', x[2 * i + 2]) - 1)),
             lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) AS h FROM each, crc),
v AS (SELECT CASE WHEN h % {LOSES} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(n)::BIGINT AS n
      FROM h GROUP BY 1 HAVING length(word) >= {LENGTH} AND sum(n) >= {OCCURRENCES}),
d AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
p AS (SELECT a.word, b.word AS other, b.n AS other_n FROM d a JOIN d b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
      UNION SELECT d.word, v.word, v.n FROM d JOIN v ON d.rest = v.word UNION SELECT v.word, d.word, d.n FROM d JOIN v ON d.rest = v.word),
q AS (SELECT word, count(*) AS n_near, max(other_n) AS top, min(CASE WHEN other_n = most THEN other END) AS other
      FROM (SELECT *, max(other_n) OVER (PARTITION BY word) AS most FROM p) GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= {TIMES} * v.n THEN other END AS form, CASE WHEN top >= {TIMES} * v.n THEN top END AS form_n FROM v LEFT JOIN q USING (word)),
c AS (SELECT word, word AS root FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM f JOIN c USING (word) JOIN f e ON e.word = c.root WHERE e.form IS NULL
"""
