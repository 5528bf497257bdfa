"""Line dedup: lines that repeat, exactly or within a few edits, stay only where they first occur.

Near lines are found by a segment-partition edit join. A line that may have e edits is split into e + 1
segments; a line within e edits of it has one of them whole, shifted by no more than the edits before and
after it allow. So each line looks up, in an index by (length, segment number, content), those of its own
substrings that may be a segment of a line up to e shorter. Lines that meet under a key are compared by an
edit distance that keeps a bit for each cell of a band about the diagonal.

A segment that very many lines share says little. Lines that meet under such a key are keyed once more, by
all but e of FINE segments together: of so many, e edits change at most e. What still meets is compared in
blocks of BLOCK by BLOCK, so that no key is a single task, and a pair whose letters alone differ too much
is passed over by one matrix step for the whole block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import combinations, product

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import components, grouped_map, materialize, mixed, packed, shuffle_partitions, table, text_batches

#: A line may have one edit for each so many characters, but at most EDITS.
EDITS, PER_EDIT = 2, 20
#: Lines under a key from which on they are keyed by all but a few of FINE segments.
HOT, FINE = 256, 6
#: Lines that meet in a block; lines that a task remembers, so that a line repeated in it is looked up once.
BLOCK, SEEN = 64, 200_000
#: Characters that are hashed at once, or a single line.
CHARACTERS = 1 << 20
#: Lines whose text is wanted are broadcast up to so many (8 bytes each, so below 64 MB with their copies), and joined by shuffle beyond.
BROADCAST_ROWS = 1_000_000
#: Probes that a task keeps in its table.
KNOWN = 1_000_000
#: Classes of characters that the letter filter counts.
LETTERS = 64

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def allowed(n: int, edits: int, per_edit: int) -> int:
    """Edits that a line of ``n`` characters may have."""
    return min(edits, n // per_edit)


def segments(n: int, parts: int) -> list[tuple[int, int]]:
    """Start and length of the ``parts`` segments of a line of ``n`` characters; the last ones are one longer where they don't divide evenly."""
    short, longer = divmod(n, parts)
    out, at = [], 0
    for i in range(parts):
        size = short + (i >= parts - longer)
        out.append((at, size))
        at += size
    return out


#: What is looked up: (names of the key, starts and ends of the substrings it is made of, whether the line stands under it in the index).
Probe = tuple[tuple[int, ...], tuple[tuple[int, int], ...], bool]


def probes(n: int, edits: int, per_edit: int) -> list[Probe]:
    """Single substrings of a line of ``n`` characters that are looked up.

    The substring at ``start`` may be that segment of a line of ``length``: with i segments before it and
    the rest behind, a shift of more than i to one side, or of more than the rest from the other, would
    take an edit too many. The unshifted ones of its own length are also the line's entries in the index.
    """
    out = []
    for length in range(n - allowed(n, edits, per_edit), n + 1):
        more, e = n - length, allowed(length, edits, per_edit)
        if not e or more > e:
            continue
        for i, (at, size) in enumerate(segments(length, e + 1)):
            low, high = max(0, at - i, at + more - (e - i)), min(n - size, at + i, at + more + (e - i))
            out += [((length, i), ((s, s + size),), not more and s == at) for s in range(low, high + 1)]
    return out


def fine_probes(n: int, edits: int, per_edit: int) -> list[Probe]:
    """Sets of substrings that are looked up together: all but e of FINE segments, at every shift that e edits in the others allow."""
    out: dict[tuple, bool] = {}
    for length in range(n - allowed(n, edits, per_edit), n + 1):
        more, e = n - length, allowed(length, edits, per_edit)
        if not e or more > e:
            continue
        cut = segments(length, FINE)
        for changed in combinations(range(FINE), e):
            for shifts in product(range(-e, e + 1), repeat=e):
                if sum(shifts) != more or sum(map(abs, shifts)) > e:
                    continue
                moved = [sum(s for c, s in zip(changed, shifts, strict=True) if c < i) for i in range(FINE)]
                where = tuple((at + moved[i], at + moved[i] + size) for i, (at, size) in enumerate(cut) if i not in changed)
                if where[0][0] >= 0 and where[-1][1] <= n:
                    key = (FINE, length, *changed), where
                    out[key] = out.get(key, False) or not more and not any(shifts)
    return [(name, where, entry) for (name, where), entry in out.items()]


def within(a: str, b: str, edits: int) -> bool:
    """Whether the edit distance of ``a`` and ``b`` is at most ``edits``."""
    if abs(len(a) - len(b)) > edits:
        return False
    # a common start and end don't count
    i, n = 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    a, b, n = a[i:], b[i:], n - i
    i = 0
    while i < n and a[-1 - i] == b[-1 - i]:
        i += 1
    a, b = a[: len(a) - i], b[: len(b) - i]
    if not a or not b:
        return max(len(a), len(b)) <= edits
    bits: dict[str, int] = {}
    for i, c in enumerate(a):
        bits[c] = bits.get(c, 0) | 2 << i
    # bit i of rows[d]: the first i characters of a become what was read of b by at most d edits
    rows = [(1 << (d + 1)) - 1 for d in range(edits + 1)]
    width = (1 << (2 * edits + 1)) - 1
    for j, c in enumerate(b, 1):
        band = width << (j - edits) if j > edits else width >> (edits - j)
        match, before, new = bits.get(c, 0), 0, 0
        for d, old in enumerate(rows):
            step = old << 1 & match
            if d:
                step |= before | before << 1 | new << 1  # insertion, substitution, deletion
            before, new = old, step & band
            rows[d] = new
        if not new:
            return False
    return bool(rows[-1] >> len(a) & 1)


def letters(lines: list[str]) -> np.ndarray:
    """Counts of characters by class; an edit changes two of a line's counts by one at most."""
    out = np.zeros((len(lines), LETTERS), np.int16)
    for i, line in enumerate(lines):
        codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32) % LETTERS
        out[i] = np.minimum(np.bincount(codes, minlength=LETTERS), 30_000)
    return out


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The lines of all texts, trimmed of spaces, tabs and returns; which text each is of, and its number there. None for null."""
    lists = pc.split_pattern(texts, "\n")
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    of = np.repeat(np.arange(len(texts)), size)
    return pc.utf8_trim(lists.flatten(), " \t\r"), of, np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)


def _identities(lines: pa.Array) -> np.ndarray:
    """128 bits for each line, as two longs."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, lines.cast(pa.binary()).to_pylist())), np.int64).reshape(-1, 2)


def _text_keys() -> list[Column]:
    """128 bits that tell texts apart, as two longs."""
    return [F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2")]


def occurrences(docs: DataFrame) -> DataFrame:
    """Lines that are not empty: doc_id, t1, t2 (the text's key), line_no, k1, k2 (the line's key)."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, of, number = _split(batch.column("text"))
            some = np.flatnonzero(pc.binary_length(lines).to_numpy(zero_copy_only=False))
            keys, of = _identities(lines.take(pa.array(some))), pa.array(of[some])
            columns = [*(batch.column(c).take(of) for c in ("doc_id", "t1", "t2")), pa.array(number[some].astype(np.int32)), pa.array(keys[:, 0]), pa.array(keys[:, 1])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "t1", "t2", "line_no", "k1", "k2"])

    return docs.where("text IS NOT NULL").select("doc_id", *_text_keys(), "text").mapInArrow(rows, "doc_id long, t1 long, t2 long, line_no int, k1 long, k2 long")


class Probes:
    """The probes of lines by their length, as one table, so that a batch of lines is hashed at once.

    ``find`` names a length's probes. The table is emptied before it holds more than KNOWN of them.
    """

    def __init__(self, find: Callable[[int], list[Probe]]):
        self.find = find
        self._clear()

    def _clear(self) -> None:
        self.rows: dict[int, tuple[int, int]] = {}
        self.names, self.entries, self.starts, self.ends = np.empty(0, np.uint64), np.empty(0, bool), np.empty((0, 0), np.int64), np.empty((0, 0), np.int64)

    def _learn(self, sizes: list[int]) -> None:
        if len(self.names) > KNOWN:
            self._clear()
        new = [n for n in sizes if n not in self.rows]
        if not new:
            return
        added, at = [], len(self.names)
        for n in new:
            own = self.find(n)
            self.rows[n] = (at, len(own))
            at += len(own)
            added += own
        parts = max([self.starts.shape[1], *(len(where) for _, where, _ in added)])
        # an empty substring for each that a probe lacks; how many it has follows from its name
        more = np.zeros((2, len(added), parts), np.int64)
        for i, (_, where, _) in enumerate(added):
            for k, (s, e) in enumerate(where):
                more[0, i, k], more[1, i, k] = s, e
        wide = [np.pad(x, ((0, 0), (0, parts - x.shape[1]))) for x in (self.starts, self.ends)]
        self.starts, self.ends = (np.concatenate([x, y]) for x, y in zip(wide, more, strict=True))
        self.names = np.concatenate([self.names, np.array([xxhash.xxh64_intdigest(repr(name)) for name, _, _ in added], np.uint64)])
        self.entries = np.concatenate([self.entries, np.array([e for _, _, e in added], bool)])

    def keys(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys of all probes of ``lines``, the place of each one's line, and whether it is an entry."""
        size = np.array([len(x) for x in lines], np.int64)
        self._learn(np.unique(size).tolist())
        codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(codes), _BASE)]), dtype=np.uint64)
        inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(codes), _INVERSE)]), dtype=np.uint64)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(codes * powers[:-1], dtype=np.uint64)])
        at, count = np.array([self.rows[n] for n in size.tolist()], np.int64).reshape(-1, 2).T
        of = np.repeat(np.arange(len(lines)), count)
        row = np.repeat(at - np.cumsum(count) + count, count) + np.arange(count.sum())
        first, h = (np.cumsum(size) - size)[of], self.names[row]
        for k in range(self.starts.shape[1]):
            a, e = first + self.starts[row, k], first + self.ends[row, k]
            h = mixed(h + (sums[e] - sums[a]) * inverse[a])
        return h, of, self.entries[row]


def _chunks(lines: pa.Array, keys: np.ndarray) -> Iterator[tuple[list[str], np.ndarray]]:
    """Parts of the lines of at most about CHARACTERS characters, with their keys."""
    held, size, first = [], 0, 0
    for i, line in enumerate(lines.to_pylist()):
        if held and size + len(line) > CHARACTERS:
            yield held, keys[first:i]
            held, size, first = [], 0, i
        held.append(line)
        size += len(line)
    if held:
        yield held, keys[first:]


def _keys(edits: int, per_edit: int):
    def keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        known = Probes(lambda n: probes(n, edits, per_edit))
        for batch in batches:
            if len(seen) > SEEN:
                seen.clear()
            lines, _, _ = _split(batch.column("text"))
            lines = lines.filter(pc.greater_equal(pc.utf8_length(lines), per_edit))
            ids = _identities(lines)
            fresh = [i for i, k in enumerate(ids[:, 0].tolist()) if not (k in seen or seen.add(k))]
            for part, own in _chunks(lines.take(pa.array(fresh, pa.int64())), ids[fresh, 0]):
                key, of, entry = known.keys(part)
                # the last bit says which keys are entries
                yield pa.RecordBatch.from_arrays([pa.array((key >> np.uint64(1)).view(np.int64)), pa.array(own[of] & -2 | entry)], ["key", "line"])

    return keys


def _fine(edits: int, per_edit: int):
    def keys(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Probes(lambda n: fine_probes(n, edits, per_edit))
        for batch in batches:
            ids, lines = batch["line"].to_numpy(np.int64), batch["text"].tolist()
            for a in range(0, len(lines), 200):
                key, of, entry = known.keys(lines[a : a + 200])
                yield pd.DataFrame({"key": (key >> np.uint64(1)).view(np.int64), "line": ids[a : a + 200][of] & -2 | entry})

    return keys


def _met(keys: DataFrame) -> DataFrame:
    """key, line of the keys under which several lines meet, one at least as an entry; one exchange and one sort."""
    own = Window.partitionBy("key")
    line = F.col("line").bitwiseAND(F.lit(-2).cast("long"))
    met = keys.withColumns({"low": F.min(line).over(own), "high": F.max(line).over(own), "entry": F.max(F.col("line").bitwiseAND(F.lit(1).cast("long"))).over(own)})
    return met.where("entry = 1 AND low < high").select("key", line.alias("line")).distinct()


def _compared(edits: int, per_edit: int):
    def links(rows: pd.DataFrame) -> list[tuple[bytes, bytes]]:
        """Links that connect what is near in the two blocks; pairs that they connect already aren't compared."""
        rows = rows.drop_duplicates("id")
        ids, lines, block = rows["id"].tolist(), rows["text"].tolist(), rows["block"].to_numpy()
        low, high = int(rows["low"].iloc[0]), int(rows["high"].iloc[0])
        counts, size = letters(lines), np.array([len(x) for x in lines])
        first, second = np.flatnonzero(block == low), np.flatnonzero(block == high)
        root = list(range(len(ids)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i

        out = []
        for i in first:
            others = second[second > i] if low == high else second
            apart = np.abs(counts[others] - counts[i]).sum(1)
            for j in others[(apart <= 2 * edits) & (np.abs(size[others] - size[i]) <= edits)]:
                a, b = find(int(i)), find(int(j))
                if a != b and within(lines[i], lines[j], allowed(min(size[i], size[j]), edits, per_edit)):
                    root[a] = b
                    out.append((ids[i], ids[j]))
        return out

    return links


def near_lines(docs: DataFrame, edits: int, per_edit: int) -> DataFrame:
    """Links (a, b) of line ids that connect all near lines of ``docs(text)``; an id is the line's 128 bits."""
    spark, parts = docs.sparkSession, shuffle_partitions(docs.sparkSession)
    texts = docs.where("text IS NOT NULL").select("text")
    met = materialize(_met(texts.mapInArrow(_keys(edits, per_edit), "key long, line long").repartition(parts, "key")), "met")
    wanted = materialize(met.select("line").distinct(), "wanted")
    bounded = wanted.count() <= BROADCAST_ROWS
    keep = spark.sparkContext.broadcast(np.sort(wanted.toPandas()["line"].to_numpy(np.int64))) if bounded else None

    def found(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, _, _ = _split(batch.column("text"))
            lines = lines.filter(pc.greater_equal(pc.utf8_length(lines), per_edit))
            ids = _identities(lines)
            line = ids[:, 0] & -2
            some = np.arange(len(line))
            if keep is not None:
                at = np.minimum(np.searchsorted(keep.value, line), max(0, len(keep.value) - 1))
                some = np.flatnonzero(keep.value[at] == line) if len(keep.value) else some[:0]
            some = some[np.unique(ids[some], axis=0, return_index=True)[1]]
            yield pa.RecordBatch.from_arrays([pa.array(line[some]), pa.array([x.tobytes() for x in ids[some].astype(">i8")], pa.binary()), lines.take(pa.array(some))], ["line", "id", "text"])

    lines = texts.mapInArrow(found, "line long, id binary, text string")
    if not bounded:
        lines = lines.join(wanted, "line", "left_semi")
    lines = materialize(lines.dropDuplicates(["id"]), "met-lines")
    # lines under a key that very many share are keyed again
    sizes = met.groupBy("key").agg(F.count("*").alias("n"))
    met = met.join(sizes, "key")
    hot = materialize(met.where(F.col("n") > HOT).select("line").distinct(), "hot-lines")
    met = met.where(F.col("n") <= HOT).select("key", "line")
    if not hot.isEmpty():
        fine = lines.join(hot, "line", "left_semi").select("line", "text").mapInPandas(_fine(edits, per_edit), "key long, line long")
        met = met.unionByName(materialize(_met(fine.repartition(parts, "key")), "met-again"))
    blocks = met.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
    met = met.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("line", F.lit(1)), F.col("blocks")))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.select("key", "line", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    return materialize(grouped_map(met.join(lines, "line"), ["key", "low", "high"], _compared(edits, per_edit), "a binary, b binary").distinct(), "near")


def _id(k1: str = "k1", k2: str = "k2") -> Column:
    """A line's 128 bits in one column, as ``near_lines`` gives them."""
    return F.unhex(F.concat(*(F.lpad(F.hex(k), 16, "0") for k in (k1, k2))))


def _half(id_: str, at: int) -> Column:
    return F.conv(F.hex(F.substring(id_, at, 8)), 16, -10).cast("long")


def repeats(docs: DataFrame, edits: int = EDITS, per_edit: int = PER_EDIT) -> DataFrame:
    """doc_id, t1, t2, line_no of the lines that repeat an earlier one, in order of doc_id, the text's key and line_no.

    Lines are in one class when near ones connect them; a null doc_id comes first.
    """
    where = F.struct("doc_id", "t1", "t2", "line_no")
    seen = materialize(occurrences(docs), "lines")
    classes = components(near_lines(docs, edits, per_edit), "line-classes")
    several = seen.groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1").select(_id().alias("id"))
    known = several.join(classes.withColumnRenamed("node", "id"), "id", "full").select("id", F.coalesce("component", "id").alias("component"))
    known = materialize(known.select(_half("id", 1).alias("k1"), _half("id", 9).alias("k2"), "component"), "repeated-lines")
    found = materialize(seen.join(known, ["k1", "k2"]).select("doc_id", "t1", "t2", "line_no", "component"), "repeats")
    first = found.groupBy("component").agg(F.min(where).alias("first"))
    return found.join(first, "component").where(~where.eqNullSafe(F.col("first"))).select("doc_id", "t1", "t2", "line_no")


def dedup(docs: DataFrame, edits: int = EDITS, per_edit: int = PER_EDIT) -> DataFrame:
    """``docs`` (doc_id, text and any others) with text freed of repeats, n_lines and n_removed.

    Lines are compared without spaces, tabs and returns at their ends. Two are near when their edit distance
    is at most one for each ``per_edit`` characters of the shorter, and at most ``edits``; shorter ones
    repeat exactly or not at all, and empty ones never do. Every row stays, if with an empty text. A null
    text has no lines and stays null; an empty one has one line. Texts and lines may be as long as a
    column's value can be. Rows that repeat both doc_id and text are one document and are treated alike; of
    different texts under one doc_id, that with the smaller hash comes first. An empty table gives an empty
    one. Columns n_lines and n_removed of ``docs`` are replaced, others pass through.
    """
    text_batches(docs.sparkSession)
    whole, unpack = packed(docs, "doc_id", "text")
    gone = repeats(docs.select("doc_id", "text"), edits, per_edit).groupBy("doc_id", "t1", "t2").agg(F.collect_set("line_no").alias("gone"))
    d, g = whole.withColumns({f"_t{i}": k for i, k in enumerate(_text_keys(), 1)}).alias("d"), gone.alias("g")
    both = d.join(g, (F.col("d._t1") == F.col("g.t1")) & (F.col("d._t2") == F.col("g.t2")) & F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")), "left")
    lines = F.array(F.split("d.text", "\n", -1))
    left = F.transform(lines, lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("g.gone")), lambda i: x[i]), "\n"))
    text = F.when(F.col("g.gone").isNull(), F.col("d.text")).otherwise(left[0])
    columns = [text.alias(c) if c == "text" else F.col(f"d.`{c}`") for c in whole.columns]
    n = F.when(F.col("d.text").isNull(), 0).otherwise(F.length("d.text") - F.length(F.replace(F.col("d.text"), F.lit("\n"), F.lit(""))) + 1)
    both = both.select(*columns, n.cast("long").alias("n_lines"), F.coalesce(F.size("g.gone"), F.lit(0)).cast("long").alias("n_removed"))
    return unpack(both, "n_lines", "n_removed")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))
