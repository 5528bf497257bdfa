"""Packing of tokenised documents into sequences: linear grouping, few-size configurations, best fit.

Lengths are whole numbers up to the capacity, so a histogram of at most CAPACITY counts says all that a
plan needs; it is all that reaches the driver. The plan is made in four steps:

1. linear grouping: large pieces, in order of length, form GROUPS groups of equal cardinality, and each
   counts as its group's longest;
2. configurations of these few sizes: for the longest size left, the set of sizes that fills a sequence
   best is found by a bounded knapsack and used as often as the counts allow;
3. substitution: the real pieces take the places of their groups, longest first, which frees the
   rounded-up rest; sequences that hold the same lengths stay together as one class. A class that leaves
   more room than a tolerance is taken apart again;
4. best fit: small pieces and those of classes taken apart, longest first, go where the least room is left
   for them, class by class, in all sequences.

Numbers of groups and tolerances are tried, and the plan with the fewest sequences is taken. With every class
taken apart, step 4 alone is best fit decreasing, so no plan has more sequences than that.

The plan lists runs of pieces of one length. Each piece finds its place from its length and its rank
among the pieces of that length; ranks are summed up over slots, so a length that a third of all pieces
share is no single task.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, packed, table, text_batches

CAPACITY, END_ID = 1024, 2
#: Groups of equal cardinality of the large pieces, which are longer than CAPACITY // SMALL; room that a configuration may leave, -1 for none that stays.
GROUPS, SMALL, TOLERANCES = (16, 64, 256), 8, (1024, 32, 8, 2, 0, -1)
#: The pieces of one length are ranked in so many slots, or more: so many pieces in a slot, about.
SLOTS, SLOT_ROWS = 256, 20_000
#: Ids that go back to Spark at once, or a whole document's.
FRAME_IDS = 1 << 19
#: Runs of white space from this length on are left to the library tokenizers: the faster one's regular expression recurses on them.
LONG_SPACE = 50_000


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """Ids of a text by the tokenizer file ``path``, added tokens read, none added; kept by each Python worker.

    The ids come from the ranks that stand beside the file in its ``.tiktoken`` form, in a fifth of the
    time that the library tokenizers takes for the same ids (tests hold one against the other); that
    library does the texts with very long runs of white space.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    ranks_path = path.removesuffix(".json") + ".tiktoken"
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    library = Tokenizer.from_file(path)
    added = {t.content: i for i, t in library.get_added_tokens_decoder().items()}
    fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    names, long_space = set(added), re.compile(rf"\s{{{LONG_SPACE}}}")

    def encode(text: str) -> np.ndarray:
        if len(text) >= LONG_SPACE and long_space.search(text):
            return np.array(library.encode(text, add_special_tokens=False).ids, np.uint32)
        return fast.encode_to_numpy(text, allowed_special=names, disallowed_special=())

    return encode


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of each piece of ``n`` ids: one if they fit; else only the first is shorter than ``capacity``."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of ``docs(doc_id, text)``: doc_id, piece, start, length, ids, ids_crc32.

    A document is the ids of its text, no special token added, then ``end_id``; a null text is empty. Each
    row of ``docs`` gives its own pieces, repeated rows and null ids too. Other columns are ignored. A text
    may be as long as a column's value can be. ``path`` is a tokenizer file that every executor has, with
    its BPE ranks beside it.
    """
    path = path or tokenizer_path()
    names = ["doc_id", "piece", "start", "length", "ids", "ids_crc32"]

    def frame(doc_id: pa.Array, held: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        of, piece, start, length, crc = [], [], [], [], []
        for i, ids in held:
            data = memoryview(ids).cast("B")
            for k, (s, n) in enumerate(cut(len(ids), capacity)):
                of.append(i), piece.append(k), start.append(s), length.append(n), crc.append(zlib.crc32(data[4 * s : 4 * (s + n)]))
        flat = np.concatenate([ids for _, ids in held]).view(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *length]), pa.int32()), pa.array(flat))
        columns = [doc_id.take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length)), lists, pa.array(crc, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names)

    def tokenised(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path), np.array([end_id], "<u4")
        for batch in batches:
            doc_id, held, size = batch.column("doc_id").cast(pa.int64()), [], 0
            for i, text in enumerate(batch.column("text").to_pylist()):
                held.append((i, np.concatenate([encode(text).astype("<u4", copy=False), end])))
                size += len(held[-1][1])
                if size >= FRAME_IDS:
                    yield frame(doc_id, held)
                    held, size = [], 0
            if held:
                yield frame(doc_id, held)

    schema = "doc_id long, piece int, start long, length long, ids array<int>, ids_crc32 long"
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(tokenised, schema)


@dataclass(frozen=True)
class Run:
    """``count`` pieces of ``length``: ``per`` in each sequence from ``first`` on, the first of them at ``offset``."""

    length: int
    count: int
    first: int
    per: int
    offset: int


def group(counts: dict[int, int], groups: int) -> list[tuple[int, list[list[int]]]]:
    """Linear grouping: (rounded length, [[length, count], ...] from long to short) of equal cardinality, longest first."""
    each, out, room = max(1, -(-sum(counts.values()) // groups)), [], 0
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            if not room:
                out.append((length, []))
                room = each
            k = min(n, room)
            out[-1][1].append([length, k])
            n, room = n - k, room - k
    merged: dict[int, list[list[int]]] = {}
    for length, runs in out:
        merged.setdefault(length, []).extend(runs)
    return list(merged.items())


def best_set(sizes: list[int], left: list[int], start: int, capacity: int) -> dict[int, int]:
    """Indices and copies of the sizes, one ``start`` at least, that fill ``capacity`` best."""
    reach, steps, mask = 1 << sizes[start], [], (1 << (capacity + 1)) - 1
    for i in range(start, len(sizes)):
        most = min(left[i] - (i == start), capacity // sizes[i])
        for c in range(most):
            new = (reach | reach << sizes[i]) & mask
            if new == reach:
                break
            steps.append((i, reach))
            reach = new
        if reach >> capacity & 1:
            break
    total, chosen = reach.bit_length() - 1, {start: 1}
    for i, before in reversed(steps):
        if not before >> total & 1:
            chosen[i] = chosen.get(i, 0) + 1
            total -= sizes[i]
    return chosen


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: Sequence[int] = GROUPS, small: int = SMALL, tolerances: Sequence[int] = TOLERANCES) -> tuple[list[Run], int]:
    """Runs that place ``counts`` of pieces by length, and the number of sequences: the best of all numbers of groups and tolerances."""
    least = -(-sum(n * c for n, c in counts.items()) // capacity)
    best = None
    for g in groups:
        for tolerance in tolerances:
            found = planned(counts, capacity, g, small, tolerance)
            if best is None or found[1] < best[1]:
                best = found
            if best[1] == least:
                return best
    return best


def planned(counts: dict[int, int], capacity: int, groups: int, small: int, tolerance: int) -> tuple[list[Run], int]:
    """The plan for one number of groups; configurations that leave more than ``tolerance`` are taken apart."""
    pool = {n: c for n, c in counts.items() if n <= capacity // small}
    runs: list[Run] = []
    used = counts.get(capacity, 0)
    if used:
        runs.append(Run(capacity, used, 0, 1, 0))
    rooms: dict[int, list[tuple[int, int]]] = {}  # room left -> [(first sequence, sequences)]
    grouped = group({n: c for n, c in counts.items() if capacity > n > capacity // small}, groups)
    sizes, left = [n for n, _ in grouped], [sum(c for _, c in parts) for _, parts in grouped]
    queues = [parts for _, parts in grouped]
    for start in range(len(sizes)):
        while left[start]:
            chosen = best_set(sizes, left, start, capacity)
            times = min(left[i] // k for i, k in chosen.items())
            lines = []  # the real lengths at each place of the configuration, along its sequences
            for i, k in chosen.items():
                left[i] -= k * times
                for _ in range(k):
                    lines.append(_take(queues[i], times))
            while times:
                n = min(line[-1][1] for line in lines)
                keep, offset = capacity - sum(line[-1][0] for line in lines) <= tolerance, 0
                for line in lines:
                    length = line[-1][0]
                    if keep:
                        runs.append(Run(length, n, used, 1, offset))
                    else:
                        pool[length] = pool.get(length, 0) + n
                    offset += length
                    line[-1][1] -= n
                    if not line[-1][1]:
                        line.pop()
                if keep:
                    rooms.setdefault(capacity - offset, []).append((used, n))
                    used += n
                times -= n
    order = sorted(rooms)
    for length in sorted(pool, reverse=True):
        n = pool[length]
        while n:
            at = bisect_left(order, length)
            if at == len(order):
                new = -(-n // (capacity // length))
                rooms[capacity] = [(used, new)]
                insort(order, capacity)
                used += new
                continue
            room = order[at]
            first, sequences = rooms[room].pop()
            if not rooms[room]:
                order.pop(at)
            per = min(room // length, n)
            take = min(sequences, n // per)
            runs.append(Run(length, take * per, first, per, capacity - room))
            n -= take * per
            for r, f, s in ((room - per * length, first, take), (room, first + take, sequences - take)):
                if s:
                    if not rooms.setdefault(r, []):
                        insort(order, r)
                    rooms[r].append((f, s))
    return runs, used


def _take(queue: list[list[int]], n: int) -> list[list[int]]:
    """The next ``n`` pieces of a queue of [length, count]; last first, for popping."""
    out = []
    while n:
        k = min(n, queue[0][1])
        out.append([queue[0][0], k])
        queue[0][1] -= k
        n -= k
        if not queue[0][1]:
            queue.pop(0)
    return out[::-1]


def place(cut_up: DataFrame, capacity: int = CAPACITY, groups: Sequence[int] = GROUPS, small: int = SMALL) -> DataFrame:
    """``cut_up`` (doc_id, piece, length, ids_crc32 and any others) with sequence_id and offset.

    Read more than once, so it should be stored. Pieces of a length may be placed in any order; ties are
    ordered by doc_id, piece and ids_crc32, and equal rows may change places. Other columns of any name pass through.
    """
    whole, unpack = packed(cut_up, "doc_id", "piece", "length", "ids_crc32")
    slots = max(SLOTS, -(-cut_up.count() // SLOT_ROWS))
    d = whole.withColumn("_slot", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(slots)))
    slots = materialize(d.groupBy("length", "_slot").agg(F.count("*").alias("n")), "lengths")
    counts = {r.length: r.n for r in slots.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs, _ = plan(counts, capacity, groups, small)
    before = Window.partitionBy("length").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.select("length", "_slot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_slot").orderBy("doc_id", "piece", "ids_crc32")
    d = d.join(slots, ["length", "_slot"]).withColumn("_rank", F.col("_before") + F.row_number().over(within) - 1)
    # runs in order of length; the first rank of each among the pieces of its length
    runs = sorted(runs, key=lambda r: r.length)
    low, seen = [], {}
    for r in runs:
        low.append((r.length << 48) + seen.get(r.length, 0))
        seen[r.length] = seen.get(r.length, 0) + r.count
    arrays = d.sparkSession.sparkContext.broadcast((np.array(low, np.int64), *(np.array([getattr(r, k) for r in runs], np.int64) for k in ("first", "per", "offset", "length"))))

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        low, first, per, offset, size = arrays.value
        key = (length.to_numpy(np.int64) << 48) + rank.to_numpy(np.int64)
        at = np.searchsorted(low, key, "right") - 1
        k = key - low[at]
        return pd.DataFrame({"sequence_id": first[at] + k // per[at], "offset": offset[at] + k % per[at] * size[at]})

    d = d.withColumn("_at", placed("length", "_rank"))
    return unpack(d.withColumns({"sequence_id": F.col("_at.sequence_id"), "offset": F.col("_at.offset")}), "sequence_id", "offset")


def pack(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The placed pieces of ``docs(doc_id, text)``, with their ids. An empty table gives none."""
    text_batches(docs.sparkSession)
    return place(materialize(pieces(docs, path), "pieces"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
