"""Exact Jaccard join of documents on word n-grams, by a token-group matrix.

Documents are partitioned into groups of similar ones. A group is known by the union of its members'
tokens (n-grams): if a document shares fewer tokens with the union than the threshold asks of a single
partner, no member can be one, and the group stays closed. Only groups that pass are opened and their
members compared.

1. Documents with the same set of tokens are one node; copies need no comparing.
2. Min-hash keys gather likely partners; each is compared with the most central of its key, that whose own keys
   gather most, as an original's do among its copies. That costs one comparison a document however large the
   gathering. What is linked needs no more comparing.
3. Every pair that may still be missed shares one of its prefix tokens: with tokens in one order for all,
   rare before frequent, two sets with enough common tokens share s of their first n - ceil(t n) + s. Nodes
   that share such tokens with nodes they aren't linked with are partitioned into groups of similar ones
   of about one size, and each is a query to every group that holds s of its prefix tokens. A shared token
   counts where what stands behind it in both sets can still hold the overlap that their sizes ask for.
4. The matrix: a group's row is stored as the union of its members' tokens in a fixed part of the range of
   hashes. A query that lacks more tokens there than it may differ from a partner by, lacks them in every
   member, and the group stays closed. Texts move only to groups that open.
5. Components of the links.

Nothing is left out: the order of tokens and the part of the range decide the cost, not the result. Tokens
are 64-bit hashes of word n-grams, sets and texts are told apart by 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, grouped_map, materialize, mixed, packed, shuffle_partitions, table, text_batches

#: Words of a token and least similarity in hundredths, as the query asks.
WORDS, PERCENT = 4, 85
#: Tokens put last in the order: those in so many documents or more, and of these at most so many (9 bytes each, so below 40 MB
#: in memory), the most frequent first. What is not in the list is rarer than all of it, so a token outside brings few documents together.
FREQUENT, FREQUENT_FROM = 4_000_000, 16
#: Of a set, the tokens that are counted for the list: this many times those that a prefix must have, and so many more. Sets below some 40 tokens are counted whole.
COUNTED, COUNTED_MORE = 1.25, 32
#: Prefix tokens that similar sets must share; a prefix is longer by these less one, but by one at least.
SHARED = 16
#: Min-hash keys and hashes in each.
KEYS, HASHES = 3, 2
#: Members of a group, about, and queries to it in a task; ratio of the largest to the smallest size in a group.
GROUP, QUERIES, BAND = 256, 256, 1.05

#: Keys of texts that are to be compared are broadcast up to so many (some 60 bytes each, so below 64 MB), and joined by shuffle beyond.
BROADCAST_ROWS = 1_000_000

_STEP = np.uint64(0x9E3779B97F4A7C15)


def tokens(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Each text's distinct tokens as sorted hashes: every ``words`` words in a row, or all of fewer; lower-cased A-Z, parted by ASCII white space."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = split.flatten().dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    known = coded.dictionary.cast(pa.binary() if pa.types.is_string(coded.dictionary.type) else pa.large_binary()).to_pylist()
    code = coded.indices.to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64))
    if b"" in known:  # white space at an end
        real = code != known.index(b"")
        code, doc = code[real], doc[real]
    h = np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, len(known))[code]
    starts = np.searchsorted(doc, np.arange(len(texts) + 1))
    n = len(h) - words + 1
    whole = np.full(max(n, 0), np.uint64(words), np.uint64)
    for i in range(words if n > 0 else 0):
        whole = whole * _STEP + h[i : n + i]
    whole = mixed(whole)
    out = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if b - a >= words:
            x = np.sort(whole[a : b - words + 1])
            out.append(x[np.append(True, x[1:] != x[:-1])])
        elif b > a:
            x = np.array([b - a], np.uint64)
            for y in h[a:b]:
                x = x * _STEP + y
            out.append(mixed(x))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def least(n: int, percent: int) -> int:
    """Tokens that a set of ``n`` shares with any similar one, at least."""
    return -(-percent * n // 100)


class Order:
    """The order of tokens: those outside the list by hash, then the list's, rarer levels first."""

    def __init__(self, frequent: np.ndarray, counts: np.ndarray):
        self.frequent = frequent
        self.levels = np.append(1 + np.log2(np.maximum(counts, FREQUENT_FROM) / FREQUENT_FROM).astype(np.int8) // 2, np.int8(0)).astype(np.int8)

    def level(self, x: np.ndarray) -> np.ndarray:
        if not len(self.frequent):
            return np.zeros(len(x), np.int8)
        at = np.minimum(np.searchsorted(self.frequent, x), len(self.frequent) - 1)
        return np.where(self.frequent[at] == x, self.levels[at], np.int8(0))

    def prefix(self, x: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
        """The first n - ceil(t n) + s tokens of sorted ``x``, and s.

        s is SHARED, or less where only frequent tokens could be added, but 1 at least. Sets that share s
        of such prefixes share as many of longer ones, so of two sets' numbers the smaller counts.
        """
        n = len(x)
        must = least(n, percent)
        base, most = n - must, n - must + min(SHARED, must)
        part = x[: 2 * most]
        level = self.level(part)
        rare = part[level == 0]
        if len(rare) < most and len(part) < n:
            part, level = x, self.level(x)
            rare = part[level == 0]
        if len(rare) > base:
            return rare[:most], min(most, len(rare)) - base
        return part[np.argsort(level, kind="stable")][: base + 1], 1


def text_key(text: Column | str = "text") -> Column:
    return F.md5(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary"))


def _ahead(n: int, percent: int) -> int:
    """Of ``n`` tokens in order of their hashes, those that are counted for all sets."""
    return int(COUNTED * (n - least(n, percent))) + COUNTED_MORE


def _counted(words: int, percent: int, order: Order | None = None) -> Callable:
    """Counts of the tokens ahead; with ``order``, of those behind, in sets that have too few rare tokens ahead for their prefix."""

    def behind(x: np.ndarray) -> np.ndarray:
        ahead, must = _ahead(len(x), percent), least(len(x), percent)
        if len(x) <= ahead or np.count_nonzero(order.level(x[:ahead]) == 0) >= len(x) - must + min(SHARED, must):
            return x[:0]
        return x[ahead:]

    def counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = tokens(batch.column("text"), words)
            found = [x[: _ahead(len(x), percent)] for x in sets] if order is None else list(map(behind, sets))
            token, n = np.unique(np.concatenate(found) if found else np.empty(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n.astype(np.int64))], ["token", "n"])

    return counts


def frequent_tokens(docs: DataFrame, words: int, percent: int) -> Order:
    """The order that puts last what is frequent among the tokens that prefixes are taken from.

    Most prefixes lie among a set's tokens ahead. Where too many of these are frequent, the prefix goes on
    behind them, and so the tokens behind are counted too, in those sets.
    """

    def frequent(order: Order | None) -> tuple[np.ndarray, np.ndarray]:
        counts = docs.select("text").mapInArrow(_counted(words, percent, order), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
        top = counts.where(F.col("n") >= FREQUENT_FROM).orderBy(F.desc("n"), "token").limit(FREQUENT // 2).toPandas()
        return top["token"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)

    def ordered(token: np.ndarray, n: np.ndarray) -> Order:
        at = np.lexsort((-n, token))
        token, n = token[at], n[at]
        first = np.append(True, token[1:] != token[:-1])[: len(token)]
        return Order(token[first], n[first])

    ahead = frequent(None)
    more = frequent(ordered(*ahead))
    return ordered(*(np.concatenate(x) for x in zip(ahead, more, strict=True)))


def matrix_limit(percent: int) -> np.uint64:
    """End of the part of the range that matrix rows keep: a quarter more than the share of tokens in which similar sets may differ."""
    return np.uint64(min(1.0, 0.0125 * (100 - percent)) * (2.0**64 - 2**12))


def _lists(values: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(values).view(np.int64) if values else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), pa.array(flat))


def signatures(docs: DataFrame, words: int, percent: int, order: Order) -> DataFrame:
    """``docs(rid, text)`` as rid, n, set_key (null for an empty set), text_key, min-hash keys, prefix, its shared, and low, the tokens of the matrix."""
    shared = docs.sparkSession.sparkContext.broadcast(order)
    seeds = np.random.default_rng(11).integers(1, 1 << 63, KEYS * HASHES).astype(np.uint64)
    limit = matrix_limit(percent)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = tokens(batch.column("text"), words)
            some = [x for x in sets if len(x)]
            low = np.empty((KEYS * HASHES, 0), np.uint64)
            if some:
                flat, starts = np.concatenate(some), np.cumsum([0, *map(len, some[:-1])])
                low = np.stack([np.minimum.reduceat(mixed(flat ^ s), starts) for s in seeds])
            minima = iter(np.ascontiguousarray(low.T).reshape(-1, KEYS, HASHES))
            keys, prefixes, s, ids = [], [], [], []
            for x in sets:
                if not len(x):
                    keys.append(np.empty(0, np.uint64)), prefixes.append(x), s.append(0), ids.append(None)
                    continue
                keys.append(np.array([xxhash.xxh64_intdigest(k.tobytes(), i) for i, k in enumerate(next(minima))], np.uint64))
                first, number = shared.value.prefix(x, percent)
                prefixes.append(first), s.append(number)
                ids.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest())
            columns = [
                batch.column("rid"), pa.array([len(x) for x in sets], pa.int64()), pa.array(ids, pa.binary()), batch.column("text_key"), _lists(keys), _lists(prefixes),
                pa.array(s, pa.int64()), pa.array([x[: np.searchsorted(x, limit)].tobytes() for x in sets], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["rid", "n", "set_key", "text_key", "keys", "prefix", "shared", "low"])

    schema = "rid long, n long, set_key binary, text_key string, keys array<long>, prefix array<long>, shared long, low binary"
    return docs.select("rid", text_key().alias("text_key"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(rows, schema)


def _compared(words: int, percent: int, upward: bool):
    def links(rows: pd.DataFrame) -> list[tuple[int, int]]:
        """Links (a, b) of queries with members of the group in other components, larger ones if ``upward``; one for each component."""
        rows = rows.drop_duplicates(["node", "member"])
        node, component, member = rows["node"].to_numpy(), rows["component"].to_numpy(), rows["member"].to_numpy()
        sets = tokens(pa.array(rows["text"], pa.string()), words)
        out, members = [], np.flatnonzero(member)
        for q in np.flatnonzero(~member):
            x, linked = sets[q], set()
            for m in members:
                y = sets[m]
                if component[m] == component[q] or (upward and component[m] < component[q]) or component[m] in linked or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * common >= percent * (len(x) + len(y) - common):
                    out.append((int(node[q]), int(node[m])))
                    linked.add(component[m])
        return out

    return links


def compare(pairs: DataFrame, groups: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, percent: int, name: str, upward: bool = True) -> DataFrame:
    """Links among ``pairs(node, group)``: queries to groups, whose members are ``groups(group, node)``.

    ``nodes(node, component, text_key, rid)``: a query is compared with members of other components, only larger ones if ``upward``.
    A group with many queries is given to several tasks, each with all of its at most GROUP members.
    """
    rows = dealt(pairs, groups).join(nodes.select("node", "component", "text_key", "rid"), "node")
    wanted = materialize(rows.select("text_key", "rid").distinct(), "wanted")
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    keyed = docs.select(text_key().alias("text_key"), "rid", F.coalesce("text", F.lit("")).alias("text")).alias("d")
    w = wanted.alias("w")
    texts = keyed.join(w, (F.col("d.text_key") == F.col("w.text_key")) & F.col("d.rid").eqNullSafe(F.col("w.rid")), "left_semi").dropDuplicates(["text_key"])
    rows = rows.join(texts.select("text_key", "text"), "text_key").select("group", "chunk", "node", "member", "component", "text")
    return materialize(grouped_map(rows, ["group", "chunk"], _compared(words, percent, upward), "a long, b long"), name)


def dealt(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """group, chunk, node, member: queries dealt to chunks, members to every chunk of their group."""
    chunks = pairs.groupBy("group").agg(F.ceil(F.count("*") / QUERIES).cast("long").alias("chunks"))
    queries = pairs.join(chunks, "group").select("group", F.pmod(F.xxhash64("node"), F.col("chunks")).alias("chunk"), "node", F.lit(False).alias("member"))
    members = groups.join(chunks, "group").select("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), "node", F.lit(True).alias("member"))
    return queries.unionByName(members)


def _union(rows: pd.DataFrame) -> list[tuple[int, bytes]]:
    return [(int(rows["group"].iloc[0]), np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in rows["low"]])).tobytes())]


def _open(percent: int):
    def bounded(rows: pd.DataFrame) -> list[tuple[int, int]]:
        """Queries (node, group) that the group's union allows a partner among its members."""
        member = rows["member"].to_numpy()
        union = [np.frombuffer(x, np.uint64) for x in rows["low"][member]]
        out = []
        for node, n, low in zip(rows["node"][~member].tolist(), rows["n"][~member].tolist(), rows["low"][~member], strict=True):
            x = np.frombuffer(low, np.uint64)
            # of a partner's n or more tokens the query lacks at most n - ceil(t n), wherever they are in the range
            if union and len(x) - len(np.intersect1d(x, union[0], assume_unique=True)) <= n - least(n, percent):
                out.append((node, int(rows["group"].iloc[0])))
        return out

    return bounded


def opened(pairs: DataFrame, groups: DataFrame, low: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs(node, group)`` whose query the group's stored union lets in; ``low(node, n, low)``."""
    asked = groups.join(pairs.select("group").distinct(), "group", "left_semi")
    unions = materialize(grouped_map(asked.join(low, "node").select("group", "low"), ["group"], _union, "group long, low binary"), "matrix")
    chunks = pairs.groupBy("group").agg(F.ceil(F.count("*") / QUERIES).cast("long").alias("chunks"))
    queries = pairs.join(chunks, "group").join(low, "node").select("group", F.pmod(F.xxhash64("node"), F.col("chunks")).alias("chunk"), "node", "n", "low", F.lit(False).alias("member"))
    rows = unions.join(chunks, "group").select("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.lit(0).cast("long").alias("node"), F.lit(0).cast("long").alias("n"), "low", F.lit(True).alias("member"))
    return materialize(grouped_map(queries.unionByName(rows), ["group", "chunk"], _open(percent), "node long, group long"), "opened")


def with_groups(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes`` with component: the smallest node that ``links`` reach."""
    found = components(links).select("node", "component")
    return nodes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` (doc_id, text and any others) with n_shingles and component_id.

    Two documents link when the Jaccard similarity of their token sets is ``percent`` hundredths or more.
    component_id is the smallest doc_id of the documents that links reach. A text without words links
    with nothing and keeps its own doc_id, which may be null; else a component without any id has a null
    one. Repeated rows have equal sets and so a common component. A very long text is one set, however many
    tokens it has. An empty table gives an empty one. Columns ``n_shingles`` and ``component_id`` of ``docs``
    are replaced, others pass through.
    """
    whole, unpack = packed(docs, "doc_id", "text")
    out = grouped(docs, words, percent).dropDuplicates(["rid", "text_key"])
    d, o = whole.withColumn("text_key", text_key()).alias("d"), out.alias("o")
    back = d.join(o, F.col("d.doc_id").eqNullSafe(F.col("o.rid")) & (F.col("d.text_key") == F.col("o.text_key")))
    return unpack(back.select("d.*", "o.n_shingles", "o.component_id"), "n_shingles", "component_id")


def grouped(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """rid (the doc_id), text_key, n_shingles and component_id of every row of ``docs``, as ``join`` says; without moving texts."""
    text_batches(docs.sparkSession)
    # text_key names a row's text, so ids need be neither unique nor present
    base = docs.select(F.col("doc_id").alias("rid"), "text")
    sig = signatures(base, words, percent, frequent_tokens(base, words, percent))
    sig = materialize(sig.withColumn("row", F.monotonically_increasing_id()), "signatures")
    # a node is the first row of each set; its lists are read where they lie
    nodes = materialize(sig.where("n > 0").groupBy("set_key").agg(F.min("row").alias("node")), "nodes")
    rows = nodes.select(F.col("node").alias("row"))
    firsts = sig.join(F.broadcast(rows) if nodes.count() <= BROADCAST_ROWS else rows, "row", "left_semi").withColumnRenamed("row", "node")
    # likely partners: everyone with a key is a query to the most central of the key
    keyed = firsts.select("node", F.posexplode("keys").alias("i", "key"))
    keyed = materialize(keyed.join(keyed.groupBy("i", "key").agg(F.count("*").alias("n")).where("n > 1"), ["i", "key"]), "keyed")
    central = keyed.join(keyed.groupBy("node").agg(F.sum("n").alias("gathered")), "node")
    central = central.groupBy("i", "key").agg(F.max(F.struct("gathered", "node")).alias("c")).select("i", "key", F.col("c.node").alias("group"))
    likely = materialize(keyed.join(central, ["i", "key"]).where("node <> group").select("node", "group").distinct(), "likely")
    alone = firsts.select("node", F.col("node").alias("component"), "text_key", "rid")
    links = compare(likely, likely.select("group", F.col("group").alias("node")).distinct(), alone, base, words, percent, "likely-links", upward=False)
    linked = materialize(with_groups(firsts.select("node", "n", "shared", "text_key", "rid"), links), "linked")
    # prefix tokens that nodes of more than one component hold
    held = firsts.select("node", F.posexplode("prefix").alias("at", "token")).join(linked.select("node", "component"), "node")
    held = held.repartition(shuffle_partitions(docs.sparkSession), "token")
    several = held.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("token")
    # with the same columns on both sides, one exchange serves both
    held = materialize(held.join(several, "token", "left_semi").select("token", "at", "node", "component"), "held").drop("component")
    # groups of similar nodes: by the token that most hold, which edits of one text have in common, and a narrow band of sizes, at most about GROUP in each
    holders = held.groupBy("token").agg(F.count("*").alias("holders"))
    likes = held.select("token", "node").join(holders, "token").groupBy("node").agg(F.max(F.struct("holders", "token")).alias("like")).select("node", F.col("like.token").alias("like")).join(linked.select("node", "n", "shared", "component"), "node")
    likes = likes.withColumn("band", F.floor(F.log("n") / float(np.log(BAND))))
    parts = likes.groupBy("like", "band").agg(F.ceil(F.count("*") / GROUP).cast("long").alias("parts"))
    grouped = likes.join(parts, ["like", "band"]).withColumn("group", F.xxhash64("like", "band", F.pmod(F.xxhash64("node"), F.col("parts"))))
    grouped = materialize(grouped.select("node", "group", "n", "shared", "component"), "members")
    # tokens of a set from the shared one on, itself included
    held = held.join(grouped, "node").withColumn("rest", F.col("n") - F.col("at"))
    rows = held.groupBy("token", "group").agg(F.max("component").alias("high"), F.min("n").alias("least"), F.max("n").alias("most"), F.min("shared").alias("shared"), F.max("rest").alias("rest"))
    q, g = held.alias("q"), rows.alias("g")
    near = (F.col("q.component") < F.col("g.high")) & (100 * F.col("q.n") >= percent * F.col("g.least")) & (100 * F.col("g.most") >= percent * F.col("q.n"))
    # the s first shared tokens of a similar pair have at least its overlap, t (n + m) / (1 + t), less s - 1 in their rests
    rest = F.least("q.rest", "g.rest") + F.least("q.shared", "g.shared") - 1
    near = near & ((100 + percent) * rest >= percent * (F.col("q.n") + F.col("g.least")))
    met = q.join(g, (F.col("q.token") == F.col("g.token")) & near).groupBy("q.node", "g.group").agg(F.count("*").alias("met"), F.min("q.shared").alias("own"), F.min("g.shared").alias("other"))
    pairs = materialize(met.where(F.col("met") >= F.least("own", "other")).select("node", "group"), "pairs")
    members = grouped.select("group", "node")
    pairs = opened(pairs, members, firsts.select("node", "n", "low"), percent)
    more = compare(pairs, members.join(pairs.select("group").distinct(), "group", "left_semi"), linked, base, words, percent, "links")
    final = with_groups(nodes, links.unionByName(more)).select("set_key", "component")
    placed = materialize(sig.select("rid", "n", "set_key", "text_key").join(final, "set_key", "left"), "placed")
    ids = placed.where("component IS NOT NULL").groupBy("component").agg(F.min("rid").alias("component_id"))
    return placed.join(ids, "component", "left").select(
        "rid", "text_key", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("rid")).alias("component_id")
    )


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("rid").alias("doc_id"), "n_shingles", "component_id")


SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) > 0 THEN list_distinct(list_transform(range(1, greatest(len(w) - {WORDS - 1}, 1) + 1), lambda i: array_to_string(w[i : i + {WORDS - 1}], ' '))) ELSE [] END AS x FROM w),
t AS (SELECT doc_id, unnest(x) AS token FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM t a JOIN t b ON a.token = b.token AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * n >= {PERCENT} * (len(x.x) + len(y.x) - n)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS o FROM s UNION SELECT r.doc_id, u.b FROM r JOIN u ON r.o = u.a)
SELECT s.doc_id, len(x)::BIGINT AS n_shingles, m.component_id FROM s JOIN (SELECT doc_id, min(o) AS component_id FROM r GROUP BY doc_id) m ON s.doc_id = m.doc_id
"""
