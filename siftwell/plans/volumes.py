"""Queries over volumes: journals, logs, extents and indexes whose bytes are made from the tables in SQL, damaged ones among them; each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import journals
from ..streaming import carry
from .catalog import query, read
from .structures import _bytes


def zeros(n: Column | int) -> Column:
    return F.unhex(F.repeat(F.lit("00"), F.lit(n).cast("int") if isinstance(n, int) else n.cast("int")))


def joined(parts: Column) -> Column:
    """The bytes of an array of binaries, one after the other."""
    return F.unhex(F.array_join(F.transform(parts, F.hex), ""))


def utf16(text: Column) -> Column:
    return F.encode(text, "UTF-16LE")


def chunked(streams: DataFrame, key: str, size: int, gap: Column) -> DataFrame:
    """``streams(key, blob)`` in chunks of ``size`` bytes, whose places in the source are apart; ``gap`` says of ``key`` and chunk ``k`` whether one is before it."""
    d = streams.select(key, "blob", F.explode(F.sequence(F.lit(0), F.ceil(F.length("blob") / size).cast("int") - 1)).alias("k"))
    start = F.col("k").cast("long") * size
    return d.select(key, start.alias("logical_start"), F.substring("blob", F.col("k") * size + 1, F.lit(size)).alias("data"), (F.lit(1 << 20) + F.col("k").cast("long") * 4096).alias("physical_start"), gap.alias("gap_before"))


# --- change journals ----------------------------------------------------------------------------------

CHUNK, GAP_AT = 128, 3


@query(f"""
WITH r AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 3 ELSE 2 END AS version, 'o' || o_orderkey || '.dat' AS name FROM orders),
n AS (SELECT *, ((CASE version WHEN 3 THEN 76 ELSE 60 END + 2 * length(name) + 7) // 8) * 8 AS n FROM r),
p AS (SELECT *, sum(n) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::BIGINT - n AS start FROM n)
SELECT o_custkey, start AS "offset", CASE WHEN o_orderkey % 7 <> 5 THEN n::INTEGER END AS length, CASE WHEN o_orderkey % 7 <> 5 THEN version END AS version, CASE WHEN o_orderkey % 7 <> 5 THEN printf('%032x', o_orderkey + 1) END AS file,
       CASE WHEN o_orderkey % 7 <> 5 THEN name END AS name, CASE WHEN o_orderkey % 7 <> 5 THEN o_orderkey % 65536 END AS reason, CASE WHEN o_orderkey % 7 <> 5 THEN 1555526400000000 + o_orderkey * 1000 END AS micros,
       CASE WHEN o_orderkey % 7 <> 5 THEN (start + n - 1) // {CHUNK} - start // {CHUNK} + 1 END AS segments, {1 << 20} + start // {CHUNK} * 4096 + start % {CHUNK} AS physical,
       CASE WHEN o_orderkey % 7 = 5 THEN '{journals.CHANGE_TEXT}' END AS failure
FROM p WHERE o_orderkey % 7 <> 3 AND NOT (o_custkey % 3 = 0 AND start < {CHUNK * GAP_AT} AND start + n > {CHUNK * GAP_AT})""")
def journal_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as a change journal in chunks of 128 bytes: both versions, records of no version, without a time, and gaps that cut some."""
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    key, major = F.col("o_orderkey"), F.when(F.col("o_orderkey") % 4 == 0, 3).otherwise(2)
    o = o.withColumns({"name": F.concat(F.lit("o"), key.cast("string"), F.lit(".dat")), "major": major})
    head = F.when(F.col("major") == 3, 76).otherwise(60)
    o = o.withColumn("n", F.ceil((head + 2 * F.length("name")) / 8) * 8)
    wide = F.when(F.col("major") == 3, 8).otherwise(0)
    ticks = F.when(key % 7 == 5, 0).otherwise(132_000_000_000_000_000 + key * 10_000)
    record = F.concat(
        _bytes(F.col("n"), 4), _bytes(F.when(key % 7 == 3, 9).otherwise(F.col("major")), 2), zeros(2), _bytes(key + 1, 8), zeros(wide), _bytes(F.col("o_custkey") + 1, 8), zeros(wide), _bytes(F.lit(7), 8),
        _bytes(ticks, 8), _bytes(key % 65536, 4), zeros(12), _bytes(2 * F.length("name"), 2), _bytes(head, 2), utf16(F.col("name")), zeros(F.col("n") - head - 2 * F.length("name")),
    )
    streams = o.select("o_custkey", "o_orderkey", record.alias("r")).groupBy("o_custkey").agg(joined(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "r"))), lambda x: x["r"])).alias("blob"))
    chunks = chunked(streams, "o_custkey", CHUNK, (F.col("o_custkey") % 3 == 0) & (F.col("k") == GAP_AT))
    found = carry.carried(chunks, ["o_custkey"], journals.Changes).where(F.col("failure").isNull() | (F.col("failure") == journals.CHANGE_TEXT))
    n = F.when(F.col("failure").isNull(), F.size("segments").cast("long"))
    return found.select("o_custkey", "offset", "length", "version", "file", "name", "reason", "micros", n.alias("segments"), F.col("segments")[0]["physical"].alias("physical"), "failure")


# --- log pages ----------------------------------------------------------------------------------------

PAGE, HEAD, RECORD, ON_PAGE = 512, 48, 72, 6


@query(f"""
WITH l AS (SELECT l_orderkey, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber) - 1 AS rn FROM lineitem),
p AS (SELECT *, rn // {ON_PAGE} AS page, {PAGE} + rn // {ON_PAGE} * {PAGE} + {HEAD} + rn % {ON_PAGE} * {RECORD} AS start, l_partkey % 13 = 0 AS wrong FROM l),
b AS (SELECT *, l_orderkey % 11 = 0 AND page = 0 AS broken, sum(wrong::INTEGER) OVER (PARTITION BY l_orderkey, page ORDER BY rn) AS wrongs FROM p)
SELECT l_orderkey, 'record' AS kind, start AS "offset", (l_orderkey * 100 + rn + 1)::BIGINT AS lsn, l_suppkey AS transaction, CASE WHEN l_suppkey % 3 = 0 THEN 'bitcoin_core' END AS family, NULL AS failure FROM b WHERE NOT broken AND wrongs = 0
UNION ALL SELECT l_orderkey, 'failure', start, NULL, NULL, NULL, 'lfs_record_type_unknown' FROM b WHERE NOT broken AND wrong AND wrongs = 1
UNION ALL SELECT DISTINCT l_orderkey, 'failure', {PAGE}, NULL, NULL::BIGINT, NULL, 'lfs_usa_mismatch' FROM b WHERE broken""")
def log_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as log records, six to a page behind a restart page, in chunks of 200 bytes: pages with broken sectors and records of no type among them."""
    l = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    rn = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber")) - 1
    l = l.withColumn("rn", rn).withColumn("page", F.floor(F.col("rn") / ON_PAGE))
    name = F.when(F.col("l_suppkey") % 3 == 0, "wallet.dat").otherwise("notes.doc\0")
    record = F.concat(
        _bytes(F.col("l_orderkey") * 100 + F.col("rn") + 1, 8), zeros(16), _bytes(F.lit(20), 4), _bytes(F.lit(3), 4), _bytes(F.when(F.col("l_partkey") % 13 == 0, 9).otherwise(1), 4),
        _bytes(F.col("l_suppkey"), 4), zeros(8), utf16(name), zeros(RECORD - HEAD - 20),
    )
    g = l.select("l_orderkey", "page", "rn", record.alias("r")).groupBy("l_orderkey", "page").agg(joined(F.transform(F.sort_array(F.collect_list(F.struct("rn", "r"))), lambda x: x["r"])).alias("body"))
    number = F.lit(b"\x07\x01")
    end = F.when((F.col("l_orderkey") % 11 == 0) & (F.col("page") == 0), F.lit(b"\xff\xff")).otherwise(number)
    page = F.concat(
        F.lit(b"RCRD\x28\x00\x02\x00"), zeros(16), _bytes(HEAD + F.length("body"), 2), zeros(14), number, zeros(6), F.col("body"), zeros(PAGE - 2 - HEAD - F.length("body")), end
    )
    first = b"RSTR\x28\x00\x02\x00" + bytes(8) + PAGE.to_bytes(4, "little") * 2 + HEAD.to_bytes(2, "little") + bytes(14) + b"\x07\x01" + bytes(6)
    first += bytes(20) + b"\x2c\x00" + bytes(14) + HEAD.to_bytes(2, "little") * 2
    pages = g.select("l_orderkey", "page", page.alias("r")).groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("page", "r"))).alias("pages"))
    blob = F.concat(F.lit(first + bytes(PAGE - 2 - len(first)) + b"\x07\x01"), joined(F.transform("pages", lambda x: x["r"])))
    found = carry.carried(chunked(pages.select("l_orderkey", blob.alias("blob")), "l_orderkey", 200, F.lit(False)), ["l_orderkey"], journals.Log)
    found = found.where("kind IN ('record', 'failure')")
    return found.select("l_orderkey", "kind", "offset", F.col("lsn").cast("long").alias("lsn"), "transaction", F.get("evidence", F.lit(0))["family"].alias("family"), "failure")


# --- UTF-16 runs --------------------------------------------------------------------------------------


@query("""
WITH s AS (SELECT o_custkey, o_orderkey, o_orderkey % 9 AS n, (' ' || o_orderkey || '-' || o_orderpriority)[:o_orderkey % 9] AS text FROM orders),
p AS (SELECT *, 2 * (sum(length(text) + 1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - length(text) - 1) AS start FROM s)
SELECT o_custkey, start::BIGINT AS "offset", length(text)::INTEGER AS characters FROM p WHERE length(text) >= 4""")
def utf16_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of a customer's orders in UTF-16 between zeros, in chunks of 37 bytes that cut characters too: runs of four and more, without those of the other parity within them."""
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    text = F.left(F.concat(F.lit(" "), F.col("o_orderkey").cast("string"), F.lit("-"), "o_orderpriority"), F.col("o_orderkey") % 9)
    d = o.select("o_custkey", "o_orderkey", F.concat(utf16(text), zeros(2)).alias("r"))
    streams = d.groupBy("o_custkey").agg(joined(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "r"))), lambda x: x["r"])).alias("blob"))
    return carry.maximal_runs(chunked(streams, "o_custkey", 37, F.lit(False)), ["o_custkey"]).select("o_custkey", "offset", "characters")


# --- streams through extents --------------------------------------------------------------------------

BLOCK = 64
#: Ranges of every stream that are asked for.
ASKED = ((0, 0, 16), (1, 40, 120), (2, 104, 400))


@query(f"""
WITH b AS (SELECT DISTINCT o_orderkey AS block FROM orders),
l AS (SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, 8 * (1 + l_partkey % 3 + l_linenumber % 5) AS n, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) AS rn FROM lineitem),
e AS (SELECT l_partkey, sum(n) OVER (PARTITION BY l_partkey ORDER BY rn)::BIGINT - n AS logical, n, CASE WHEN l_suppkey % 10 <> 0 THEN l_orderkey * {BLOCK} + l_linenumber % 8 * 8 END AS physical FROM l),
a AS (SELECT l_partkey, id, low, high FROM (SELECT DISTINCT l_partkey FROM lineitem), (VALUES {", ".join(map(str, ASKED))}) r(id, low, high)),
w AS (SELECT l_partkey, id, unnest(range(low, high, 8)) AS pos FROM a),
x AS (SELECT w.l_partkey, w.id, w.pos, e.logical, e.physical + w.pos - e.logical AS p FROM w LEFT JOIN e ON e.l_partkey = w.l_partkey AND e.logical <= w.pos AND w.pos < e.logical + e.n),
y AS (SELECT x.*, b.block IS NOT NULL AS there, printf('%016X', p // {BLOCK} * 1000 + p % {BLOCK} // 8) AS h FROM x LEFT JOIN b ON b.block = p // {BLOCK}),
g AS (SELECT l_partkey, id, bool_or(p IS NULL) AS gap, bool_and(there) AS there, count(DISTINCT logical) AS n, string_agg(array_to_string(list_transform([15, 13, 11, 9, 7, 5, 3, 1], lambda i: substr(h, i, 2)), ''), '' ORDER BY pos) AS bytes FROM y GROUP BY l_partkey, id)
SELECT l_partkey, id, CASE WHEN gap THEN 1 ELSE n END AS pieces, CASE WHEN gap THEN 'logical_stream_gap_or_sparse' WHEN NOT there THEN 'short_image_read' END AS failure, CASE WHEN NOT gap AND there THEN md5(bytes) END AS digest FROM g""")
def extent_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of streams whose extents lie in a source of blocks: sparse extents, ranges beyond a stream and blocks that are missing give their reason."""
    from ..sources import extents as source

    l = read(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey")
    n = (8 * (1 + F.col("l_partkey") % 3 + F.col("l_linenumber") % 5)).cast("long")
    logical = F.sum("length").over(Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey").rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")
    physical = F.when(F.col("l_suppkey") % 10 != 0, F.col("l_orderkey") * BLOCK + F.col("l_linenumber") % 8 * 8)
    e = l.withColumn("length", n).withColumns({"logical": logical, "physical": physical}).select("l_partkey", "logical", "physical", "length")
    asked = F.explode(F.array(*(F.struct(F.lit(i).alias("id"), F.lit(a).cast("long").alias("start"), F.lit(b).cast("long").alias("end")) for i, a, b in ASKED)))
    ranges = l.select("l_partkey").distinct().select("l_partkey", asked.alias("r")).select("l_partkey", "r.*")
    found = source.pieces(ranges, e, ["l_partkey"], 4096).withColumn("source", F.lit(0))
    orders = read(spark, sf_dir, "orders").select("o_orderkey").distinct()
    data = F.concat(*(_bytes(F.col("o_orderkey") * 1000 + i, 8) for i in range(BLOCK // 8)))
    blocks = orders.select(F.lit(0).alias("source"), F.col("o_orderkey").alias("block"), data.alias("data"))
    got = source.read_blocks(found, blocks, ["source"], ["l_partkey", "id", "logical_start"], BLOCK)
    # a range's pieces are few and bounded by its length
    g = got.groupBy("l_partkey", "id").agg(F.count("*").alias("pieces"), F.max("failure").alias("failure"), F.array_sort(F.collect_list(F.struct("logical_start", F.hex("data").alias("h")))).alias("parts"))
    digest = F.md5(F.array_join(F.transform("parts", lambda x: x["h"]), "").cast("binary"))
    return g.select("l_partkey", "id", "pieces", "failure", F.when(F.col("failure").isNull(), digest).alias("digest"))


# --- directory indexes --------------------------------------------------------------------------------

INDEX, ENTRY, ENTRIES, IN_USE = 1024, 88, 7, 4
ENTRIES_SQL = f"""
l AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber % 10 AS digit, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber) - 1 AS rn FROM lineitem),
p AS (SELECT *, rn // {ENTRIES} AS block, rn % {ENTRIES} AS i, l_partkey % 13 = 0 AS wrong FROM l),
b AS (SELECT l_orderkey, block, least(count(*), {IN_USE}) AS used, bool_or(wrong AND i < {IN_USE}) AS wrong, l_orderkey % 11 = 0 AS broken, l_orderkey % 17 = 0 AS misplaced FROM p GROUP BY l_orderkey, block),
f AS (SELECT *, CASE WHEN broken THEN 'update_sequence_mismatch' WHEN misplaced THEN 'indx_vcn_invalid' WHEN wrong THEN 'index_entry_bounds_invalid' END AS failure FROM b)"""


def index_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as index blocks of seven entries, of which four are in use: source_id, offset, data and vcn. Some blocks are broken, misplaced, or hold a wrong entry."""
    l = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    rn = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber")) - 1
    l = l.withColumns({"rn": rn}).withColumns({"block": F.floor(F.col("rn") / ENTRIES), "i": F.col("rn") % ENTRIES})
    length = F.when(F.col("l_partkey") % 13 == 0, 4).otherwise(ENTRY)
    name = F.concat(F.lit("w"), (F.col("l_linenumber") % 10).cast("string"))
    entry = F.concat(
        _bytes(F.col("l_partkey"), 6), _bytes(F.lit(1), 2), _bytes(length, 2), _bytes(F.lit(70), 2), zeros(4), _bytes(F.col("l_suppkey"), 6), _bytes(F.lit(3), 2), zeros(56), F.lit(b"\x02\x01"), utf16(name), zeros(ENTRY - 16 - 70)
    )
    g = l.select("l_orderkey", "block", "i", entry.alias("e")).groupBy("l_orderkey", "block").agg(F.array_sort(F.collect_list(F.struct("i", "e"))).alias("es"))
    part = lambda of: joined(F.transform(of, lambda x: x["e"]))
    used = F.least(F.size("es"), F.lit(IN_USE))
    last = F.lit(bytes(8) + b"\x10\x00\x00\x00\x02\x00\x00\x00")
    entries = F.concat(part(F.slice("es", 1, IN_USE)), last, part(F.slice("es", IN_USE + 1, ENTRIES)))
    vcn = F.col("block") + F.when(F.col("l_orderkey") % 17 == 0, 1).otherwise(0)
    body = F.concat(zeros(8), _bytes(vcn, 8), _bytes(F.lit(40), 4), _bytes(40 + 16 + ENTRY * used, 4), _bytes(F.lit(INDEX - 24), 4), zeros(4), zeros(24), F.col("x"))
    d = g.select("l_orderkey", "block", "es", entries.alias("x"))
    d = d.select("l_orderkey", "block", F.concat(F.lit(b"INDX\x28\x00\x03\x00"), body, zeros(INDEX - 64 - F.length("x"))).alias("d"))
    cut = lambda a, n: F.substring("d", a + 1, n)
    number = F.lit(b"\x09\x01")
    end = F.when(F.col("l_orderkey") % 11 == 0, F.lit(b"\xee\xee")).otherwise(number)
    data = F.concat(cut(0, 40), number, cut(510, 2), cut(1022, 2), cut(46, 464), number, cut(512, 510), end)
    return d.select(F.col("l_orderkey").cast("string").alias("source_id"), (F.col("block") * INDEX).alias("offset"), data.alias("data"), F.col("block").alias("vcn"))


@query(f"""
WITH {ENTRIES_SQL}
SELECT f.l_orderkey::VARCHAR AS source_id, f.block * {INDEX} AS "offset", CASE WHEN i < {IN_USE} THEN 'active' ELSE 'slack' END AS state, 64 + i * {ENTRY} + CASE WHEN i >= {IN_USE} THEN 16 ELSE 0 END AS entry_offset,
       l_partkey AS file, l_suppkey AS parent, 'w' || digit AS name, NULL AS failure
FROM f JOIN p ON p.l_orderkey = f.l_orderkey AND p.block = f.block WHERE failure IS NULL AND NOT p.wrong
UNION ALL SELECT l_orderkey::VARCHAR, block * {INDEX}, NULL, NULL, NULL, NULL, NULL, failure FROM f WHERE failure IS NOT NULL""")
def directory_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries in use and in the slack of index blocks, and why blocks are refused."""
    from ..functions import indexes

    found = indexes.index_blocks(index_blobs(spark, sf_dir))
    return found.select("source_id", "offset", F.explode_outer("entries").alias("e"), "failure").select("source_id", "offset", "e.state", "e.entry_offset", "e.file", "e.parent", "e.name", "failure").where("state IS NOT NULL OR failure IS NOT NULL")


@query(f"""
WITH {ENTRIES_SQL}
SELECT l_orderkey::VARCHAR AS source_id, block * {INDEX} AS "offset", CASE WHEN broken OR wrong THEN NULL ELSE {INDEX} END AS block_size, CASE WHEN broken OR wrong THEN 0 ELSE used + (SELECT count(*) FROM p WHERE p.l_orderkey = f.l_orderkey AND p.block = f.block AND i >= {IN_USE} AND NOT p.wrong) END AS n,
       CASE WHEN NOT (broken OR wrong) THEN CASE WHEN l_orderkey % 4 = 2 AND NOT misplaced THEN 'content_matches_current_indx' ELSE 'content_differs_current_indx' END END AS comparison,
       CASE WHEN broken OR wrong THEN 'update_sequence_shape' END AS failure
FROM f WHERE NOT (l_orderkey % 4 = 0)""")
def stale_index_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index blocks that no directory holds, tried as blocks of two sizes: those at places in use are left out, some others say what a block in use says."""
    from ..functions import indexes
    from ..operators.store import materialize

    blobs = materialize(index_blobs(spark, sf_dir), "blobs")
    order = F.col("source_id").cast("long")
    used = indexes.index_blocks(blobs.where(order % 2 == 0))
    current = used.withColumn("offset", F.when(order % 4 == 0, F.col("offset")).otherwise(-1))
    sizes = blobs.select("source_id").distinct().select("source_id", F.explode(F.array(*(F.struct(F.lit(n).alias("block_size"), F.lit(n).alias("cluster")) for n in (INDEX, 512)))).alias("s")).select("source_id", "s.*")
    out = indexes.stale_blocks(blobs, current, sizes)
    return out.select("source_id", "offset", "block_size", F.size("entries").cast("long").alias("n"), "comparison", "failure")


# --- volumes that no table names ----------------------------------------------------------------------

SECTOR, SECTORS, MFT, MIRROR, FILE = 512, 64, 4, 20, 1024
NAMED = "source_id, volume_start, cluster_size, record_size, volume_end, boot_copies, boot_pair, mft_valid, mirror_valid, classification, strength"
#: A source for each order: which boot sectors, file tables and mirrors there are, how large it is, and whether its volume is known.
VOLUMES_SQL = f"""
o AS (SELECT o_orderkey::VARCHAR AS source_id, o_orderkey AS k, 4096 * (1 + o_orderkey % 3) AS base, CASE WHEN o_orderkey % 2 = 0 THEN 512 ELSE 1024 END AS cluster FROM orders),
h AS (SELECT source_id, k, base, cluster, {SECTORS} AS sectors, k % 5 <> 0 AS front, k % 3 <> 0 AS back, k % 7 <> 0 AS table_there, k % 11 = 0 AS mirror_there, CASE WHEN k % 13 = 0 THEN base + 20000 ELSE base + 40000 END AS size, k % 17 = 0 AS known FROM o),
v AS (SELECT *, base AS volume_start, front AS p, back AS b FROM h WHERE front OR back
      UNION ALL SELECT *, base - {SECTORS - 1} * {SECTOR}, false, true FROM h WHERE front AND base - {SECTORS - 1} * {SECTOR} >= 0
      UNION ALL SELECT *, base + {SECTORS - 1} * {SECTOR}, true, false FROM h WHERE back),
w AS (SELECT source_id, volume_start, cluster::BIGINT AS cluster_size, {FILE}::BIGINT AS record_size, volume_start + {SECTORS * SECTOR} AS volume_end, p::INTEGER + b::INTEGER AS boot_copies, p AND b AS boot_pair,
      volume_start = base AND table_there AS mft_valid, volume_start = base AND mirror_there AS mirror_valid, size, known AND volume_start = base AS is_current FROM v),
c AS (SELECT *, mft_valid OR mirror_valid OR boot_pair AS told, CASE WHEN is_current THEN 'current' WHEN (mft_valid OR mirror_valid OR boot_pair) AND volume_end <= size THEN 'detached' ELSE 'boot_only_unconfirmed' END AS classification FROM w),
d AS (SELECT source_id, volume_start, cluster_size, record_size, volume_end, boot_copies::BIGINT AS boot_copies, boot_pair, mft_valid, mirror_valid, classification,
      CASE WHEN classification = 'detached' THEN 'detached_volume_structural' WHEN told THEN 'geometry_correlated' ELSE 'boot_structural' END AS strength FROM c)"""


def volume_sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Boot sectors as blobs, file records, sizes and known volumes of a source an order."""
    k = F.col("o_orderkey")
    o = read(spark, sf_dir, "orders").select("o_orderkey", k.cast("string").alias("source_id"), (4096 * (1 + k % 3)).alias("base"), F.when(k % 2 == 0, 1).otherwise(2).alias("per"))
    boot = F.concat(F.lit(b"\xeb\x52\x90NTFS    "), _bytes(F.lit(SECTOR), 2), _bytes(F.col("per"), 1), zeros(26), _bytes(F.lit(SECTORS), 8), _bytes(F.lit(MFT), 8), _bytes(F.lit(MIRROR), 8), F.lit(b"\xf6\0\0\0\xf4\0\0\0"), _bytes(k + 1, 8), zeros(430), F.lit(b"\x55\xaa"))
    places = F.array_compact(F.array(F.when(k % 5 != 0, F.col("base")), F.when(k % 3 != 0, F.col("base") + (SECTORS - 1) * SECTOR)))
    boots = o.select("source_id", F.explode(places).alias("offset"), boot.alias("data"))
    cluster = F.col("per") * SECTOR
    # the table's record 0 and records 1 and 5 behind it, one out of place, the mirror's record 0, a stale one
    at = lambda n: F.col("base") + MFT * cluster + n * FILE
    extents = F.array(F.struct(F.lit(0).cast("long").alias("logical"), F.lit(MFT).cast("long").alias("cluster"), F.floor(8192 / cluster).alias("length")))
    row = lambda there, offset, record: F.when(there, F.struct(offset.alias("offset"), F.lit(record).cast("long").alias("record")))
    rows = F.array_compact(F.array(
        row(k % 7 != 0, at(0), 0), row(F.lit(True), at(1), 1), row(F.lit(True), at(5), 6), row(k % 11 == 0, F.col("base") + MIRROR * cluster, 0), row(F.lit(True), F.col("base") + 30 * SECTOR + FILE * 5, 9),
    ))
    r = o.select("source_id", "per", F.explode(rows).alias("r"), extents.alias("extents")).select(
        "source_id", "r.*", F.lit(1).alias("sequence"), F.lit(True).alias("allocated"), F.when(F.col("r.record") == 0, F.col("extents")).otherwise(F.slice("extents", 1, 0)).alias("extents"), F.lit(None).cast("string").alias("failure")
    )
    sizes = o.select("source_id", (F.col("base") + F.when(k % 13 == 0, 20000).otherwise(40000)).alias("size"))
    known = o.where(k % 17 == 0).select(
        "source_id", F.col("base").alias("volume_start"), F.lit(SECTOR).alias("sector_size"), cluster.alias("cluster_size"), F.lit(SECTORS).alias("sectors"), F.lit(MFT).alias("mft_cluster"), F.lit(MIRROR).alias("mirror_cluster"),
        F.lit(FILE).alias("record_size"), F.lit(4096).alias("index_size"), (k + 1).alias("serial"),
    )
    return boots, r, sizes, known


def found_volumes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from ..functions import structures
    from ..operators import volumes

    boots, r, sizes, known = volume_sources(spark, sf_dir)
    b = boots.select("source_id", "offset", structures.boot_sector(F.col("data")).alias("boot"))
    return volumes.discovered(b, r, sizes, known), r


@query(f"WITH {VOLUMES_SQL} SELECT {NAMED} FROM d")
def detached_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes that boot sectors propose, in a source an order: with and without their copy, file table and mirror, cut off, known."""
    return found_volumes(spark, sf_dir)[0].select(*NAMED.split(", "))


@query(f"""
WITH {VOLUMES_SQL},
r AS (SELECT source_id, base, cluster, base + {MFT} * cluster + n * {FILE} AS "offset", record FROM h, (VALUES (0, 0), (1, 1), (5, 6)) t(n, record) WHERE record > 0 OR table_there
      UNION ALL SELECT source_id, base, cluster, base + {MIRROR} * cluster, 0 FROM h WHERE mirror_there
      UNION ALL SELECT source_id, base, cluster, base + 30 * {SECTOR} + {FILE} * 5, 9 FROM h)
SELECT r.source_id, d.volume_start, r."offset", r.record::BIGINT AS record,
       CASE WHEN NOT mft_valid OR r."offset" + {FILE} > base + {MFT} * cluster + 8192 OR r."offset" < base + {MFT} * cluster THEN 'detached_stale_file' WHEN r."offset" - base - {MFT} * cluster = record * {FILE} THEN 'detached_logical_mft' ELSE 'detached_misplaced' END AS layer
FROM r JOIN d ON d.source_id = r.source_id AND classification = 'detached' AND d.volume_start <= r."offset" AND r."offset" < d.volume_end""")
def detached_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File records of detached volumes: those in their file tables, those in another's place, and stale ones."""
    from ..operators import volumes

    found, r = found_volumes(spark, sf_dir)
    return volumes.metadata(found, r, 1 << 20).select("source_id", "volume_start", "offset", "record", "layer")


# --- payloads on linked pages -------------------------------------------------------------------------


@query("""
WITH l AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber) AS page FROM lineitem),
n AS (SELECT l_orderkey, count(*) AS n, md5(string_agg(printf('%016X', l_partkey), '' ORDER BY page)) AS digest FROM l GROUP BY l_orderkey),
h AS (SELECT *, 0 AS id FROM n UNION ALL SELECT *, 1 FROM n WHERE l_orderkey % 5 = 4 AND n > 1),
s AS (SELECT l_orderkey, id, n, digest, CASE WHEN l_orderkey % 5 = 3 AND n > 1 THEN 'ambiguous_page' WHEN l_orderkey % 5 = 2 THEN 'cycle' WHEN l_orderkey % 5 = 4 AND n > 1 THEN 'multiple_parents' WHEN l_orderkey % 5 = 1 THEN 'missing_page'
             WHEN l_orderkey % 7 = 0 THEN 'length_mismatch' ELSE 'complete' END AS state FROM h)
SELECT l_orderkey, id, CASE WHEN state = 'multiple_parents' THEN CASE id WHEN 0 THEN 1 ELSE n - 1 END ELSE n END AS pages, state, CASE WHEN state = 'complete' THEN digest END AS digest FROM s""")
def page_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as linked pages of a payload: whole ones, a page that is missing, there twice, led to twice, a chain that comes back, a length that is wrong."""
    from ..operators import graph

    l = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    whole, k = Window.partitionBy("l_orderkey"), F.col("l_orderkey")
    page = F.row_number().over(whole.orderBy("l_partkey", "l_suppkey", "l_linenumber")).cast("long")
    l = l.select("l_orderkey", "l_partkey", page.alias("page"), F.count("*").over(whole).alias("n"))
    end = F.when(k % 5 == 1, 99).when(k % 5 == 2, 1).otherwise(0)
    p = l.select("l_orderkey", "l_partkey", "n", "page", F.when(F.col("page") < F.col("n"), F.col("page") + 1).otherwise(end).cast("long").alias("next"), F.lit(8).cast("long").alias("size"))
    pages = p.unionByName(p.where((k % 5 == 3) & (F.col("page") == 2)))
    heads = l.where("page = 1").select("l_orderkey", F.lit(0).alias("id"), F.lit(1).cast("long").alias("first"), (8 * F.col("n") + F.when(k % 7 == 0, 1).otherwise(0)).alias("length"))
    heads = heads.unionByName(l.where((F.col("page") == 2) & (k % 5 == 4)).select("l_orderkey", F.lit(1).alias("id"), F.lit(2).cast("long").alias("first"), (8 * (F.col("n") - 1)).alias("length")))
    states, placed = graph.chains(heads, pages.select("l_orderkey", "page", "next", "size"), ["l_orderkey"])
    # the parts of a payload are bounded by its length
    good = states.where(F.col("state") == graph.COMPLETE).select("l_orderkey", "id", "first")
    parts = good.join(placed, ["l_orderkey", "first"]).join(p.select("l_orderkey", "page", F.hex(_bytes(F.col("l_partkey"), 8, True)).alias("h")), ["l_orderkey", "page"])
    data = parts.groupBy("l_orderkey", "id").agg(F.array_sort(F.collect_list(F.struct("at", "h"))).alias("parts"))
    digest = F.md5(F.array_join(F.transform("parts", lambda x: x["h"]), "").cast("binary"))
    return states.join(data.select("l_orderkey", "id", digest.alias("digest")), ["l_orderkey", "id"], "left").select("l_orderkey", "id", F.col("n").alias("pages"), "state", "digest")


# --- b-tree pages -------------------------------------------------------------------------------------

LEAF_LINES, FIRST_ITEM, STRIDE = 16, 128, 12


@query(f"""
WITH l AS (SELECT l_orderkey, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber) - 1 AS rn FROM lineitem),
p AS (SELECT l_orderkey, rn // {LEAF_LINES} AS page, rn % {LEAF_LINES} AS i, l_partkey, l_suppkey FROM l),
s AS (SELECT p.*, v, v = 1 AND l_suppkey % 5 = 0 AS big FROM p, (VALUES (0), (1)) t(v))
SELECT l_orderkey::VARCHAR AS source_id, page * 512 AS "offset", page::BIGINT AS page, (2 * i + v)::INTEGER AS slot, CASE WHEN v = 0 THEN 'key' WHEN big THEN 'overflow' ELSE 'value' END AS kind, v = 0 AND l_partkey % 9 = 0 AS deleted,
       CASE WHEN big THEN l_partkey * 100 ELSE 8 END AS length, CASE WHEN big THEN l_suppkey END AS first, NULL AS failure FROM s WHERE l_orderkey % 13 <> 0
UNION ALL SELECT DISTINCT l_orderkey::VARCHAR, page * 512, NULL::BIGINT, NULL::INTEGER, NULL, NULL::BOOLEAN, NULL::BIGINT, NULL::BIGINT, 'slot_bounds_invalid' FROM s WHERE l_orderkey % 13 = 0""")
def btree_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as pairs on leaf pages, big-endian for odd orders: values on the page and on others, deleted keys, slots that lead out of the page."""
    from ..functions import btrees

    l = leaf_lines(spark, sf_dir)
    num = in_order
    key = F.concat(num(F.lit(8), 2), F.when(F.col("l_partkey") % 9 == 0, F.lit(b"\x81")).otherwise(F.lit(b"\x01")), _bytes(F.col("l_partkey"), 8), zeros(1))
    value = F.when(F.col("l_suppkey") % 5 == 0, F.concat(zeros(2), F.lit(b"\x03\x00"), num(F.col("l_suppkey"), 4), num(F.col("l_partkey") * 100, 4))).otherwise(F.concat(num(F.lit(8), 2), F.lit(b"\x01"), _bytes(F.col("l_suppkey"), 8), zeros(1)))
    d = leaf_blobs(l.withColumn("r", F.concat(key, value)), F.when(F.col("l_orderkey") % 13 == 0, 400).otherwise(0))
    blobs = d.select(F.col("l_orderkey").cast("string").alias("source_id"), (F.col("page") * 512).alias("offset"), "data", "big")
    return btrees.btree_items(blobs).select("source_id", "offset", "page", "slot", "kind", "deleted", "length", "first", "failure")


@query(f"""
WITH l AS (SELECT l_orderkey, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber) - 1 AS rn FROM lineitem),
p AS (SELECT l_orderkey, l_partkey, l_suppkey, rn // {LEAF_LINES} AS page, rn % {LEAF_LINES} AS i FROM l)
SELECT l_orderkey || ':' || page AS source_id, l_orderkey % 2 = 1 AS big, page::BIGINT AS page, i::INTEGER AS pair, CASE WHEN l_suppkey % 2 = 0 THEN 'mkey' ELSE 'ckey' END AS record,
       (5000 + 100 + {FIRST_ITEM} + 2 * {STRIDE} * i + 3)::BIGINT AS key_at FROM p WHERE l_orderkey % 13 <> 0 AND l_partkey % 7 <> 0""")
def leaves_without_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as records of leaf pages somewhere in a window: marks that begin no page, empty leaves, and hits that name another record."""
    from ..functions import btrees

    l = leaf_lines(spark, sf_dir)
    name = F.when(F.col("l_suppkey") % 2 == 0, "mkey").otherwise("ckey")
    key = F.concat(in_order(F.lit(8), 2), F.lit(b"\x01\x04"), name.cast("binary"), _bytes(F.col("l_partkey"), 3), zeros(1))
    value = F.concat(in_order(F.lit(8), 2), F.lit(b"\x01"), _bytes(F.col("l_suppkey"), 8), zeros(1))
    l = l.withColumn("r", F.concat(key, value))
    at = F.lit(5000 + 100 + FIRST_ITEM + 3).cast("long") + F.col("i") * (2 * STRIDE)
    hit = F.struct(at.alias("start"), (at + 5).alias("end"), F.when(F.col("l_partkey") % 7 == 0, "key").otherwise(name).alias("name"))
    hits = l.groupBy("l_orderkey", "page").agg(F.array_sort(F.collect_list(hit)).alias("hits"))
    pages = leaf_blobs(l, F.lit(0), F.col("l_orderkey") % 13 == 0).join(hits, ["l_orderkey", "page"])
    before = F.concat(zeros(60), F.lit(btrees.LEAF_MARK), zeros(38))
    w = pages.select(F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("page").cast("string")).alias("source_id"), F.lit(5000).cast("long").alias("offset"), F.concat(before, "data").alias("data"), "hits")
    return btrees.leaves_without_metadata(w).select("source_id", "big", "page", "pair", "record", "key_at")


def in_order(value: Column, n: int) -> Column:
    """The bytes of a number in the row's byte order."""
    return F.when(F.col("big"), _bytes(value, n, True)).otherwise(_bytes(value, n))


def leaf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with the leaf page of their order, their place on it, and the order's byte order."""
    l = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    rn = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber")) - 1
    return l.withColumn("rn", rn).withColumns({"page": F.floor(F.col("rn") / LEAF_LINES), "i": F.col("rn") % LEAF_LINES, "big": F.col("l_orderkey") % 2 == 1})


def leaf_blobs(l: DataFrame, shift: Column, empty: Column | None = None) -> DataFrame:
    """l_orderkey, page, big and data: pages of 512 bytes with the pairs ``r``; the first slot is moved by ``shift``, ``empty`` pages have no slots."""
    g = l.groupBy("l_orderkey", "page", "big").agg(joined(F.transform(F.array_sort(F.collect_list(F.struct("i", "r"))), lambda x: x["r"])).alias("body"))
    n = (F.length("body") / STRIDE).cast("int")
    place = lambda i: F.lit(FIRST_ITEM) + i * STRIDE + F.when(i == 0, shift).otherwise(0)
    slots = joined(F.transform(F.sequence(F.lit(0), n - 1), lambda i: in_order(place(i), 2)))
    count = n if empty is None else F.when(empty, 0).otherwise(n)
    head = F.concat(zeros(8), in_order(F.col("page"), 4), zeros(8), in_order(count, 2), in_order(F.lit(FIRST_ITEM), 2), F.lit(b"\x01\x05"))
    d = g.select("l_orderkey", "page", "big", "body", head.alias("head"), slots.alias("slots"))
    return d.select("l_orderkey", "page", "big", F.concat("head", "slots", zeros(FIRST_ITEM - 26 - F.length("slots")), "body", zeros(512 - FIRST_ITEM - F.length("body"))).alias("data"))



# --- broken file records ------------------------------------------------------------------------------


@query("""
SELECT o_orderkey::VARCHAR AS source_id, o_orderkey % 4294967296 AS record, 'f' || lpad((o_orderkey % 1000)::VARCHAR, 3, '0') AS name, o_custkey AS parent, 1 AS whole, 'attribute_bounds' AS failure
FROM orders WHERE o_orderkey % 3 = 1 AND o_orderkey % 5 <> 0""")
def partial_file_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order as a file record: whole ones, some whose second or first attribute is broken, some with broken sectors. Only the second kind has something that holds."""
    from ..functions import records

    k = F.col("o_orderkey")
    name = F.concat(F.lit("f"), F.lpad((k % 1000).cast("string"), 3, "0"))
    size = F.when(k % 3 == 2, 20).otherwise(104)
    named = F.concat(_bytes(F.lit(0x30), 4), _bytes(size, 4), zeros(8), _bytes(F.lit(74), 4), _bytes(F.lit(24), 2), zeros(2), _bytes(F.col("o_custkey"), 6), _bytes(F.lit(1), 2), zeros(56), F.lit(b"\x04\x01"), utf16(name), zeros(6))
    data = F.concat(_bytes(F.lit(0x80), 4), _bytes(F.when(k % 3 == 1, 20).otherwise(32), 4), zeros(8), _bytes(F.lit(8), 4), _bytes(F.lit(24), 2), zeros(10))
    body = F.concat(named, data, F.lit(b"\xff\xff\xff\xff\0\0\0\0"))
    number = F.lit(b"\x05\x00")
    end = F.when(k % 5 == 0, F.lit(b"\xee\xee")).otherwise(number)
    head = F.concat(F.lit(b"FILE\x30\x00\x03\x00"), zeros(8), _bytes(F.lit(1), 2), zeros(2), _bytes(F.lit(56), 2), _bytes(F.lit(1), 2), _bytes(56 + F.length("body"), 4), zeros(16), _bytes(k % (1 << 32), 4), number, zeros(6))
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").withColumn("body", body)
    blob = F.concat(head, F.col("body"), zeros(510 - 56 - F.length("body")), number, zeros(510), end)
    d = o.select(k.cast("string").alias("source_id"), F.lit(0).cast("long").alias("offset"), blob.alias("data"))
    r = records.partial_records(d)
    return r.select("source_id", "record", F.col("aliases")[0]["name"].alias("name"), F.col("aliases")[0]["parent"].alias("parent"), "whole", "failure")


# --- wallets as literals ------------------------------------------------------------------------------


@query("""
SELECT c_custkey::VARCHAR AS source_id, CASE WHEN c_custkey % 11 = 0 OR c_custkey % 13 = 0 THEN 'refused' WHEN c_custkey % 7 = 0 OR c_custkey % 16 NOT BETWEEN 1 AND 13 THEN 'other' ELSE 'legacy' END AS state,
       CASE WHEN state = 'legacy' THEN CASE WHEN c_custkey % 5 = 0 THEN 'CP1252' ELSE 'UTF_8' END END AS encoding, CASE WHEN state = 'legacy' THEN CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 'FIELD_LEVEL_ENCRYPTED' ELSE 'PLAINTEXT_STRUCTURE' END END AS encryption,
       CASE WHEN state = 'legacy' THEN c_custkey % 16 END AS seed_version, CASE WHEN state = 'legacy' THEN c_custkey % 3 <> 0 END AS watch_only, CASE WHEN state = 'legacy' THEN 1 + c_nationkey % 3 END AS accounts,
       CASE WHEN c_custkey % 13 = 0 THEN 'literal_too_deep' WHEN c_custkey % 11 = 0 THEN 'literal_syntax' END AS failure FROM customer""")
def legacy_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer as an old wallet in a literal: both quotes, long numbers, another encoding, and some that are cut, too deep, of no version or without a key."""
    from ..functions import literals

    k = F.col("c_custkey")
    accounts = F.array_join(F.transform(F.sequence(F.lit(0), F.col("c_nationkey") % 3), lambda i: F.concat(i.cast("string"), F.lit(": {'m/0': (1, 2L,)}"))), ", ")
    key = F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("u'master_public_key': '"), F.sha2(k.cast("string").cast("binary"), 512), F.lit("', ")))
    seed = F.when(k % 3 == 0, F.lit("\"seed\": 'not told', ")).otherwise("")
    deep = F.when(k % 13 == 0, F.lit("'deep': " + "[" * 80 + "]" * 80 + ", ")).otherwise("")
    text = F.concat(
        F.lit("{'seed_version': "), (k % 16).cast("string"), F.lit(", 'use_encryption': "), F.when(k % 2 == 0, "True").otherwise("False"), F.lit(", "), key, seed, deep, F.lit("'accounts': {"), accounts, F.lit("}, 'labels': {'a': '")
    )
    label = F.when(k % 5 == 0, F.lit(b"caf\xe9")).otherwise(F.lit(b"plain"))
    blob = F.concat(text.cast("binary"), label, F.when(k % 11 == 0, F.lit(b"'")).otherwise(F.lit(b"'}}")))
    found = literals.legacy_wallets(read(spark, sf_dir, "customer").select(k.cast("string").alias("source_id"), F.lit(0).cast("long").alias("offset"), blob.alias("data")))
    return found.select("source_id", "state", "encoding", "encryption", F.col("seed_version").cast("long").alias("seed_version"), "watch_only", F.col("accounts").cast("long").alias("accounts"), "failure")
