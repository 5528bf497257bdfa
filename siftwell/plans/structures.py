"""Queries over framed bytes that are made from the tables in SQL, and over words and paths; each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import framing, kernels
from ..operators import intervals
from .catalog import DICTIONARY, RUN_SQL, query, read


def _bytes(value: Column, n: int, big: bool = False) -> Column:
    """The ``n`` bytes of a number."""
    digits = F.lpad(F.hex(value), 2 * n, "0")
    return F.unhex(digits if big else F.concat(*(F.substring(digits, 2 * i + 1, 2) for i in reversed(range(n)))))


def _blobs(rows: DataFrame, blob: Column, *keep: str) -> DataFrame:
    """``keep`` and ``blob`` as a column of its own: a generator keeps its long expression from being copied into every place that reads it."""
    return rows.select(*keep, F.explode(F.array(blob)).alias("blob"))


@query("""
WITH v AS (SELECT o_orderkey, o_orderkey % 4 AS form, o_orderkey * 1009 AS v FROM orders),
w AS (SELECT *, CASE form WHEN 0 THEN v % 253 WHEN 1 THEN v % 65536 WHEN 2 THEN v % 4294967296 ELSE v * 65537 END AS value FROM v)
SELECT o_orderkey, value::BIGINT AS value, CASE form WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 5 ELSE 9 END AS size, CASE form WHEN 0 THEN true WHEN 1 THEN value >= 253 WHEN 2 THEN value >= 65536 ELSE value >= 4294967296 END AS canonical FROM w""")
def compact_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CompactSize numbers in all four forms, longer ones than needed among them."""
    key, form = F.col("o_orderkey"), F.col("o_orderkey") % 4
    v = key * 1009
    blob = F.when(form == 0, _bytes(v % 253, 1)).when(form == 1, F.concat(F.lit(b"\xfd"), _bytes(v % 65536, 2))).when(form == 2, F.concat(F.lit(b"\xfe"), _bytes(v % (1 << 32), 4))).otherwise(F.concat(F.lit(b"\xff"), _bytes(v * 65537, 8)))
    c = _blobs(read(spark, sf_dir, "orders"), blob, "o_orderkey").select("o_orderkey", framing.compact_size(F.col("blob")).alias("c"))
    return c.select("o_orderkey", F.col("c.value").cast("long").alias("value"), "c.size", "c.canonical")


@query("""
WITH n AS (SELECT l_orderkey, l_linenumber, l_partkey, ['key', 'ckey', 'mkey', 'keymeta', 'name', 'tx', 'defaultkey', 'wkey'][l_partkey % 8 + 1] AS name FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN name NOT IN ('name', 'tx') AND l_partkey % 11 <> 0 THEN name END AS record, CASE WHEN name NOT IN ('name', 'tx') AND l_partkey % 11 <> 0 THEN len(name) + 1 END AS size FROM n""")
def record_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record names at the start of keys; unknown names and keys that end within the name are none."""
    names = F.array(*(F.lit(x) for x in ("key", "ckey", "mkey", "keymeta", "name", "tx", "defaultkey", "wkey")))
    name = F.element_at(names, (F.col("l_partkey") % 8 + 1).cast("int"))
    length = F.length(name) + F.when(F.col("l_partkey") % 11 == 0, 40).otherwise(0)
    blob = F.concat(_bytes(length, 1), name.cast("binary"), _bytes(F.col("l_orderkey"), 4))
    r = _blobs(read(spark, sf_dir, "lineitem"), blob, "l_orderkey", "l_linenumber", "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey", framing.record_type(F.col("blob")).alias("r"))
    return r.select("l_orderkey", "l_linenumber", "l_partkey", F.col("r.name").alias("record"), F.col("r.size").alias("size"))


@query("""
WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, (l_orderkey * 127 + l_partkey) % 2097152 AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, v AS value, CASE WHEN v < 128 THEN 1 WHEN v < 16384 THEN 2 ELSE 3 END AS size FROM v""")
def varints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base-128 numbers read back."""
    v = (F.col("l_orderkey") * 127 + F.col("l_partkey")) % (1 << 21)
    low, mid, high = v % 128, F.floor(v / 128) % 128, F.floor(v / 16384)
    blob = F.when(v < 128, _bytes(low, 1)).when(v < 16384, F.concat(_bytes(low + 128, 1), _bytes(mid, 1))).otherwise(F.concat(_bytes(low + 128, 1), _bytes(mid + 128, 1), _bytes(high, 1)))
    l = _blobs(read(spark, sf_dir, "lineitem"), F.concat(blob, F.lit(b"\xff\x01")), "l_orderkey", "l_linenumber", "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey", framing.varint(F.col("blob")).alias("x"))
    return l.select("l_orderkey", "l_linenumber", "l_partkey", "x.value", "x.size")


@query("""
WITH v AS (SELECT p_partkey, p_partkey % 4 AS form, p_partkey * 31 AS v FROM part)
SELECT p_partkey, CASE form WHEN 0 THEN v % 128 WHEN 1 THEN v % 256 WHEN 2 THEN v % 65536 END AS value, CASE form WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 END AS size, CASE form WHEN 0 THEN true WHEN 1 THEN v % 256 >= 128 WHEN 2 THEN v % 65536 >= 256 END AS canonical FROM v""")
def der_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DER lengths, short and long; an indefinite one is none."""
    v, form = F.col("p_partkey") * 31, F.col("p_partkey") % 4
    blob = F.when(form == 0, _bytes(v % 128, 1)).when(form == 1, F.concat(F.lit(b"\x81"), _bytes(v % 256, 1))).when(form == 2, F.concat(F.lit(b"\x82"), _bytes(v % 65536, 2, True))).otherwise(F.lit(b"\x80"))
    d = _blobs(read(spark, sf_dir, "part"), blob, "p_partkey").select("p_partkey", framing.der_length(F.col("blob")).alias("d"))
    return d.select("p_partkey", "d.value", "d.size", "d.canonical")


@query("""
WITH e AS (SELECT o_orderkey, i, (o_orderkey + i) % 3 AS kind, o_custkey + i * 1000 AS first, (o_orderkey + i) % 5 * 100 AS sectors FROM orders, range(0, 4) r(i) WHERE o_orderkey % 10 <> 0)
SELECT o_orderkey, i::INTEGER AS index, kind, first, sectors FROM e WHERE kind <> 0 AND sectors > 0""")
def partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partitions of master boot records, one record an order; a tenth has no signature."""
    key = F.col("o_orderkey")
    entry = lambda i: F.concat(F.lit(b"\0" * 4), _bytes((key + i) % 3, 1), F.lit(b"\0" * 3), _bytes(F.col("o_custkey") + i * 1000, 4), _bytes((key + i) % 5 * 100, 4))
    blob = F.concat(F.lit(b"\0" * 446), *(entry(i) for i in range(4)), F.when(key % 10 == 0, F.lit(b"\0\0")).otherwise(F.lit(b"\x55\xaa")))
    return _blobs(read(spark, sf_dir, "orders"), blob, "o_orderkey").select("o_orderkey", F.explode(framing.mbr(F.col("blob"))).alias("p")).select("o_orderkey", "p.*")


@query("""
SELECT s_suppkey, i::INTEGER AS index, 34 + i * 1000 AS first, 34 + i * 1000 + s_suppkey % 900 AS last FROM supplier, range(0, 6) r(i) WHERE s_suppkey % 5 <> 0 AND i < s_suppkey % 6 + 1 AND (s_suppkey + i) % 4 <> 0""")
def gpt_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partitions of GUID tables, one a supplier; a fifth has no header, and entries without a kind are empty."""
    key = F.col("s_suppkey")
    head = F.concat(F.when(key % 5 == 0, F.lit(b"NO  PART")).otherwise(F.lit(b"EFI PART")), F.lit(b"\0" * 64), _bytes(F.lit(2), 8), _bytes(key % 6 + 1, 4), _bytes(F.lit(128), 4), F.lit(b"\0" * (512 - 88)))
    kind = lambda i: F.when((key + i) % 4 == 0, F.lit(b"\0" * 16)).otherwise(F.lit(b"\x11" * 16))
    entry = lambda i: F.concat(kind(i), F.lit(b"\x22" * 16), _bytes(F.lit(34 + i * 1000), 8), _bytes(34 + i * 1000 + key % 900, 8), F.lit(b"\0" * 80))
    blob = F.concat(F.lit(b"\0" * 512), head, *(entry(i) for i in range(6)))
    return _blobs(read(spark, sf_dir, "supplier"), blob, "s_suppkey").select("s_suppkey", F.explode(framing.gpt(F.col("blob"))).alias("p")).select("s_suppkey", "p.*")


@query("""
WITH a AS (SELECT s_suppkey, s_suppkey * 100 AS base, 512 * (1 + s_suppkey % 3) AS page_size, s_suppkey % 4 AS meta_page, s_suppkey * 90 AS s, s_suppkey * 90 + 6000 AS e FROM supplier)
SELECT s_suppkey, base, page_size::BIGINT AS page_size, k AS page, base + k * page_size AS at FROM a, range(0, 100) r(k) WHERE base + k * page_size >= s AND base + k * page_size < e AND k <> meta_page""")
def page_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places where pages of an anchor's database may lie in a range."""
    key = F.col("s_suppkey")
    s = read(spark, sf_dir, "supplier")
    anchors = s.select("s_suppkey", (key * 100).alias("base"), (512 * (1 + key % 3)).alias("page_size"), (key % 4).alias("meta_page"))
    return framing.page_grid(anchors, s.select("s_suppkey", (key * 90).alias("start"), (key * 90 + 6000).alias("end")), ["s_suppkey"])


_KEY = b"records"
_PADS = ["".join(f"\\x{b ^ x:02X}" for b in _KEY.ljust(64, b"\0")) for x in (0x36, 0x5C)]


@query(f"SELECT doc_id, sha256('{_PADS[1]}'::BLOB || unhex(sha256('{_PADS[0]}'::BLOB || encode(text)))) AS code FROM documents WHERE text IS NOT NULL")
def keyed_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed digests of the documents."""
    return read(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", framing.hmac(_KEY, F.col("text").cast("binary")).alias("code"))


@query("SELECT c_custkey, 'docs\\' || lower(c_mktsegment) || '\\' || lower(replace(c_name, '#', '')) AS path FROM customer")
def path_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of mixed case, slashes and dots, told apart as a case-insensitive volume does."""
    raw = F.concat(F.lit("/Docs//tmp/../"), "c_mktsegment", F.lit("\\./"), F.replace("c_name", F.lit("#"), F.lit("")), F.lit("/"))
    return read(spark, sf_dir, "customer").select("c_custkey", framing.path_identity(raw).alias("path"))


@query("""SELECT event_id, 3::BIGINT AS start, 3 + len(props) AS "end" FROM events WHERE props IS NOT NULL""")
def anchored_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON object around an anchor, in bytes with braces and quotes of other things before and after."""
    blob = F.concat(F.lit('x}{'), "props", F.lit('}"{')).cast("binary")
    rows = read(spark, sf_dir, "events").where("props IS NOT NULL").select("event_id", blob.alias("data"), F.lit(4).cast("long").alias("anchor"))
    return kernels.object_spans(rows, "event_id").select("event_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


#: Languages of the dictionary's words, as bits: English 1, Spanish 2, French 4, German 8.
MASKS = (1, 1, 1, 1, 9, 1, 1, 1, 1, 1, 6, 6, 4, 4, 8, 8, 8, 6, 2, 2)
_MASK_SQL = "CASE w " + " ".join(f"WHEN '{w}' THEN {m}" for w, m in zip(DICTIONARY, MASKS, strict=True)) + " END"


def _windows_sql(n: int) -> str:
    return f"SELECT doc_id, {n} AS words, bit_and(m) OVER (PARTITION BY doc_id, run ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS languages, row_number() OVER (PARTITION BY doc_id, run ORDER BY i) AS k FROM q"


@query(f"""WITH {RUN_SQL},
q AS (SELECT t.doc_id, t.i, {_MASK_SQL} AS m, t.i - row_number() OVER (PARTITION BY t.doc_id ORDER BY t.i) AS run FROM t WHERE w IN ({", ".join(f"'{w}'" for w in DICTIONARY)})),
x AS ({" UNION ALL ".join(_windows_sql(n) for n in (4, 5, 6))})
SELECT doc_id, words, languages::BIGINT AS languages, count(*) AS windows FROM x WHERE k >= words AND languages <> 0 GROUP BY ALL""")
def language_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of four to six dictionary words that share a language, by the languages that all of their words have."""
    masks = F.create_map(*(F.lit(x) for pair in zip(DICTIONARY, MASKS, strict=True) for x in pair))
    tokens = F.filter(F.transform(F.split(F.lower("text"), r"[ \t\n\r]+"), lambda w, i: F.struct(i.alias("i"), masks[w].alias("m"))), lambda t: t["m"].isNotNull())
    t = read(spark, sf_dir, "documents").select("doc_id", F.explode(tokens).alias("t")).select("doc_id", "t.i", F.col("t.m").cast("long").alias("m"))
    t = t.withColumn("run", F.col("i") - F.row_number().over(Window.partitionBy("doc_id").orderBy("i")))
    run = Window.partitionBy("doc_id", "run").orderBy("i")
    shared = F.array(*(F.struct(F.lit(n).alias("words"), F.bit_and("m").over(run.rowsBetween(1 - n, 0)).alias("languages")) for n in (4, 5, 6)))
    x = t.select("doc_id", F.row_number().over(run).alias("k"), shared.alias("x")).select("doc_id", "k", F.inline("x"))
    return x.where("k >= words AND languages <> 0").groupBy("doc_id", "words", "languages").agg(F.count("*").alias("windows"))


@query(f"""WITH {RUN_SQL} SELECT doc_id, count(*) FILTER (length = 4) AS of_four, count(*) FILTER (length = 6) AS of_six FROM r WHERE length IN (4, 6) GROUP BY doc_id""")
def maximal_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of dictionary words that are exactly four or six long as a whole; parts of longer runs don't count."""
    from .catalog import documents_token_runs

    runs = documents_token_runs(spark, sf_dir).where("length IN (4, 6)")
    return runs.groupBy("doc_id").agg(F.count_if(F.col("length") == 4).alias("of_four"), F.count_if(F.col("length") == 6).alias("of_six"))


@query(f"""WITH {RUN_SQL},
g AS (SELECT doc_id, greatest(0, first_token - 40) AS s, first_token + length + 40 AS e FROM r),
f AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM g),
i AS (SELECT *, sum(CASE WHEN s > top THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM f)
SELECT doc_id, min(s)::BIGINT AS start, max(e)::BIGINT AS "end", count(*) AS runs FROM i GROUP BY doc_id, island""")
def run_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of forty words on either side of a run, merged where they touch."""
    from .catalog import documents_token_runs

    r = documents_token_runs(spark, sf_dir)
    around = r.select("doc_id", F.greatest(F.lit(0).cast("long"), F.col("first_token") - 40).alias("start"), (F.col("first_token") + F.col("length") + 40).alias("end"))
    found = intervals.islands(around, ["doc_id"], 0, "end", 1 << 16)
    return found.groupBy("doc_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("runs")).drop("island")


@query()
def normalized_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and length of each document's plain form; SQL has no compatibility form, tests compare with the library."""
    d = read(spark, sf_dir, "documents").select("doc_id", kernels.normalized("text").alias("t"))
    return d.select("doc_id", F.length("t").alias("length"), F.sha2(F.col("t").cast("binary"), 256).alias("fingerprint"))


@query()
def private_key_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Private key shapes in each text table, by what they proved to be; states, places and fingerprints only."""
    out = None
    for name, key, column in (("documents", "doc_id", "text"), ("pages", "page_id", "html"), ("conversations", "conv_id", "text")):
        rows = read(spark, sf_dir, name).select(F.col(key).alias("id"), F.coalesce(F.col(column), F.lit("")).alias("t"))
        found = kernels.private_keys(rows, "id", F.col("t")).groupBy("state").agg(F.count("*").alias("shapes"), F.countDistinct("fingerprint").alias("distinct_valid"))
        part = found.select(F.lit(name).alias("source"), "state", "shapes", "distinct_valid")
        out = part if out is None else out.unionByName(part)
    return out


# --- reports -----------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag AS status, CASE WHEN l_quantity > 25 THEN l_quantity END AS size FROM lineitem")
def report_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings written as a report and read back as a source."""
    from ..operators.store import shared_dir
    from ..sources import reports

    l = read(spark, sf_dir, "lineitem").withColumnsRenamed({"l_returnflag": "status"}).withColumn("size", F.when(F.col("l_quantity") > 25, F.col("l_quantity")))
    path = shared_dir(spark, "report")
    schema = reports.write(l, path, ["l_orderkey", "l_linenumber", "l_partkey", "status", "size"], ["l_orderkey", "l_linenumber", "l_partkey"])
    return reports.read(spark, path, schema)


@query("""
WITH f AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'link' END AS failure FROM orders), g AS (SELECT l_orderkey, count(*) AS n, min(l_linenumber) AS a, max(l_linenumber) + 1 AS b FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey)
SELECT o_orderkey AS source_id, CASE WHEN failure IS NOT NULL THEN 'skipped' WHEN n IS NOT NULL THEN 'found' ELSE 'clean' END AS status, failure, coalesce(n, 0) AS findings, a AS first, b AS last FROM f LEFT JOIN g ON l_orderkey = o_orderkey""")
def folder_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each file, an order, with what was found in it or why it was skipped."""
    from ..sources import reports

    files = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source_id"), F.when(F.col("o_orderstatus") == "P", "link").alias("failure"))
    found = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("source_id"), F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + 1).alias("end"))
    return reports.folder(files, found)


@query("""
WITH p AS (SELECT l_suppkey AS source, l_partkey % 64 AS page, l_partkey % 7 AS kind, l_linenumber % 3 AS level, (l_orderkey + 1) % 64 AS next FROM lineitem),
k AS (SELECT source, page, min(kind) AS kind, min(level) AS level, min(next) AS next FROM p GROUP BY source, page),
l AS (SELECT * FROM k WHERE kind = 5 AND level = 1)
SELECT l.source, l.page, l.page * 4096 AS at, n.page IS NOT NULL AS next_is_leaf FROM l LEFT JOIN l n ON n.source = l.source AND n.page = l.next""")
def leaf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf pages at aligned places of a source, and whether the page that each names next is one too."""
    p = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source"), (F.col("l_partkey") % 64).alias("page"), (F.col("l_partkey") % 7).alias("kind"), (F.col("l_linenumber") % 3).alias("level"), ((F.col("l_orderkey") + 1) % 64).alias("next"))
    k = p.groupBy("source", "page").agg(F.min("kind").alias("kind"), F.min("level").alias("level"), F.min("next").alias("next"))
    leaves = k.where("kind = 5 AND level = 1").select("source", "page", "next")
    named = leaves.select("source", F.col("page").alias("next"), F.lit(True).alias("there"))
    return leaves.join(named, ["source", "next"], "left").select("source", "page", (F.col("page") * 4096).alias("at"), F.coalesce("there", F.lit(False)).alias("next_is_leaf"))
