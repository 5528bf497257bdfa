"""URL filters: host rules, and a list of canonical URLs behind a blocked Bloom filter.

The list is turned into a Bloom filter whose blocks are single 64-bit words, so that one word answers
each probe. The filter is a small table of words; pages that pass it may be listed, and only those go
through the exact hash join with the list, which removes the false positives. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, packed, table

#: (verdict, host, path prefix). A rule holds for its host and all subdomains; the longest that fits wins.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Host labels whose URLs form the query's list.
LISTED_LABELS = ("spam-farm", "cheap-pills")
#: Bits of the filter for each listed URL, and bits set for each of them within its word.
BITS_PER_URL, BITS_SET = 16, 4
#: The filter is broadcast up to so many words of 8 bytes (with its block number 16 MB), and joined by shuffle beyond.
BROADCAST_WORDS = 1 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for a null URL or one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)?", 1)
    return F.translate(raw, UPPER, LOWER), path


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading ``www.``, path without slashes at its end; query and fragment do not count. Null without a host."""
    return F.when(host != "", F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"/+$", "")))


def rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict."""
    name = verdict = F.lit(None).cast("string")
    for kind, at, prefix in sorted(rules, key=lambda x: len(x[1] + x[2])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(prefix)
        name, verdict = F.when(fits, at + prefix).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def _mask(url: Column) -> Column:
    """The bits that ``url`` sets within its word."""
    h, out = F.xxhash64(F.lit("bits"), url), None
    for i in range(BITS_SET):
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
        out = bit if out is None else out.bitwiseOR(bit)
    return out


def bloom(listed: DataFrame, words: int) -> DataFrame:
    """The filter of ``listed(canonical)`` as ``(block, word)``; ``words`` is a power of two."""
    block = F.xxhash64(F.lit("block"), "canonical").bitwiseAND(F.lit(words - 1))
    return listed.select(block.alias("block"), _mask(F.col("canonical")).alias("mask")).groupBy("block").agg(F.bit_or("mask").alias("word"))


def words_for(n: int) -> int:
    return 1 << max(6, (n * BITS_PER_URL // 64).bit_length())


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """``pages`` with host, path, rule, canonical, listed and verdict.

    ``listed(canonical)`` holds distinct canonical URLs. Where no rule fits, a listed URL is blocked and
    any other allowed. A null or odd URL has an empty host and path, fits no rule, is not listed and so
    allowed. A very long URL is judged whole. An empty table stays empty, with an empty list nothing is listed. Columns of
    ``pages`` with the names of the added ones are replaced, others of any name pass through. Repeated rows stay.
    """
    whole, unpack = packed(pages, "url")
    words = words_for(listed.count())
    host, path = parts(F.col("url"))
    out = whole.withColumn("host", host).withColumn("path", path)
    name, verdict = rule(F.col("host"), F.col("path"), rules)
    out = out.withColumn("rule", name).withColumn("_verdict", verdict).withColumn("canonical", canonical(F.col("host"), F.col("path")))
    words_table = bloom(listed, words)
    if words <= BROADCAST_WORDS:
        words_table = F.broadcast(words_table)
    block = F.xxhash64(F.lit("block"), "canonical").bitwiseAND(F.lit(words - 1))
    out = out.withColumn("block", block).join(words_table, "block", "left")
    mask = _mask(F.col("canonical"))
    maybe = F.coalesce(F.col("_verdict").isNull() & (F.col("word").bitwiseAND(mask) == mask), F.lit(False))
    hits = out.where(maybe).join(listed.select("canonical", F.lit(True).alias("listed")), "canonical", "left")
    rest = out.where(~maybe).withColumn("listed", F.lit(False))
    both = hits.withColumn("listed", F.coalesce("listed", F.lit(False))).unionByName(rest)
    both = both.withColumn("verdict", F.coalesce("_verdict", F.when(F.col("listed"), "block").otherwise("allow")))
    return unpack(both, "host", "path", "rule", "canonical", "listed", "verdict")


def listed_urls(pages: DataFrame, labels: Sequence[str] = LISTED_LABELS) -> DataFrame:
    """Distinct canonical URLs of ``pages`` whose host has one of ``labels``."""
    host, path = parts(F.col("url"))
    seen = pages.select(host.alias("host"), path.alias("path"))
    seen = seen.where(F.arrays_overlap(F.split("host", r"\."), F.array(*map(F.lit, labels))))
    return seen.select(canonical(F.col("host"), F.col("path")).alias("canonical")).where("canonical is not null").distinct()


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listed = materialize(listed_urls(pages), "listed")
    return judge(pages, listed).select("page_id", "host", "path", "rule", "verdict", "listed")


SQL = f"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
             regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) AS path FROM u),
c AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/+$', '') END AS canonical FROM h),
listed AS (SELECT DISTINCT canonical FROM c
           WHERE canonical IS NOT NULL AND list_has_any(string_split(host, '.'), [{", ".join(f"'{x}'" for x in LISTED_LABELS)}])),
r AS (SELECT *, CASE {" ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p}'" for _, h, p in sorted(RULES, key=lambda x: -len(x[1] + x[2])))} END AS rule FROM c)
SELECT page_id, host, path, rule,
       CASE {" ".join(f"WHEN rule = '{h + p}' THEN '{v}'" for v, h, p in RULES)}
            WHEN r.canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END AS verdict,
       coalesce(rule IS NULL AND r.canonical IN (SELECT canonical FROM listed), false) AS listed
FROM r
"""
