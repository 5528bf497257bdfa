"""WARC archives of pages: writing, reading back, and a capture index merged from sorted runs.

Writing: Spark's text sink writes one record a row, with the two line ends that close a WARC record as
its line separator; so any store that Spark writes to will do, and a lost task is simply run again.
Reading: every archive file is one row of the binary file source and is cut up by the records' lengths;
its records, sorted by URL key and timestamp, are one run of the index. The runs are dealt out by key
ranges; within a range the runs' parts are merged by a loser tree, so the files of the index, in order,
hold all captures in order.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shared_dir, table

#: Equal payloads of at least so many bytes are stored once.
LEAST_BYTES = 100
#: An archive holds about so many payload bytes. Payloads above LARGE times the mean go to archives of their own kind,
#: so that no archive is longer than LARGE times that, or than a single record.
ARCHIVE_BYTES, LARGE = 32 << 20, 16
#: Repeated payloads are broadcast up to so many (a digest and an id each, so below 100 MB), and joined by shuffle beyond.
BROADCAST_ROWS = 500_000
#: Index entries for each range that is merged.
RANGE_ROWS = 200_000
#: The tables have no capture time: page N counts as captured N seconds after this.
EPOCH = 1_700_000_000

HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
INDEX = "run string, urlkey string, timestamp string, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, offset long, length long"
ORDER = ("urlkey", "timestamp", "page_id")


def _payloads(pages: DataFrame) -> DataFrame:
    html = F.coalesce("html", F.lit(""))
    return pages.select("page_id", "url", html.alias("html")).withColumns({"payload_bytes": F.octet_length("html").cast("long"), "payload_digest": F.sha2(F.col("html").cast("binary"), 256)})


def _line(name: str, value: Column | str) -> Column:
    return F.concat(F.lit(f"{name}: "), value if isinstance(value, Column) else F.lit(value), F.lit("\r\n"))


def record() -> Column:
    """The text of a record, without the two line ends after it, from page_id, url, html, payload_bytes, payload_digest and refers_to."""
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    again = F.col("refers_to").isNotNull()
    block = F.concat(F.lit(HTTP), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"), F.when(again, "").otherwise(F.col("html")))
    date = F.date_format(F.timestamp_seconds(F.lit(EPOCH) + F.coalesce("page_id", F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        _line("WARC-Record-ID", urn("page_id")),
        _line("WARC-Date", date),
        F.coalesce(_line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")), F.lit("")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")),
        F.when(again, F.concat(_line("WARC-Refers-To", urn("refers_to")), _line("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(""),
        _line("Content-Type", "application/http; msgtype=response"),
        _line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )


def write(pages: DataFrame, path: str) -> None:
    """Write a WARC record for each row of ``pages(page_id, url, html)`` to gzipped archives below ``path``.

    Of equal payloads of LEAST_BYTES or more, rows with the smallest page_id are responses (all, should
    the row be repeated) and the others revisit it; rows with a null page_id come last and, where all are
    null, are all responses. A null html is empty; a null url leaves its header out. A very long payload is written
    whole, in an archive for its size. An empty table writes no record. Other columns are ignored.

    What revisits what is decided on ids and digests alone; where these are too many to be broadcast, pages are
    joined by id and digest, so a payload that very many pages share is no single task.
    """
    sums = materialize(_payloads(pages).select("page_id", "payload_bytes", "payload_digest"), "payloads")
    mean, longest = sums.agg(F.avg("payload_bytes"), F.max("payload_bytes")).first()
    firsts = sums.where(F.col("payload_bytes") >= LEAST_BYTES).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    firsts = materialize(firsts.where("n > 1 AND first IS NOT NULL").drop("n"), "firsts")
    if firsts.count() <= BROADCAST_ROWS:
        records = _payloads(pages).join(F.broadcast(firsts), "payload_digest", "left")
    else:
        again = sums.join(firsts, "payload_digest").select(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_digest"), "first").distinct()
        p = _payloads(pages)
        records = p.join(again, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("payload_digest") == F.col("_digest")), "left").drop("_id", "_digest")
    records = records.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))
    # one write for the usual payloads, and one for each power of LARGE above the mean that there are larger ones of
    low, unit = -1, max(int(mean or 0), 100)
    while low < (longest or 0) or low < 0:
        high = unit * LARGE if low < 0 else low * LARGE
        part = records.where((F.col("payload_bytes") > low) & (F.col("payload_bytes") <= high))
        per_file = max(1, ARCHIVE_BYTES // (unit if low < 0 else low))
        part.select(record().alias("value")).write.mode("append").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", per_file).option("compression", "gzip").text(path)
        low = high


def urlkey(url: str | None) -> str | None:
    """Host labels from the last to the first, then path and query: captures of a site stand together."""
    if url is None or "://" not in url:
        return url
    host, tail = re.match(r"([^/?#]*)([^#]*)", url.split("://", 1)[1], re.S).groups()
    return ",".join(reversed(host.lower().split("."))) + ")" + (tail or "/")


def records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, length, headers and block of each record of an archive's bytes."""
    at = 0
    while at < len(data):
        head = data.index(b"\r\n\r\n", at)
        lines = data[at:head].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no record at {at}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        end = head + 4 + int(headers["Content-Length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"record at {at} is cut short")
        yield at, end - at, headers, data[head + 4 : end]
        at = end + 4


def _page(urn: str | None) -> int | None:
    return int(urn[10:-1]) if urn and urn != "<urn:page:>" else None


def entry(run: str, offset: int, length: int, headers: dict[str, str], block: bytes) -> tuple:
    """The index entry of a record; a response's payload must have its digest."""
    http, payload = block.split(b"\r\n\r\n", 1)
    size, digest = int(http.rsplit(b": ", 1)[1]), headers["WARC-Payload-Digest"].removeprefix("sha256:")
    if headers["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of {headers['WARC-Record-ID']} is damaged")
    return (run, urlkey(headers.get("WARC-Target-URI")), headers["WARC-Date"], _page(headers["WARC-Record-ID"]), headers["WARC-Type"], _page(headers.get("WARC-Refers-To")), size, digest, offset, length)


def _key(row: tuple) -> tuple:
    """Order of index entries; nulls first, as Spark sorts them."""
    return tuple((x is not None, x if x is not None else 0) for x in row[1:4])


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [x.split()[0] for x in INDEX.split(", ")]
    return pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})


def _runs(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            rows = [entry(path, *x) for x in records(zlib.decompress(content, 31))]
            if rows:
                yield _frame(sorted(rows, key=_key))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Index entries of all archives below ``path``; each archive's are a run in order. A record without a page_id or url has null ones. No archive gives no rows."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return files.mapInPandas(_runs, INDEX)


class LoserTree:
    """Merge of sorted lists: each inner node keeps the loser of its match, so the next row costs one walk from leaf to root."""

    def __init__(self, lists: list[list[tuple]]):
        self.lists, self.n = lists, max(1, len(lists))
        self.at = [0] * self.n
        self.heads = [self._head(i) for i in range(self.n)]
        self.tree = [-1] * self.n
        for i in range(self.n):
            self._play(i)

    def _head(self, i: int) -> tuple:
        rows = self.lists[i] if i < len(self.lists) else []
        return (0, _key(rows[self.at[i]]), i) if self.at[i] < len(rows) else (1,)

    def _play(self, i: int) -> None:
        node = (i + self.n) // 2
        while node > 0:
            if self.tree[node] == -1:
                self.tree[node] = i
                return
            if self.heads[self.tree[node]] < self.heads[i]:
                self.tree[node], i = i, self.tree[node]
            node //= 2
        self.tree[0] = i

    def __iter__(self) -> Iterator[tuple]:
        while len(self.heads[i := self.tree[0]]) > 1:
            yield self.lists[i][self.at[i]]
            self.at[i] += 1
            self.heads[i] = self._head(i)
            self._play(i)


def _merged(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    runs: dict[str, list[tuple]] = {}
    for batch in batches:
        batch = batch.astype(object).where(batch.notna(), None)
        for row in batch.itertuples(index=False, name=None):
            runs.setdefault(row[0], []).append(row)
    out: list[tuple] = []
    for row in LoserTree(list(runs.values())):
        out.append(row)
        if len(out) == 10_000:
            yield _frame(out)
            out = []
    if out:
        yield _frame(out)


def index(spark: SparkSession, path: str) -> DataFrame:
    """All captures below ``path`` in order of URL key, timestamp and page_id, across its partitions; repeated ones are all there. No archive gives no rows."""
    runs = materialize(read(spark, path), "runs")
    ranges = -(-runs.count() // RANGE_ROWS) or 1
    return runs.repartitionByRange(ranges, *ORDER).sortWithinPartitions("run", *ORDER).mapInPandas(_merged, INDEX)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    return index(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {LEAST_BYTES} AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {LEAST_BYTES} AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""
