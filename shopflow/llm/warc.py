"""WARC archives with an externally merged capture index (operator 1).

Writing: one WARC record per page, put together by DataFrame functions and
written by Spark's text writer with the record separator (two line ends) as
line separator, gzip-compressed.  Records of equal payloads (of at least
``LEAST_DUPLICATE`` bytes) are one response, with the smallest page_id, and
revisits that refer to it; a revisit keeps the HTTP headers, so the length
and digest of its full payload, but no payload.

Reading: each task parses whole archive files as a stream, by the records'
Content-Length alone, and checks every response's payload against its digest.

Index: the captures a task has read are one run, sorted by URL key, timestamp
and page and written to the shared folder.  The runs are range-partitioned on
the full sort key (a URL captured very often spreads over ranges), and each
range merges its parts of the runs with a loser tree.  Ranges in turn are the
global order; ``capture_no`` numbers it.

Defined results: a null html is an empty payload; a null url has an empty key
and no target header; line ends in urls are percent-encoded; a null page_id
sorts first, never becomes a response others refer to unless all of the group
are null (then all are responses); rows repeating the smallest page_id of a
group are all responses; extra columns are ignored; empty tables give an
empty index.  Pages without a capture time get one from their page_id.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shopflow.llm.common import materialize, maybe_broadcast, prefix_sums, read_table, stage_path

LEAST_DUPLICATE = 100
RECORDS_PER_FILE = 4000
ROWS_PER_RANGE = 100_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EPOCH = 1704067200  # 2024-01-01, for pages without a capture time
_NO_PAGE = -(1 << 63)

CAPTURE = ("page_id bigint, url string, url_key string, captured string, record_type string, refers_to bigint, "
           "payload_bytes bigint, payload_digest string, file string, record_no bigint")


def default_time(page_id: Column) -> Column:
    """A capture time for pages that have none: page_id seconds into 2024."""
    return F.timestamp_seconds(F.lit(_EPOCH) + F.pmod(F.coalesce(page_id, F.lit(0)), F.lit(31_536_000)))


def warc_date(when: Column) -> Column:
    """A moment in UTC, whatever the session's time zone."""
    moment = F.timestamp_add("SECOND", F.unix_seconds(when), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return F.concat(F.replace(moment.cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))


def records(pages: DataFrame, html: str = "html", url: str = "url", captured: Column | None = None) -> DataFrame:
    """(value): the text of each page's WARC record, without the separator that ends it."""
    when = captured if captured is not None else default_time(F.col("page_id"))
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select("page_id", F.regexp_replace(F.regexp_replace(F.col(url), "\r", "%0D"), "\n", "%0A").alias("url"),
                        body.alias("html"), warc_date(when).alias("at"),
                        F.octet_length(body).cast("bigint").alias("n"), F.sha2(body, 256).alias("digest"))
    large = rows.where(F.col("n") >= LEAST_DUPLICATE)
    # Only payloads that occur more than once take part in the join.
    first = (large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("k"))
                  .where("k > 1 and first is not null").select("digest", "first"))
    rows = rows.join(maybe_broadcast(first), "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))

    def page(c: Column) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">\r\n"))

    return rows.select(F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), page(F.col("page_id")),
        F.lit("WARC-Date: "), F.col("at"), F.lit("\r\n"),
        F.when(F.col("url").isNull(), "").otherwise(F.concat(F.lit("WARC-Target-URI: "), F.col("url"), F.lit("\r\n"))),
        F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"), F.lit("\r\n"),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), page(F.col("first")))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"),
        F.lit("\r\n\r\n"), block).alias("value"))


def write_archives(pages: DataFrame, path: str, **columns) -> str:
    """Write the pages' records as gzip-compressed WARC files under ``path``."""
    (records(pages, **columns).write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
     .option("maxRecordsPerFile", RECORDS_PER_FILE).text(path))
    return path


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels reversed, then path and query, in lower case."""
    if not url:
        return ""
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").removeprefix("www.")
        port = f":{parts.port}" if parts.port and parts.port not in (80, 443) else ""
    except ValueError:
        return url.lower()
    rest = parts.path + (f"?{parts.query}" if parts.query else "")
    return f"{','.join(reversed(host.split('.')))}{port}){rest or '/'}".lower()


_PAGE = re.compile(rb"<urn:page:(-?\d*)>")


def _page_of(value: bytes | None) -> int | None:
    found = _PAGE.match(value or b"")
    return int(found[1]) if found and found[1] else None


def parse_archive(stream, file: str = "") -> Iterator[tuple]:
    """Captures of an uncompressed WARC stream, in ``CAPTURE``'s order."""
    number = 0
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{file}: record {number} does not begin with a version line")
        head = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.partition(b":")
            head[name.strip().lower()] = value.strip()
        block = stream.read(int(head[b"content-length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"{file}: record {number} does not end where its length says")
        http, _, payload = block.partition(b"\r\n\r\n")
        digest = head[b"warc-payload-digest"].removeprefix(b"sha256:").decode()
        kind = head[b"warc-type"].decode()
        size = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
            raise ValueError(f"{file}: record {number} has another payload than its digest says")
        url = head.get(b"warc-target-uri")
        url = url.decode() if url is not None else None
        yield (_page_of(head[b"warc-record-id"]), url, url_key(url), head[b"warc-date"].decode(), kind,
               _page_of(head.get(b"warc-refers-to")), size, digest, file, number)
        number += 1


def _order(capture: tuple) -> tuple:
    return capture[2], capture[3], _NO_PAGE if capture[0] is None else capture[0], capture[8], capture[9]


_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("url_key", pa.string()), ("captured", pa.string()),
                    ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()),
                    ("payload_digest", pa.string()), ("file", pa.string()), ("record_no", pa.int64())])


def _batches(rows: list[tuple], schema: pa.Schema, size: int = 10_000) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), size):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i:i + size]), schema)], schema=schema)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's captures as one sorted run."""
    found = []
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1)):
            with gzip.open(io.BytesIO(content.as_buffer()), "rb") as stream:
                found += parse_archive(io.BufferedReader(stream), path.as_py().rpartition("/")[2])
    found.sort(key=_order)
    run = TaskContext.get().partitionId()
    yield from _batches([(*c, run, i) for i, c in enumerate(found)], _ARROW.append(pa.field("run", pa.int64())).append(pa.field("seq", pa.int64())))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Sorted runs of the captures in the archives under ``path``, written to the shared folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return materialize(files.mapInArrow(_runs, f"{CAPTURE}, run bigint, seq bigint"), "runs")


class LoserTree:
    """k-way merge: inner nodes keep the loser of their match, the winner goes up."""

    def __init__(self, runs: list[Iterator], key: Callable):
        self.runs, self.key = [iter(r) for r in runs], key
        self.k = len(self.runs)
        self.heads = [next(r, None) for r in self.runs]
        self.keys = [None if h is None else key(h) for h in self.heads]
        self.loser = [-1] * max(1, self.k)
        for i in range(self.k):
            self._play(i)

    def _before(self, a: int, b: int) -> bool:
        """Whether run a's head goes before run b's (ended runs go last, ties by run)."""
        x, y = self.keys[a], self.keys[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def _play(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node:
            other = self.loser[node]
            if other < 0:  # first arrival while the tree is built
                self.loser[node] = winner
                return
            if self._before(other, winner):
                self.loser[node], winner = winner, other
            node //= 2
        self.loser[0] = winner

    def __iter__(self):
        if not self.k:
            return
        while (head := self.heads[w := self.loser[0]]) is not None:
            yield head
            self.heads[w] = next(self.runs[w], None)
            self.keys[w] = None if self.heads[w] is None else self.key(self.heads[w])
            self._play(w)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range's parts of the runs, merged; ``place`` counts within the range."""
    runs: dict[int, list] = {}
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns):
            runs.setdefault(row[-2], []).append(row)
    for part in runs.values():
        part.sort(key=lambda row: row[-1])  # a run's own order, whatever order the shuffle brought
    own = TaskContext.get().partitionId()
    schema = _ARROW.append(pa.field("range", pa.int64())).append(pa.field("place", pa.int64()))
    out = []
    for i, row in enumerate(LoserTree([runs[r] for r in sorted(runs)], _order)):
        out.append((*row[:-2], own, i))
        if len(out) == 10_000:
            yield from _batches(out, schema)
            out = []
    yield from _batches(out, schema)


def merge_runs(runs: DataFrame, ranges: int | None = None) -> DataFrame:
    """The captures in global order: ``capture_no`` is the place in it."""
    spark = runs.sparkSession
    ranges = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // ROWS_PER_RANGE))
    key = ["url_key", "captured", F.coalesce("page_id", F.lit(_NO_PAGE)), "file", "record_no"]
    merged = materialize(runs.repartitionByRange(ranges, *key).mapInArrow(_merge, f"{CAPTURE}, range bigint, place bigint"), "index")
    starts = prefix_sums(merged.groupBy("range").agg(F.count(F.lit(1)).alias("n")), "range", "n", "before").select("range", "before")
    return merged.join(maybe_broadcast(starts), "range").withColumn("capture_no", F.col("before") + F.col("place")).drop("range", "place", "before")


def archive_index(pages: DataFrame, path: str | None = None, **columns) -> DataFrame:
    """Write the archives, read them back and merge the index of their captures."""
    spark = pages.sparkSession
    return merge_runs(read_runs(spark, write_archives(pages, path or stage_path(spark, "warc"), **columns)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: a capture per page, as read back from the archives."""
    return archive_index(read_table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "capture_no")
