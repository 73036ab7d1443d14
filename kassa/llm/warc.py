"""WARC archives with revisit records and a globally ordered capture index.

Writing: one WARC/1.1 record per page. Of the pages with equal payloads the one
with the largest id is a ``response``; the others are ``revisit`` records that
refer to it. Records are text rows of Spark's committed writer (gzip files).

Index: every archive is parsed in one task into a *run* of captures sorted by
URL key, timestamp, page id and place. The runs are merged externally: ranges
of that key are dealt to tasks by Spark's sampled range partitioning, and each
task merges the pieces of the k runs that fall into its range with a loser tree
(Knuth, TAOCP 3, 5.4.1). The parts in order are the global capture histories.

Scale: the payloads shuffle once (to meet their digest group's response id,
one row per digest after map-side maxima; a hot digest is a skew join that AQE
splits). The index holds one short row per capture; its range key is unique, so
a URL with a third of all captures is spread over many ranges.

Edge cases: a null payload is empty; a null URL is ``urn:kassa:none``; repeated
rows of the response's page are responses all; a null page id revisits the
group's response, or is a response when its group has no id; control and space
characters in a URL are percent-encoded in the header; other columns are not
archived.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kassa.llm.sinks import read_bytes, write_bytes
from kassa.session import scratch_path

CRLF = "\r\n"
NO_URL = "urn:kassa:none"
EPOCH = "2024-01-01 00:00:00"
YEARS = 10 * 365 * 86400         # capture times repeat after so many seconds
RECORDS_PER_FILE = 4000
INDEX = ("urlkey string, timestamp string, page_id long, file string, offset long, length long, "
         "url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def capture_time(page_id: Column) -> Column:
    """A capture time for tables without one: a second a page."""
    return F.timestamp_seconds(F.unix_timestamp(F.lit(EPOCH).cast("timestamp"))
                               + F.pmod(F.coalesce(page_id, F.lit(0)), F.lit(YEARS)))


def _base32(hex_digest: Column) -> Column:
    """Bare base32 of a 160-bit hex digest: 8 groups of 20 bits, 4 letters each."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    letters = []
    for group in range(8):
        bits = F.conv(F.substring(hex_digest, 5 * group + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(alphabet), F.shiftright(bits, s).bitwiseAND(F.lit(31)) + 1, F.lit(1))
                    for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html",
            least_bytes: int = 0) -> DataFrame:
    """``record``: the whole WARC record of every page, but for its last line feed."""
    p = pages.select(F.col(page_id).cast("bigint").alias("id"), F.col(url).alias("url"),
                     F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("body"))
    p = p.withColumn("n", F.octet_length("body")).withColumn("sha", F.sha1(F.col("body").cast("binary")))
    newest = (p.where(F.col("n") >= least_bytes).groupBy("sha")
              .agg(F.max("id").alias("response"), F.count(F.lit(1)).alias("copies"))
              .where("copies > 1").select(F.col("sha").alias("k"), "response"))
    p = p.join(newest, F.col("sha") == F.col("k"), "left")
    refers = F.when(F.col("response").isNotNull() & (F.coalesce(F.col("id") != F.col("response"), F.lit(True))),
                    F.col("response"))
    p = p.withColumn("refers", refers)
    stamp = F.date_format(capture_time(F.col("id")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    uri = F.regexp_replace(F.coalesce(F.col("url"), F.lit(NO_URL)), r"[\x00-\x20\x7F]", "%20")
    urn = lambda c: F.concat(F.lit("<urn:kassa:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    revisit = F.col("refers").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.col("n").cast("string"), F.lit(CRLF + CRLF))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("body")))
    profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    extra = F.when(revisit, F.concat(F.lit(f"WARC-Refers-To: "), urn(F.col("refers")),
                                     F.lit(f"{CRLF}WARC-Profile: {profile}{CRLF}"))).otherwise(F.lit(""))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(f"{CRLF}WARC-Record-ID: "), urn(F.col("id")), F.lit(f"{CRLF}WARC-Date: "), stamp,
        F.lit(f"{CRLF}WARC-Target-URI: "), uri, F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"),
        _base32(F.col("sha")), F.lit(CRLF), extra,
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}Content-Length: "),
        F.octet_length(block).cast("string"), F.lit(CRLF + CRLF))
    return p.select(F.concat(head, block, F.lit("\r\n\r")).alias("record"))


def write_archives(pages: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE,
                   **columns) -> None:
    """Gzip archives of at most ``records_per_file`` records under ``path``."""
    write_bytes(records(pages, **columns), path, "record", records_per_file, "gzip")


def url_key(url: str) -> str:
    """Sort-friendly URL key: reversed host, then lower-case path and sorted query."""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").lower()
        port = f":{parts.port}" if parts.port and parts.port not in (80, 443) else ""
    except ValueError:
        return url.lower()
    if not host:
        return url.lower()
    host = re.sub(r"^www\d*\.", "", host)
    query = "&".join(sorted(parts.query.lower().split("&"))) if parts.query else ""
    return (",".join(reversed(host.split("."))) + port + ")" + (parts.path.lower() or "/")
            + (f"?{query}" if query else ""))


def parse_archive(raw: bytes) -> Iterator[tuple[int, int, dict[str, str], memoryview]]:
    """``offset, length, headers, block`` of every record of a WARC file."""
    view, at = memoryview(raw), 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        lines = raw[at:end].decode().split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        start = end + 4
        stop = start + int(headers["Content-Length"])
        if raw[stop:stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} does not end where it says")
        yield at, stop + 4 - at, headers, view[start:stop]
        at = stop + 4


def _page(urn: str | None) -> int | None:
    value = urn.rsplit(":", 1)[1].rstrip(">") if urn else "null"
    return None if value == "null" else int(value)


def _capture(file: str, at: int, length: int, headers: dict, block: memoryview) -> tuple:
    raw = block.tobytes()
    split = raw.index(b"\r\n\r\n") + 4
    http = dict(x.split(": ", 1) for x in raw[:split - 4].decode().split(CRLF)[1:])
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    kind, size = headers["WARC-Type"], int(http["Content-Length"])
    if kind == "response":
        body = raw[split:]
        if len(body) != size or base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
            raise ValueError(f"{file}: payload at byte {at} is not the one its header names")
    url = headers["WARC-Target-URI"]
    return (url_key(url), re.sub(r"\D", "", headers["WARC-Date"]), _page(headers["WARC-Record-ID"]),
            file, at, length, url, size, digest, kind, _page(headers.get("WARC-Refers-To")))


def sort_key(row: tuple) -> tuple:
    """URL key, time, page id (none first), then file and offset, which no two
    captures share."""
    return row[0], row[1], row[2] is not None, row[2] or 0, row[3], row[4]


_NAMES = [f.split(" ")[0] for f in INDEX.split(", ")]
_TYPES = {"string": pa.string(), "long": pa.int64()}
_ARROW = pa.schema([(f.split(" ")[0], _TYPES[f.split(" ")[1]]) for f in INDEX.split(", ")])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)],
                                      schema=_ARROW)


def capture_runs(spark: SparkSession, path: str) -> DataFrame:
    """The captures of every archive, each archive's own sorted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, raw in zip(batch.column("path").to_pylist(), batch.column("content")):
                data = zlib.decompress(raw.as_buffer(), wbits=31)
                name = file.rsplit("/", 1)[-1]
                rows = sorted((_capture(name, *r) for r in parse_archive(data)), key=sort_key)
                if rows:
                    yield _batch(rows)
    return read_bytes(spark, path).mapInArrow(run, INDEX)


class LoserTree:
    """k-way merge of sorted iterators: each step replays one leaf-to-root path."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.k = max(1, len(runs))
        self.head: list = [next(r, None) for r in runs] or [None]
        self.keys = [None if h is None else sort_key(h) for h in self.head]
        self.tree = [-1] * self.k            # tree[0]: winner; others: losers
        for leaf in range(self.k):
            self._replay(leaf)

    def _beats(self, a: int, b: int) -> bool:
        if a == -1 or b == -1:
            return a == -1                   # an empty slot wins while the tree fills
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[b] is None and self.keys[a] is not None
        return (self.keys[a], a) < (self.keys[b], b)

    def _replay(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node:
            if self._beats(self.tree[node], winner):
                self.tree[node], winner = winner, self.tree[node]
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.keys[self.tree[0]] is not None:
            at = self.tree[0]
            yield self.head[at]
            self.head[at] = next(self.runs[at], None)
            self.keys[at] = None if self.head[at] is None else sort_key(self.head[at])
            self._replay(at)


def capture_index(runs: DataFrame, rows_per_batch: int = 10_000) -> DataFrame:
    """All captures in global order of URL key and time: partition i holds what
    comes before partition i + 1."""
    key = ("urlkey", "timestamp", "page_id", "file", "offset")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A range's pieces of each run; the range size bounds them.
        own: dict[str, list[tuple]] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                own.setdefault(row[3], []).append(row)
        for piece in own.values():
            # A run's piece comes as one shuffle block, in order, unless the
            # shuffle split it.
            if any(sort_key(a) > sort_key(b) for a, b in zip(piece, piece[1:])):
                piece.sort(key=sort_key)
        out: list[tuple] = []
        for row in LoserTree([iter(p) for p in own.values()]):
            out.append(row)
            if len(out) == rows_per_batch:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    return runs.repartitionByRange(*key).mapInArrow(merge, INDEX)


def op1_warc(spark, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return capture_index(capture_runs(spark, path)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
