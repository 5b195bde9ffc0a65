"""WARC archives of pages, and their capture histories by external index merge.

Writing: of records with equal payloads the one with the largest page id is the response, the others revisit it.
Digests with more than one record are found first (partial counts before the shuffle) and joined back from a
table, so that a payload that very many pages share is split between tasks.  A record is a gzip member of its own;
archives hold at most about ``archive_mb`` of members, and each is one file, written by Spark's own writer.

Reading: each archive gives a run of captures with their offset and length in it, sorted by URL key, time and page.
The runs are written once to the shared folder, dealt out by key ranges of bounded size, and merged in each range by a
k-way loser tree over the pieces of runs that reach it, as columnar batches; of more than ``fan_in`` pieces, the first
are merged to one before others come.  That leaves the capture histories in one global order.

Defined results: null html is an empty payload; null URLs have no target and the empty key; a null page id
never is a response that others refer to unless all of the payload's ids are null (then all are responses);
rows that share both id and payload are alike; payloads shorter than ``least`` bytes are all responses; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytebpe import slices
from .common import arrow_batches, spool

END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, captured string, archive string, offset long, length long"
_NAMES = [part.split()[0] for part in SCHEMA.split(", ")]
#: What Spark's writer puts behind an archive: gzip readers take a zero byte at the end for padding.
_PADDING = "\0"


class LoserTree:
    """Merges sorted iterators: each inner node keeps the loser of the match below it, so that a step replays one path."""

    def __init__(self, runs: list[Iterator], key) -> None:
        self.runs, self.key, self.k = runs, key, max(1, len(runs))
        self.heads: list = [next(r, None) for r in runs] or [None]
        self.keys: list = [None if h is None else key(h) for h in self.heads]
        self.losers = [-1] * self.k
        self.winner = self._build(1) if self.k > 1 else 0

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.keys[a], self.keys[b]
        return y is None or x is not None and (x, a) <= (y, b)

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        if not self._beats(a, b):
            a, b = b, a
        self.losers[node] = b
        return a

    def __iter__(self) -> Iterator:
        while self.heads[self.winner] is not None:
            w = self.winner
            yield self.heads[w]
            self.heads[w] = next(self.runs[w], None)
            self.keys[w] = None if self.heads[w] is None else self.key(self.heads[w])
            node = (w + self.k) // 2
            while node >= 1:
                if not self._beats(w, self.losers[node]):
                    w, self.losers[node] = self.losers[node], w
                node //= 2
            self.winner = w


def url_key(url: str | None) -> str:
    """A sort key: the host's labels from the right, then path and query, all in lower case."""
    scheme, found, rest = (url or "").partition("://")
    if not found:
        return (url or "").lower()
    cut = min((at for at in map(rest.find, "/?#") if at >= 0), default=len(rest))
    host, tail = rest[:cut], rest[cut:].partition("#")[0]
    return f"{','.join(reversed(host.lower().split('.')))}){(tail or '/').lower()}"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, captured: str, refers_to: int | None) -> str:
    """A record with the blank lines that end it."""
    named = lambda i: f"<urn:page:{'none' if i is None else i}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    body = payload.decode() if refers_to is None else ""
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {named(page_id)}", f"WARC-Date: {captured}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {named(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (len(payload) if body else 0)}"]
    return "\r\n".join(head) + END + http + body + END


def members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of every gzip member of an archive."""
    view, at = memoryview(data), 0
    while at < len(view) and view[at]:
        coder, parts, here = zlib.decompressobj(zlib.MAX_WBITS | 16), [], at
        while not coder.eof:
            if here >= len(view):
                raise ValueError(f"the record at {at} ends too early")
            parts.append(coder.decompress(view[here : here + (1 << 18)]))
            here += 1 << 18
        here = min(here, len(view)) - len(coder.unused_data)
        yield at, here - at, b"".join(parts)
        at = here


def record_of(content: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers, payload as stored."""
    data = io.BytesIO(content)
    line = data.readline()
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no record starts at {line[:40]!r}")
    fields: dict[str, str] = {}
    while (line := data.readline()) not in (b"\r\n", b""):
        name, _, value = line.decode().rstrip("\r\n").partition(": ")
        fields[name.lower()] = value
    block = data.read(int(fields["content-length"]))
    if data.read() != END.encode():
        raise ValueError("a record isn't followed by two line ends")
    head, _, payload = block.partition(END.encode())
    http = dict(x.lower().split(": ", 1) for x in head.decode().split("\r\n")[1:])
    return fields, http, payload


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def write(pages: DataFrame, path: str, *, least: int = 0, captured: Column | None = None, archive_mb: int = 32, level: int = 6) -> None:
    """One record a page, to archives in ``path``. ``captured``: the capture time (the table has none: seconds from 2024 on, by page id)."""
    arrow_batches(pages.sparkSession)
    when = captured if captured is not None else F.timestamp_seconds(F.coalesce(F.pmod(F.col("page_id").cast("long"), F.lit(1 << 31)), F.lit(0)) + 1_704_067_200)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), payload.alias("payload"), F.sha1(payload).alias("digest"), F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("captured"))
    shared = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    rows = rows.join(spool(shared, "shared-payloads"), "digest", "left")
    refers = F.when((F.octet_length("payload") >= least) & F.col("first").isNotNull() & ~F.coalesce(F.col("page_id") == F.col("first"), F.lit(False)), F.col("first"))

    def run(batches):
        held, size = [], 0
        for b in slices(batches):
            for page, url, body, when_, ref in zip(*[b.column(c).to_pylist() for c in ("page_id", "url", "payload", "captured", "refers_to")], strict=True):
                coder = zlib.compressobj(level, zlib.DEFLATED, zlib.MAX_WBITS | 16)
                member = coder.compress(record(page, url, body, base32_sha1(body), when_, ref).encode()) + coder.flush()
                if held and size + len(member) > archive_mb << 20:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["value"])
                    held, size = [], 0
                held.append(member)
                size += len(member)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["value"])

    archives = rows.select("page_id", "url", "payload", "captured", refers.alias("refers_to")).mapInArrow(run, "value binary")
    # A text of the archive's bytes as they are; one archive a file.
    archives.select(F.col("value").cast("string").alias("value")).write.option("lineSep", _PADDING).option("maxRecordsPerFile", 1).text(path)


def _capture(fields: dict[str, str], http: dict[str, str], payload: bytes) -> tuple:
    number = lambda x: None if x is None or "none" in x else int(x.rpartition(":")[2].rstrip(">"))
    kind = fields["warc-type"]
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and base32_sha1(payload) != digest:
        raise ValueError(f"the payload of {fields['warc-record-id']} doesn't match its digest")
    size = len(payload) if kind == "response" else int(http["content-length"])
    return number(fields["warc-record-id"]), size, digest, kind, number(fields.get("warc-refers-to")), url_key(fields.get("warc-target-uri")), fields["warc-date"]


def _order(row: tuple) -> tuple:
    return row[5], row[6], -1 if row[0] is None else row[0]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    long, text = pa.int64(), pa.string()
    kinds = [long, long, text, text, long, text, text, text, long, long]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=_NAMES)


def _batches(rows: Iterator[tuple], size: int = 4096) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield _batch(held)
            held = []
    if held:
        yield _batch(held)


def _rows(batches: list[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*[c.to_pylist() for c in b.columns], strict=True)


def runs(spark: SparkSession, path: str) -> DataFrame:
    """The captures of each archive as one sorted run, written to the shared folder."""
    arrow_batches(spark)

    def run(batches):
        for b in batches:
            for name, data in zip(b.column("archive").to_pylist(), b.column("content"), strict=True):
                found = [(*_capture(*record_of(content)), name, offset, length) for offset, length, content in members(data.as_py())]
                yield from _batches(iter(sorted(found, key=_order)))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return spool(files.select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content").mapInArrow(run, SCHEMA), "runs")


def read_record(archive: bytes, offset: int, length: int) -> tuple[dict[str, str], dict[str, str], bytes]:
    """The record that an index row points at: no other part of the archive is decompressed."""
    return record_of(zlib.decompress(archive[offset : offset + length], zlib.MAX_WBITS | 16))


def histories(spark: SparkSession, path: str, *, range_rows: int = 500_000, fan_in: int = 256) -> DataFrame:
    """All captures in ascending order of URL key, time and page id, range by range; a range has about ``range_rows`` captures."""

    def merge(batches):
        closed: list[list[pa.RecordBatch]] = [[]]
        last = None
        for b in batches:
            rows = zip(b.column("url_key").to_pylist(), b.column("captured").to_pylist(), b.column("page_id").to_pylist(), strict=True)
            start = 0
            for k, (url, when, page) in enumerate(rows):
                key = (url, when, -1 if page is None else page)
                if last is not None and key < last:  # another run begins
                    if k > start:
                        closed[-1].append(b.slice(start, k - start))
                    if len(closed) >= fan_in:
                        closed = [list(_batches(iter(LoserTree([_rows(x) for x in closed], _order))))]
                    closed.append([])
                    start = k
                last = key
            closed[-1].append(b.slice(start))
        yield from _batches(iter(LoserTree([_rows(x) for x in closed], _order)))

    found = runs(spark, path)
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-found.count() // range_rows))
    return found.repartitionByRange(ranges, "url_key", "captured", "page_id").mapInArrow(merge, SCHEMA)
