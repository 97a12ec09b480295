"""WARC archives with revisit records, and a capture index merged from sorted runs.

Tasks write gzip-member-per-record archives into the shared folder; each archive comes with a run
of captures sorted by URL key and timestamp. The runs are cut by ranges of the key order, and a
task merges the pieces of all runs in its range with a loser tree, so the index is in global
order and a URL's history lies together.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator, Sequence
from datetime import datetime, timedelta, timezone
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contextmill.llm.shared_files import dealt, make_folder, of_files, read_file, write_file
from contextmill.llm.words import tidy
from contextmill.session import materialise

#: Compressed bytes after which a task begins another archive.
FILE_BYTES = 12 << 20
#: Captures have no times of their own here: a page's time is this plus its id in seconds.
#: Captures that a task merges: some 200 MB.
RANGE_ROWS = 1 << 17
EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)
_STEP = 1 << 14
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str | None) -> str:
    """The sort-friendly form of a URL: host parts reversed, then port, path and query, lower-cased.

    Scheme, leading ``www``, user and fragment do not count; what is no URL is its own key.
    """
    try:
        parts = urlsplit((url or "").strip())
        host, port = parts.hostname, parts.port
    except ValueError:
        host, port = None, None
    if not host:
        return (url or "").strip().lower()
    names = re.sub(r"^www\d*\.", "", host).split(".")
    query = "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    return ",".join(reversed(names)) + (f":{port}" if port not in (None, 80, 443) else "") + ")" + (
        (parts.path or "/") + (f"?{query}" if query else "")).lower()


def sha1(payload: bytes) -> str:
    """Upper-case base32 SHA-1, as WARC headers give it."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(key: object) -> str:
    """A page's record id: a UUID made from its id."""
    h = hashlib.sha256(f"page {key}".encode()).hexdigest()
    return f"urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-a{h[17:20]}-{h[20:32]}"


def timestamp(key: int | None) -> datetime:
    """A capture time that follows the page id, a second each; 2**37 seconds are what four digits of a year hold."""
    return EPOCH + timedelta(seconds=(key or 0) % (1 << 37))


def _one_line(value: str | None) -> str:
    return re.sub(r"[\x00-\x1f\x7f]+", " ", value or "").strip()


def record(key: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record: the response with its payload, or a revisit that names the response."""
    revisit = refers_to is not None
    when = timestamp(key).strftime("%Y-%m-%dT%H:%M:%SZ")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{record_id(key)}>",
        f"WARC-Date: {when}", f"WARC-Target-URI: {_one_line(url)}", f"WARC-Payload-Digest: sha1:{sha1(payload)}",
        f"X-Page-ID: {'' if key is None else key}", "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{record_id(refers_to)}>", f"X-Refers-To-Page-ID: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {name: value.strip() for name, _, value in (x.partition(":") for x in lines[1:])}
    return headers, rest[: int(headers["Content-Length"])]


def members(content: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, record) of each gzip member of an archive."""
    at, view = 0, memoryview(content)
    while at < len(content):
        one, data, fed = zlib.decompressobj(31), [], at
        while not one.eof and fed < len(content):  # in steps, since the rest behind a member is copied
            data.append(one.decompress(view[fed : fed + _STEP]))
            fed += min(_STEP, len(content) - fed)
        if not one.eof:
            raise ValueError("the archive is cut short")
        end = fed - len(one.unused_data)
        yield at, end - at, b"".join(data)
        at = end


class LoserTree:
    """Merges k sorted sequences: each step costs one comparison on each level of the tree."""

    def __init__(self, runs: Sequence[Sequence], key: Callable = lambda x: x):
        self.runs, self.key = [iter(r) for r in runs], key
        self.size = max(1, len(self.runs))
        self.heads = [self._next(i) for i in range(len(self.runs))]
        self.losers = [-1] * self.size
        for i in range(len(self.runs)):
            self._play(i, building=True)

    def _next(self, i: int):
        item = next(self.runs[i], None)
        return None if item is None else (self.key(item), i, item)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or x[:2] < y[:2])

    def _play(self, i: int, building: bool = False) -> None:
        """Run ``i`` plays its way up; losers stay at the nodes, the winner at node 0."""
        at = (i + self.size) // 2
        while at > 0:
            if building and self.losers[at] < 0:
                self.losers[at] = i
                return
            if self._before(self.losers[at], i):
                self.losers[at], i = i, self.losers[at]
            at //= 2
        self.losers[0] = i

    def __iter__(self) -> Iterator:
        while self.runs and (head := self.heads[self.losers[0]]) is not None:
            yield head[2]
            winner = self.losers[0]
            self.heads[winner] = self._next(winner)
            self._play(winner)


def revisits(pages: DataFrame, key: str, html: str, least_bytes: int) -> DataFrame:
    """(row, refers_to) of the rows that repeat the payload of a page with a larger id.

    Payloads are equal by length, SHA-1 and SHA-256 together. Of equal payloads the largest id is
    the response; rows that repeat this id are responses, too, and a NULL id refers to it as the
    smallest one. Digests are grouped in each task first, and only repeated ones are joined.
    """
    payload = F.coalesce(F.col(html), F.lit(""))
    digests = materialise(pages.select(
        F.col(key).cast("bigint").alias("page_id"), F.monotonically_increasing_id().alias("row"),
        F.octet_length(payload).alias("bytes"), F.concat(F.sha1(payload.cast("binary")), F.sha2(payload, 256)).alias("digest")), "digests")
    groups = digests.filter(F.col("bytes") >= least_bytes).groupBy("digest", "bytes").agg(
        F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n")
    equal = digests.join(materialise(groups, "repeated"), ["digest", "bytes"])
    return equal.filter("not (page_id <=> refers_to)").select("row", "refers_to")


def write_archives(
    pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0,
) -> DataFrame:
    """Write one record for each row of ``pages``; the captures: one row per record.

    Captures: page_id, url_key, timestamp (14 digits), run, seq, file, offset, length, kind. Each
    archive's captures are one run, sorted by (url_key, timestamp, page_id). Payloads are the text
    as UTF-8; NULL is empty. Payloads under ``least_bytes`` are always responses. ``pages`` must
    yield its rows in the same partitions each time. An empty table writes nothing.
    """
    folder = make_folder(pages.sparkSession, folder)
    rows = pages.select(
        F.col(key).cast("bigint").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"),
        F.monotonically_increasing_id().alias("row"))
    again = materialise(revisits(pages, key, html, least_bytes), "revisits")
    source = rows.join(again, "row", "left").drop("row")
    kind = ("page_id bigint, url_key string, timestamp string, run string, seq int, file string, "
            "offset bigint, length bigint, kind string")
    names = [x.split()[0] for x in kind.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition = TaskContext.get().partitionId()
        pieces, captures, size = [], [], 0

        def flush() -> pa.RecordBatch:
            file = write_file(folder, f"part-{partition:06d}", "warc.gz", pieces)
            run = sorted(captures, key=lambda c: (c[1], c[2], c[0] is not None, c[0] or 0))
            out = [(c[0], c[1], c[2], file, i, file, c[3], c[4], c[5]) for i, c in enumerate(run)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

        for batch in batches:
            for page, link, text, refers in zip(*(batch.column(c) for c in ("page_id", "url", "html", "refers_to"))):
                page, link, refers = page.as_py(), link.as_py(), refers.as_py()
                pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = pack.compress(record(page, link, (text.as_py() or "").encode(), refers)) + pack.flush()
                when = timestamp(page).strftime("%Y%m%d%H%M%S")
                captures.append((page, url_key(link), when, size, len(data), "response" if refers is None else "revisit"))
                pieces.append(data)
                size += len(data)
                if size > FILE_BYTES:
                    yield flush()
                    pieces, captures, size = [], [], 0
        if captures:
            yield flush()

    return materialise(source.mapInArrow(tidy(write), kind), "captures")


def merge_index(captures: DataFrame) -> DataFrame:
    """The captures in global order of (url_key, timestamp, page_id), with ``position``.

    ``position`` is a capture's place in the whole index. Ranges of the order go to one task each,
    a URL with very many captures to several, and a loser tree merges the runs' pieces there. There are as
    many ranges as keep one at about ``RANGE_ROWS`` captures, whatever their number: a task holds that many.
    ``captures`` are a written table.
    """
    order = ["url_key", "timestamp", "page_id", "run", "seq"]
    usual = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(usual, -(-captures.count() // RANGE_ROWS))
    pieces = captures.repartitionByRange(ranges, *order).sortWithinPartitions("run", "seq")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
        if not tables:
            return
        table = pa.concat_tables(tables).combine_chunks()
        columns = [table.column(c).to_pylist() for c in ("url_key", "timestamp", "page_id", "run", "seq")]
        rows = list(zip(*columns))
        begin = [i for i in range(len(rows)) if i == 0 or rows[i][3] != rows[i - 1][3]]
        runs = [range(a, b) for a, b in zip(begin, [*begin[1:], len(rows)])]
        place = lambda i: (rows[i][0], rows[i][1], rows[i][2] is not None, rows[i][2] or 0)
        merged = pa.array(list(LoserTree(runs, place)), pa.int64())
        yield from table.take(merged).to_batches(max_chunksize=10_000)

    merged = pieces.mapInArrow(tidy(merge), captures.schema).withColumn("__at", F.monotonically_increasing_id())
    placed = materialise(merged, "index")
    part, within = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    sizes = dict(placed.groupBy(part.alias("p")).count().collect())  # a row per partition
    before, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(p, 0)
    first = F.from_json(F.lit(str(before)), "array<bigint>")
    return placed.withColumn("position", F.element_at(first, (part + 1).cast("int")) + within).drop("__at")


def read_archives(captures: DataFrame, folder: str) -> DataFrame:
    """(page_id, file, offset, record_type, payload, payload_digest, refers_to, url) of every record.

    ``payload`` is that of the record itself, NULL for revisits, whose ``payload_bytes`` are those
    of the response they refer to; a response whose digest does not fit its payload is an error.
    """
    kind = ("page_id bigint, file string, offset bigint, record_type string, payload binary, payload_bytes bigint, "
            "payload_digest string, refers_to bigint, url string")
    names = [x.split()[0] for x in kind.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string()]

    folder = make_folder(captures.sparkSession, folder)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column("file").to_pylist():
                rows: list[tuple] = []
                for offset, _, data in members(read_file(folder, file)):
                    headers, block = read_record(data)
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    revisit = headers["WARC-Type"] == "revisit"
                    if not revisit and (len(payload) != size or sha1(payload) != digest):
                        raise ValueError(f"damaged record in {file} at {offset}")
                    page, refers = headers["X-Page-ID"], headers.get("X-Refers-To-Page-ID")
                    rows.append((
                        int(page) if page else None, file, offset, headers["WARC-Type"], None if revisit else payload,
                        size, digest, int(refers) if refers else None, headers["WARC-Target-URI"]))
                    if len(rows) == 200:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return of_files(dealt(materialise(captures.select("file").distinct(), "files")).mapInArrow(tidy(unpack), kind))
