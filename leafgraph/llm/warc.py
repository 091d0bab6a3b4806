"""WARC archives: write, read back, and merge the index of all captures.

Records with equal payloads are stored once: the one with the largest page_id is a
``response``, the others are ``revisit`` records that refer to it.  Each archive file
is a run: its captures are sorted by URL key and timestamp on their own.  The runs
are cut into key ranges, and within a range a loser tree merges the runs' slices,
so the captures come out in one global order.

Archives go to the shared folder, a gzip member for each record, under names that
depend on the partition only; a file appears by a rename once it is whole, so a
task that runs again replaces it by the same bytes.

Defined cases: null html counts as an empty payload; a null url has key ``-``; a null
page_id is the smallest; rows that share the largest page_id of their payload are
all responses; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import os
import zlib
from collections.abc import Callable, Iterable, Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgraph.llm.common import durable, fresh_path, join_by_key

FILE_BYTES = 16 << 20
MIN_REVISIT_BYTES = 0
#: Compressed bytes given to the decompressor at once.
READ_BYTES = 4096
#: Index rows merged by one task.
MERGED_ROWS = 200_000
EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, captured_at string, file string, at long, stored long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str | None) -> str:
    """Sort-friendly form: host labels reversed, then path and query."""
    if not url:
        return "-"
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return url.strip().lower()
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/").lower() + ("?" + parts.query.lower() if parts.query else "")


def capture_time(page_id: int | None) -> str:
    """Pages carry no time of capture; their ids count seconds."""
    return (EPOCH + timedelta(seconds=(page_id or 0) % (1 << 33))).strftime("%Y-%m-%dT%H:%M:%SZ")


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, size: int, sha: str, refers_to: int | None) -> bytes:
    """One record; a revisit has the digest and the size of the payload, but not the payload."""
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {capture_time(page_id)}",
        f"WARC-Target-URI: {'' if url is None else ' '.join(url.split())}", f"WARC-Payload-Digest: sha1:{sha}", f"X-Payload-Length: {size}",
        "Content-Type: application/http;msgtype=response",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    block = HTTP + (payload if kind == "response" else b"")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, stored bytes, headers, block) of each record of an archive file."""
    at, view = 0, memoryview(data)
    while at < len(data):
        member, out, end = zlib.decompressobj(31), [], at
        while not member.eof and end < len(data):  # small steps: what is left over is copied
            step = view[end : end + READ_BYTES]
            out.append(member.decompress(step))
            end += len(step)
        end -= len(member.unused_data)
        raw = b"".join(out)
        if not member.eof:
            raise ValueError("the archive ends inside a record")
        head, _, rest = raw.partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
        yield at, end - at, fields, rest[: int(fields["Content-Length"])]
        at = end


def saver(folder: str) -> Callable[[str, bytes], None]:
    """A function that puts a whole file into ``folder``, by any path that pyarrow knows."""
    if folder.startswith("file:") or folder.startswith("/"):
        local = "/" + folder.removeprefix("file:").lstrip("/")

        def save(name: str, data: bytes) -> None:
            os.makedirs(local, exist_ok=True)
            part = f"{local}/.{name}.{os.getpid()}"
            with open(part, "wb") as f:
                f.write(data)
            os.replace(part, f"{local}/{name}")

    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)

        def save(name: str, data: bytes) -> None:
            store.create_dir(path)
            with store.open_output_stream(f"{path}/.{name}.{os.getpid()}") as f:
                f.write(data)
            store.move(f"{path}/.{name}.{os.getpid()}", f"{path}/{name}")

    return save


class LoserTree:
    """Merges sorted iterators: each inner node keeps the loser of its match."""

    def __init__(self, runs: list[Iterable], key: Callable):
        self.sources = [iter(r) for r in runs]
        self.key = key
        self.heads = [self._next(i) for i in range(len(self.sources))]
        self.losers = [-1] * len(runs)
        for i in range(len(runs)):
            self._play(i)

    def _next(self, i: int):
        for item in self.sources[i]:
            return self.key(item), i, item
        return None

    def _play(self, i: int) -> None:
        node = (i + len(self.heads)) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0:
                self.losers[node] = i
                return
            a, b = self.heads[i], self.heads[other]
            if a is None or (b is not None and b[:2] < a[:2]):
                self.losers[node], i = i, other
            node //= 2
        self.losers[0] = i

    def __iter__(self) -> Iterator:
        while self.heads and self.heads[self.losers[0]] is not None:
            winner = self.losers[0]
            yield self.heads[winner][2]
            self.heads[winner] = self._next(winner)
            self._play(winner)


def plan(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """What each page becomes: (page_id, th, size, sha, kind, refers_to), one row for rows alike."""

    def digests(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            data = batch.column("html").cast(pa.binary()).to_pylist()
            sha = pa.array([digest(x) for x in data], pa.string())
            size = pa.array([len(x) for x in data], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("th"), size, sha], names=["page_id", "th", "size", "sha"])

    rows = durable(pages.select("page_id", "th", "html").mapInArrow(digests, "page_id long, th long, size long, sha string").distinct(), "digests")
    groups = durable(rows.groupBy("sha", "size").agg(F.max("page_id").alias("holder"), F.count(F.lit(1)).alias("n")), "payloads")
    joined = join_by_key(rows, groups, ["sha", "size"], "n", rows.count())
    revisit = (F.col("size") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("holder"))
    return joined.select(
        "page_id", "th", "size", "sha", F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("holder")).alias("refers_to")
    )


def write(pages: DataFrame, folder: str, min_bytes: int = MIN_REVISIT_BYTES, file_bytes: int = FILE_BYTES) -> int:
    """Write ``pages(page_id, url, html)`` as archives into ``folder``; returns the number of records."""
    source = pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    ).withColumn("th", F.xxhash64("html"))
    planned = plan(source, min_bytes).withColumnsRenamed({"page_id": "p", "th": "h"})

    def archive(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        save, part = saver(folder), TaskContext.get().partitionId()
        held, size, number = [], 0, 0
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("kind", "page_id", "url", "size", "sha", "refers_to")]
            for kind, page_id, url, n, sha, to, html in zip(*cols, batch.column("html").cast(pa.binary()).to_pylist()):
                pack = zlib.compressobj(1, zlib.DEFLATED, 31)
                data = pack.compress(record(kind, page_id, url, html, n, sha, to)) + pack.flush()
                held.append(data)
                size += len(data)
                if size >= file_bytes:
                    save(f"run-{part:05}-{number:05}.warc.gz", b"".join(held))
                    yield pa.RecordBatch.from_arrays([pa.array([len(held)], pa.int64())], names=["records"])
                    held, size, number = [], 0, number + 1
        if held:
            save(f"run-{part:05}-{number:05}.warc.gz", b"".join(held))
            yield pa.RecordBatch.from_arrays([pa.array([len(held)], pa.int64())], names=["records"])

    joined = source.join(planned, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("th") == F.col("h")))
    ordered = joined.select("kind", "page_id", "url", "size", "sha", "refers_to", "html", "th").sortWithinPartitions("page_id", "th", "url")
    return ordered.mapInArrow(archive, "records long").agg(F.sum("records")).first()[0] or 0


def read(spark, folder: str) -> DataFrame:
    """All records of the archives in ``folder``: a sorted run for each file."""

    def captures(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                rows: list[tuple] = []
                for at, stored, h, block in parse(data):
                    number = lambda name: (lambda x: int(x) if x else None)(h[name].removeprefix("<urn:page:").removesuffix(">"))  # noqa: B023, E731
                    sha, size = h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["X-Payload-Length"])
                    if h["WARC-Type"] == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        if (digest(payload), len(payload)) != (sha, size):
                            raise ValueError(f"{path}: the payload at {at} doesn't have its digest")
                    to = number("WARC-Refers-To") if "WARC-Refers-To" in h else None
                    rows.append((number("WARC-Record-ID"), size, sha, h["WARC-Type"], to, url_key(h["WARC-Target-URI"]), h["WARC-Date"], path.rsplit("/", 1)[-1], at, stored))
                rows.sort(key=lambda r: (r[5], r[6], r[0] is not None, r[0] or 0))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                cols = list(zip(*rows)) if rows else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[f.split()[0] for f in RECORD.split(", ")])

    return spark.read.format("binaryFile").load(folder).select("path", "content").mapInArrow(captures, RECORD)


def merge(runs: DataFrame, merged_rows: int = MERGED_ROWS) -> DataFrame:
    """The captures of all runs in order of URL key, time and page: range after range."""

    def merged(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        files, keys = rows.column("file").to_pylist(), list(zip(rows.column("url_key").to_pylist(), rows.column("captured_at").to_pylist(), rows.column("page_id").to_pylist()))
        starts = [i for i in range(len(files)) if not i or files[i] != files[i - 1]]
        slices = [range(a, b) for a, b in zip(starts, [*starts[1:], len(files)])]
        order = list(LoserTree(slices, key=lambda i: (keys[i][0], keys[i][1], keys[i][2] is not None, keys[i][2] or 0)))
        yield from rows.take(pa.array(order)).combine_chunks().to_batches()

    parts = max(1, -(-runs.count() // merged_rows), int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["url_key", "captured_at", "page_id"]
    ranges = runs.repartitionByRange(parts, *order).sortWithinPartitions("file", *order)
    return ranges.mapInArrow(merged, runs.schema)


def round_trip(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``pages`` as archives, read them back, and merge the index of their captures."""
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")
    if not write(pages, folder, min_bytes, file_bytes):
        return spark.createDataFrame([], RECORD)
    return merge(durable(read(spark, folder), "index"))
