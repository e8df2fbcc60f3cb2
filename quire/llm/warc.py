"""WARC files: writing, and reading back by a verified chain of record boundaries.

Writing. A record holds an HTTP response with a page's html. Of pages with equal payloads the one with the smallest id is a
``response``; the others are ``revisit`` records that name it and carry no payload. Only digests are moved to find
copies; the table of copies is written, so that Spark knows its size when it joins the pages with it.

Reading. A file is read in blocks by different tasks, and a block may begin anywhere, also inside a payload that
looks like a record. So each task takes everything that looks like the beginning of a record as a candidate and
follows its lengths to the candidate's successor, up to the first one beyond the block. The chains of all
blocks are joined by pointer jumping from the beginning of each file: what it reaches are the records; candidates that only
look so are never reached. Lines that the headers of several candidates share are read once, so a payload made of record heads
takes time in proportion to its bytes.

Attempts of tasks write files of their own names into the shared folder; the manifest lists those that succeeded.

Defined results: a null html is an empty payload, a null url an empty address. Rows that repeat id and payload are responses all. Pages
without an id are revisits of the smallest id with their payload, else responses. Headers have any length. A chain that doesn't end where
its file does, or has not as many records as the manifest says, is an error.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import scratch_path, settle

MAGIC = b"WARC/1.1\r\n"
HEADER = 1 << 16  # bytes read ahead for a record's header; longer ones are read on
BLOCK = 4 << 20
READ = 4  # blocks that a task reads, on average
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def digest(payload: bytes) -> str:
    """SHA-1 in base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    body = b"" if revisit else HTTP + payload
    clean = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = [
        f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines = "\r\n".join([*head, f"Content-Length: {len(body)}"]).encode()
    return MAGIC + lines + b"\r\n\r\n" + body + b"\r\n\r\n"


def write_warc(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write ``pages`` ``(page_id, url, html)``; the manifest ``(path, bytes, records)``. Payloads below ``least`` bytes
    are responses all."""
    spark = pages.sparkSession
    base = scratch_path(spark, "warc")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    keyed = rows.select("page_id", F.sha1("html").alias("sha"), F.octet_length("html").alias("size"))
    first = keyed.where(F.col("size") >= least).groupBy("sha", "size").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    copies = keyed.join(first.where("n > 1 and first is not null"), ["sha", "size"]).where(~F.col("page_id").eqNullSafe(F.col("first")))
    path = scratch_path(spark, "copies")
    copies.select("page_id", "sha", "first").distinct().write.parquet(path)
    known = spark.read.parquet(path)
    known = known.select(F.col("page_id").alias("_id"), F.col("sha").alias("_sha"), "first")
    if known.take(1):
        rows = rows.join(known, F.col("page_id").eqNullSafe(F.col("_id")) & (F.sha1("html") == F.col("_sha")), "left")
    else:
        rows = rows.withColumn("first", F.lit(None).cast("bigint"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, n, name = None, 0, 0, ""
        for batch in batches:
            for i, u, h, f in zip(*(batch.column(j) for j in range(4))):
                if out is None:
                    files, folder = fs.FileSystem.from_uri(base)
                    files.create_dir(folder, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc"
                    out = files.open_output_stream(f"{folder}/{name}")
                f = f.as_py()
                data = record(i.as_py(), u.as_py(), h.as_buffer().to_pybytes(), f, f is not None)
                out.write(data)
                size, n = size + len(data), n + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict(
                {"path": [f"{base.rstrip('/')}/{name}"], "bytes": [size], "records": [n]},
                pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]),
            )

    return settle(rows.select("page_id", "url", "html", "first").mapInArrow(run, "path string, bytes long, records long"))


def _read(path: str, begin: int, size: int) -> bytes:
    files, name = fs.FileSystem.from_uri(path)
    with files.open_input_file(name) as f:
        return f.read_at(size, begin)


class Span:
    """Bytes of a file from ``begin`` on, of which more are read when a header needs them."""

    def __init__(self, path: str, begin: int, size: int):
        self.path, self.begin, self.data = path, begin, _read(path, begin, size)

    def more(self) -> bool:
        found = _read(self.path, self.begin + len(self.data), max(HEADER, len(self.data)))
        self.data += found
        return bool(found)


def parse_header(span: Span, at: int) -> tuple[dict[str, str], int] | None:
    """Fields of the record header at ``at`` and where its block begins, or None if there is none."""
    if not span.data.startswith(MAGIC, at):
        return None
    fields: dict[str, str] = {}
    line = searched = at + len(MAGIC)
    while True:
        end = span.data.find(b"\r\n", searched)
        if end < 0:
            searched = max(line, len(span.data) - 1)
            if not span.more():
                return None
            continue
        if end == line:
            return (fields, end + 2) if fields.get("content-length", "").isdigit() else None
        name, colon, value = span.data[line:end].partition(b":")
        if not colon:
            return None
        fields[name.strip().decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
        line = searched = end + 2


class Lengths:
    """What follows from the headers of candidates that are asked for in ascending order.

    A candidate's header begins a line, so candidates that no blank line parts share their last lines; those are read once.
    """

    def __init__(self, span: Span):
        self.span = span
        self.bad = self.blank = self.field = -1  # beginnings of lines: no header goes past ``bad``
        self.body = self.length = 0

    def of(self, at: int) -> tuple[int, int] | None:
        """Where the block of the candidate at ``at`` begins, and its length; None if that is no header."""
        line = at + len(MAGIC)
        if line > max(self.bad, self.blank):
            self._read(line)
        return (self.body, self.length) if self.bad < line <= self.field else None

    def _read(self, line: int) -> None:
        field = length = -1
        searched = line
        while True:
            end = self.span.data.find(b"\r\n", searched)
            if end < 0:
                searched = max(line, len(self.span.data) - 1)
                if not self.span.more():
                    self.bad = len(self.span.data)
                    return
                continue
            if end == line:
                self.blank, self.body, self.field, self.length = line, end + 2, field if length >= 0 else -1, length
                return
            name, colon, value = self.span.data[line:end].partition(b":")
            if not colon:
                self.bad = line
                return
            if name.strip().lower() == b"content-length":
                value = value.strip()
                field, length = line, int(value) if value.isdigit() and len(value) <= 18 else -1
            line = searched = end + 2


def candidates(span: Span, size: int) -> list[tuple[int, int, int, int]]:
    """``(offset, successor, exit, records)`` of all that looks like a record and begins in the first ``size`` bytes of ``span``. ``exit`` is where
    following successors leaves the block, after so many ``records``."""
    found: list[tuple[int, int]] = []
    lengths = Lengths(span)
    at = span.data.find(MAGIC)
    while 0 <= at < size:
        if header := lengths.of(at):
            body, length = header
            found.append((span.begin + at, span.begin + body + length + 4))
        at = span.data.find(MAGIC, at + 1, size + len(MAGIC))
    leaves: dict[int, tuple[int, int]] = {}
    out = []
    for offset, successor in reversed(found):
        leaf, records = leaves.get(successor, (successor, 0))
        leaves[offset] = leaf, records + 1
        out.append((offset, successor, leaf, records + 1))
    return out[::-1]


def boundaries(manifest: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """``(path, begin, bytes, entry)`` of each block that a record begins in, ``entry`` being the first such record, and all
    candidates ``(path, bytes, begin, offset, successor, exit, records)``."""
    blocks = manifest.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0), F.col("bytes") - 1, F.lit(block).cast("bigint"))).alias("begin"))
    # few small rows that stand for much reading: a fixed number of tasks, which adaptive execution leaves alone
    blocks = settle(blocks.repartition(max(1, -(-blocks.count() // READ)), "path", "begin"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "bytes", "begin", "offset", "successor", "exit", "records"]
        for batch in batches:
            for path, size, begin in zip(*(batch.column(i).to_pylist() for i in range(3))):
                found = candidates(Span(path, begin, block + HEADER), block)
                columns = [[path] * len(found), [size] * len(found), [begin] * len(found), *(list(c) for c in zip(*found))] if found else [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *[pa.array(c, pa.int64()) for c in columns[1:]]], names)

    seen = settle(blocks.mapInArrow(look, "path string, bytes long, begin long, offset long, successor long, exit long, records long"))
    # only the beginning of a file and what a chain leaves its block for can be where a chain enters a block
    targets = seen.select("path", F.col("exit").alias("offset")).distinct()
    starts = seen.where("offset = 0").select("path", "offset")
    jump = seen.join(targets.unionByName(starts).distinct(), ["path", "offset"]).select("path", F.col("offset").alias("a"), F.col("exit").alias("b"))
    jump, reached = settle(jump), settle(starts)
    while True:
        # whoever is reached reaches as far as pointers go; pointers then go twice as far
        ahead = reached.join(jump.withColumnRenamed("a", "offset"), ["path", "offset"]).select("path", F.col("b").alias("offset"))
        more = settle(reached.unionByName(ahead).distinct())
        if not more.join(reached, ["path", "offset"], "left_anti").take(1):
            break
        reached = more
        far = jump.select("path", F.col("a").alias("b"), F.col("b").alias("c"))
        jump = settle(jump.join(far, ["path", "b"], "left").select("path", "a", F.coalesce("c", "b").alias("b")))
    entries = seen.join(reached, ["path", "offset"], "left_semi").groupBy("path", "begin", "bytes")
    entries = settle(entries.agg(F.min("offset").alias("entry"), F.min_by("records", "offset").alias("records"), F.max_by("exit", "offset").alias("exit")))
    chains = entries.groupBy("path").agg(F.sum("records").alias("found"), F.max("exit").alias("end"))
    wrong = manifest.where("bytes > 0").join(chains, "path", "left").where("not (found <=> records and end <=> bytes)")
    if bad := wrong.select("path", "bytes", "records", "found", "end").take(1):
        r = bad[0]
        raise ValueError(f"{r.path}: {r.found} records up to byte {r.end}, {r.records} up to byte {r.bytes} were written")
    return entries.drop("records", "exit"), seen


def read_warc(manifest: DataFrame, block: int = BLOCK, payloads: bool = True) -> DataFrame:
    """``(page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload)`` of all records; ``payload`` is null for
    a revisit, and for all if ``payloads`` is off.
    A payload that doesn't have its digest is an error."""
    entries, _ = boundaries(manifest, block)
    fields = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"

    def number(value: str | None) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
        return int(found[1]) if found else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        names = [x.split()[0] for x in fields.split(", ")]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            for path, begin, total, entry in zip(*(batch.column(i).to_pylist() for i in range(4))):
                span, base = Span(path, entry, begin + block + HEADER - entry), entry
                rows, held, at = [], 0, entry
                while at < min(begin + block, total):
                    if len(rows) == 2000 or held > 16 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
                    header = parse_header(span, at - base)
                    if header is None:
                        raise ValueError(f"{path}: no record at {at}")
                    found, body = header
                    size = int(found["content-length"])
                    content = span.data[body : body + size]
                    if len(content) < size:
                        content = _read(path, base + body, size)
                    payload = content.partition(b"\r\n\r\n")[2] if found["warc-type"] == "response" else None
                    mark = found["warc-payload-digest"].removeprefix("sha1:")
                    if payload is not None and digest(payload) != mark or len(content) < size:
                        raise ValueError(f"{path}: damaged record at {at}")
                    length = int(found["x-payload-length"]) if payload is None else len(payload)
                    payload = payload if payloads else None
                    rows.append((number(found["warc-record-id"]), found["warc-target-uri"], found["warc-type"], number(found.get("warc-refers-to")), length, mark, payload))
                    held += size
                    at = base + body + size + 4
                if rows:
                    yield batch_of(rows)

    entries = entries.select("path", "begin", "bytes", "entry").repartition(max(1, -(-entries.count() // READ)), "path", "begin")
    return entries.mapInArrow(run, fields)
