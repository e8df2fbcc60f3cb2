"""Token-id files: one concatenated id array per file, document boundaries in Elias-Fano form.

Layout of a file (little-endian): magic ``QTOK1``, one byte for the width of an id (2 or 4), ids; then two
monotone sequences, the documents' ends among the ids and their keys; last the trailer, eight 64-bit numbers:
documents, ids, documents without a key, smallest key, and for either sequence its place and its low bits.

A sequence of n numbers below u keeps the low ``l = log2(u/n)`` bits of each number packed, and the high parts as
a bit string in which number i sets bit ``high(i) + i``: about ``2 + l`` bits a number. The place of every 256th
set bit is stored in 32 bits, so that ``select`` reads the bits from there on only.

Files are written where ``spark.checkpoint.dir`` names the shared folder. An attempt of a task writes a file of its
own name and only the attempt that succeeds is listed in the manifest, so a lost executor leaves nothing but a
file nobody reads. Documents stand in ascending order of their keys within and across files. A task that has much
to write makes several files, so neither writing nor reading holds more than one file's boundaries or ids.

Defined results: a null text has no ids but its end id; documents without a key stand first; rows that repeat a key
are all kept, one after the other.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.bpe import Vocabulary, encoder, slices
from quire.session import scratch_path, settle

MAGIC = b"QTOK1"
SAMPLE = 256
TRAILER = "<qqqqqqqq"
FILE_IDS = 1 << 26  # a task begins another file once one has so many ids


class Sequence(NamedTuple):
    """A non-decreasing sequence of numbers from 0 on, in Elias-Fano form."""

    n: int
    low_bits: int
    low: np.ndarray  # packed, uint8
    high: np.ndarray  # bit string, uint8
    samples: np.ndarray  # uint32: place of every SAMPLE-th set bit

    @classmethod
    def of(cls, values: np.ndarray) -> Sequence:
        n = len(values)
        if not n:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.uint32))
        values = values.astype(np.uint64)
        low_bits = max(0, int(values[-1]).bit_length() - n.bit_length())
        low = np.zeros(0, np.uint8)
        if low_bits:
            # bit by bit, so that no table of n times low_bits is held
            bits = np.zeros(n * low_bits, np.uint8)
            for k in range(low_bits):
                bits[k::low_bits] = (values >> np.uint64(k)) & np.uint64(1)
            low = np.packbits(bits, bitorder="little")
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(places[-1]) + 1, np.uint8)
        bits[places] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), places[::SAMPLE].astype(np.uint32))

    def _low(self, i: int) -> int:
        if not self.low_bits:
            return 0
        a, b = i * self.low_bits, (i + 1) * self.low_bits
        window = int.from_bytes(self.low[a // 8 : (b + 7) // 8].tobytes(), "little")
        return window >> (a % 8) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """Number ``i``."""
        place = int(self.samples[i // SAMPLE])
        left = i % SAMPLE  # set bits still to pass
        at = place // 8
        word = int(self.high[at]) >> (place % 8) << (place % 8)
        while (count := word.bit_count()) <= left:
            left -= count
            at += 1
            word = int(self.high[at])
        for _ in range(left):
            word &= word - 1
        place = at * 8 + (word & -word).bit_length() - 1
        return ((place - i) << self.low_bits) | self._low(i)

    def every(self) -> np.ndarray:
        """All numbers."""
        if not self.n:
            return np.zeros(0, np.int64)
        out = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n] - np.arange(self.n)
        out <<= self.low_bits
        if self.low_bits:
            bits = np.unpackbits(self.low, bitorder="little")
            for k in range(self.low_bits):
                out |= bits[k :: self.low_bits][: self.n].astype(np.int64) << k
        return out

    def dump(self) -> bytes:
        head = struct.pack("<qqq", self.n, len(self.low), len(self.high))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def load(cls, data: memoryview, low_bits: int) -> Sequence:
        n, a, b = struct.unpack_from("<qqq", data)
        low = np.frombuffer(data, np.uint8, a, 24)
        high = np.frombuffer(data, np.uint8, b, 24 + a)
        return cls(n, low_bits, low, high, np.frombuffer(data, np.uint32, -(-n // SAMPLE), 24 + a + b))


class TokenFile:
    """A file that has been read: documents by their number in it."""

    def __init__(self, data: bytes | memoryview):
        data = memoryview(data)
        if bytes(data[:5]) != MAGIC:
            raise ValueError("not a token-id file")
        self.docs, n_ids, self.keyless, self.least, ends, end_bits, keys, key_bits = struct.unpack(TRAILER, data[-64:])
        kind = np.dtype("<u2") if data[5] == 2 else np.dtype("<u4")
        self.ids = np.frombuffer(data, kind, n_ids, 6)
        self.ends = Sequence.load(data[ends:], end_bits)
        self.keys = Sequence.load(data[keys:], key_bits)

    def span(self, i: int) -> tuple[int, int]:
        """Where document ``i`` begins and ends among the ids."""
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def document(self, i: int) -> np.ndarray:
        a, b = self.span(i)
        return self.ids[a:b]


class _Writer:
    """A file that is being written: ids go out as they come, boundaries and keys are kept for its end."""

    def __init__(self, base: str, name: str, width: int):
        files, folder = fs.FileSystem.from_uri(base)
        files.create_dir(folder, recursive=True)
        self.path, self.width = f"{base.rstrip('/')}/{name}", width
        self._out = files.open_output_stream(f"{folder}/{name}")
        self._out.write(MAGIC + bytes([width]))
        self._keys: list[np.ndarray] = []
        self._ends: list[np.ndarray] = []
        self.total = self._keyless = 0

    def write(self, keys: pa.Array, ids: np.ndarray, ends: np.ndarray) -> None:
        self._out.write(ids.astype(f"<u{self.width}").tobytes())
        self._ends.append(self.total + ends)
        self.total += len(ids)
        self._keyless += keys.null_count
        self._keys.append(keys.drop_null().to_numpy(zero_copy_only=False))

    def close(self) -> tuple[int, int]:
        """Numbers of documents and ids."""
        numbers = np.concatenate(self._keys)
        least = int(numbers[0]) if len(numbers) else 0
        keys = Sequence.of(numbers.astype(np.uint64) - np.uint64(least % (1 << 64)))
        ends = Sequence.of(np.concatenate(self._ends))
        at = 6 + self.total * self.width
        first = ends.dump()
        self._out.write(first + keys.dump())
        self._out.write(struct.pack(TRAILER, ends.n, self.total, self._keyless, least, at, ends.low_bits, at + len(first), keys.low_bits))
        self._out.close()
        return ends.n, self.total


def write_token_files(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text", end_id: int = 0,
                      file_ids: int = FILE_IDS) -> DataFrame:
    """Write the files of ``docs``; the manifest ``(part, turn, path, docs, ids, first)``, ``first`` being the number of ids
    in all files before.

    Rows are dealt to tasks by ranges of the key before they are encoded. Where one key has very many rows, a hash
    of the text cuts them further.
    """
    spark = docs.sparkSession
    base = scratch_path(spark, "tokens")
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("key", "tie").sortWithinPartitions("key", "tie", "text").select("key", "text", F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        width = 2 if max(enc.size, end_id + 1) <= 1 << 16 else 4
        out: _Writer | None = None
        done = 0

        def close() -> pa.RecordBatch:
            docs, ids = out.close()
            row = {"part": [part], "turn": [done], "path": [out.path], "docs": [docs], "ids": [ids]}
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_pydict(row, pa.schema(list(zip(row, kinds))))

        part = 0
        for batch in batches:
            for a, b in slices(batch.column(1)):
                if out is None:
                    part = batch.column(2)[0].as_py()
                    out = _Writer(base, f"part-{part:05d}-{done:05d}-{uuid.uuid4().hex}.tok", width)
                ids, per_text, _, _ = enc.encode(batch.column(1).slice(a, b - a))
                ids = np.insert(ids, per_text[1:], end_id)  # an end id behind each document
                out.write(batch.column(0).slice(a, b - a), ids, per_text[1:] + np.arange(1, b - a + 1))
                if out.total >= file_ids:
                    yield close()
                    out, done = None, done + 1
        if out is not None:
            yield close()

    manifest = settle(rows.mapInArrow(run, "part int, turn int, path string, docs long, ids long"))
    # one row per file, so one task adds up what files before have
    before = Window.orderBy("part", "turn").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("first", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame, ids: bool = True) -> DataFrame:
    """``(key, start, n_tokens, crc32[, ids])`` of every document in the files of ``manifest``; ``start`` counts ids of
    all documents before, ``crc32`` is of the ids as 32-bit numbers. A task reads one file at a time."""
    fields = "key long, start long, n_tokens long, crc32 long" + ", ids array<int>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                files, name = fs.FileSystem.from_uri(path)
                with files.open_input_file(name) as f:
                    file = TokenFile(f.read_buffer())
                ends = file.ends.every()
                starts = np.append(0, ends)[:-1]
                keys = [None] * file.keyless + (file.keys.every() + file.least).tolist()
                for a in range(0, file.docs, 4096):
                    b = min(file.docs, a + 4096)
                    pairs = list(zip(starts[a:b].tolist(), ends[a:b].tolist()))
                    sums = [zlib.crc32(file.ids[s:e].astype("<u4").tobytes()) for s, e in pairs]
                    columns = [
                        pa.array(keys[a:b], pa.int64()), pa.array(first + starts[a:b], pa.int64()),
                        pa.array(ends[a:b] - starts[a:b], pa.int64()), pa.array(sums, pa.int64()),
                    ]
                    names = ["key", "start", "n_tokens", "crc32"]
                    if ids:
                        bounds = pa.array(np.append(starts[a:b], ends[b - 1]) - starts[a], pa.int32())
                        columns.append(pa.ListArray.from_arrays(bounds, pa.array(file.ids[starts[a] : ends[b - 1]].astype(np.int32))))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names)

    # files are dealt out one by one; there are as many rows here as files
    return manifest.select("path", "first").repartition(max(1, manifest.count()), "path").mapInArrow(run, fields)
