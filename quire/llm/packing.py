"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

A sequence is filled greedily, always with the longest piece that still fits. Then, if it holds more than one piece, its
shortest piece is taken out again where two pieces that are not packed yet fill the widened gap more tightly; of such pairs
the one with the greatest sum goes in, of equal sums the one with the longest piece.

Pieces of one length are interchangeable, so the whole corpus is packed by its histogram: how many pieces there are of each
of the ``capacity`` lengths. The choice for one sequence holds for the next one too as long as there are enough pieces of
every length it looks at, so equal sequences are laid out many at a time, with the same result as one after the other
(``patterns``). Each pattern ends because a length has fewer pieces left than a sequence would take of it, which happens
at most ``capacity // length`` times for a length: no corpus has more than the sum of these, 7,600 patterns of 44 lengths at
most for a capacity of 1,024. The driver sees the histogram and the patterns, never pieces.

Pieces are cut and counted by the task that encodes them. A piece's rank among all of its length is its turn in that task
plus what tasks before have of that length, and its rank says which sequence it goes to, and where: no sort and no group.

A document longer than a sequence is cut from its end into whole sequences; its first piece is what remains.

Defined results: a null text is like an empty one, a single end id; rows that repeat are packed each by itself; an empty table
gives no pieces. A kept column named like one of the results gets ``_of_doc`` behind its name. A task holds the texts of a
slice (2 MB, or one longer text by itself) with their ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.bpe import Vocabulary, encoder, lists, slices
from quire.session import scratch_path

CAPACITY = 1024
_OWN = ("piece", "start", "length", "ids_crc32", "ids", "part", "turn", "sequence_id", "offset")


class Pattern(NamedTuple):
    """``times`` sequences from ``first`` on, each holding ``pieces``: pairs of a length and a number, longest first."""

    first: int
    times: int
    pieces: tuple[tuple[int, int], ...]


def cut(tokens: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document."""
    head = tokens % capacity
    return [(0, head)] * (head > 0) + [(at, capacity) for at in range(head, tokens, capacity)]


def _tightest_pair(left: np.ndarray, longest: np.ndarray, gap: int) -> tuple[int, int] | None:
    """The two lengths with the greatest sum of at most ``gap``, the longer one first."""
    a = np.flatnonzero(left[: gap + 1])
    if not len(a):
        return None
    # the longest one for the rest; a length that has one piece only doesn't go with itself
    rest = np.minimum(gap - a, a)
    b = longest[rest]
    b = np.where((b == a) & (left[a] < 2), longest[np.minimum(rest, a - 1)], b)
    sums = np.where(b > 0, a + b, 0)
    best = len(sums) - 1 - int(np.argmax(sums[::-1]))
    return (int(a[best]), int(b[best])) if sums[best] else None


def patterns(counts: Sequence[int], capacity: int = CAPACITY) -> list[Pattern]:
    """Best-two-fit of ``counts[length]`` pieces of each length."""
    counts = np.array(counts, np.int64)
    out, first = [], 0
    lengths = np.arange(len(counts))
    while counts.any():
        left, gap = counts.copy(), capacity
        longest = np.maximum.accumulate(np.where(left > 0, lengths, 0))
        taken: dict[int, int] = {}
        while fits := int(longest[min(gap, len(longest) - 1)]):
            number = min(int(left[fits]), gap // fits)
            taken[fits] = number
            left[fits] -= number
            gap -= number * fits
            longest = np.maximum.accumulate(np.where(left > 0, lengths, 0))
        need = dict(taken)
        least = min(taken)
        if gap and sum(taken.values()) > 1:
            left[least] += 1
            longest = np.maximum.accumulate(np.where(left > 0, lengths, 0))
            pair = _tightest_pair(left, longest, gap + least)
            if pair and sum(pair) > least:
                taken[least] -= 1
                for length in pair:
                    taken[length] = taken.get(length, 0) + 1
                need = {length: max(need.get(length, 0), taken.get(length, 0)) for length in need | taken}
        pieces = tuple((length, number) for length, number in sorted(taken.items(), reverse=True) if number)
        # as long as every length has what a sequence asks for, the same choices are made again
        times = min((int(counts[length]) - need[length]) // number + 1 for length, number in pieces)
        for length, number in pieces:
            counts[length] -= times * number
        out.append(Pattern(first, times, pieces))
        first += times
    return out


class Places:
    """Where the piece of a length and rank goes: ranks of a length are dealt to patterns in their order."""

    def __init__(self, found: Sequence[Pattern], capacity: int = CAPACITY):
        rows: list[list[tuple[int, int, int, int]]] = [[] for _ in range(capacity + 1)]
        self.pieces = np.zeros(capacity + 1, np.int64)
        for pattern in found:
            offset = 0
            for length, number in pattern.pieces:
                rows[length].append((int(self.pieces[length]), number, pattern.first, offset))
                self.pieces[length] += number * pattern.times
                offset += length * number
        self._rows = [np.array(r, np.int64).reshape(-1, 4) for r in rows]

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequences and offsets."""
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        order = np.argsort(length, kind="stable")
        edges = np.flatnonzero(np.diff(length[order])) + 1
        for members in np.split(order, edges) if len(order) else []:
            rows, size = self._rows[length[members[0]]], length[members[0]]
            row = rows[np.searchsorted(rows[:, 0], rank[members], "right") - 1]
            within = rank[members] - row[:, 0]
            sequence[members] = row[:, 2] + within // row[:, 1]
            offset[members] = row[:, 3] + within % row[:, 1] * size
        return sequence, offset


def pieces(docs: DataFrame, vocabulary: Vocabulary, end_id: int, capacity: int = CAPACITY, keep: Sequence[str] = ("doc_id",),
           text: str = "text", ids: bool = True) -> DataFrame:
    """Write the pieces of all documents: ``(_keep_i, piece, start, length, ids_crc32[, ids], part, turn)``.

    ``turn`` counts the pieces of a length in ``part``, the task that wrote them. A task that is run again writes its
    pieces anew, and the table holds those of one run.
    """
    kept = docs.select(*[F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)], F.col(text).alias("text"))
    n = len(keep)
    own = [("piece", T.IntegerType(), pa.int32()), ("start", T.LongType(), pa.int64()), ("length", T.IntegerType(), pa.int32()),
           ("ids_crc32", T.LongType(), pa.int64()), ("part", T.IntegerType(), pa.int32()), ("turn", T.LongType(), pa.int64())]
    fields = [*kept.schema.fields[:n], *[T.StructField(name, kind) for name, kind, _ in own]]
    if ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType(), False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        part = TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for batch in batches:
            for a, b in slices(batch.column(n)):
                rows = batch.slice(a, b - a)
                coded, per_text, _, _ = enc.encode(rows.column(n))
                coded = np.insert(coded, per_text[1:], end_id).astype("<u4")  # an end id behind each document
                ends = per_text[1:] + np.arange(1, b - a + 1)
                found: list[tuple[int, int, int, int, int, int]] = []
                of, bounds = [], [0]
                for row, (begin, end) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist())):
                    for number, (start, size) in enumerate(cut(end - begin, capacity)):
                        at = begin + start
                        found.append((number, start, size, zlib.crc32(coded[at : at + size].tobytes()), part, seen[size]))
                        seen[size] += 1
                        of.append(row)
                        bounds.append(at + size)
                columns = [rows.column(i).take(pa.array(of, pa.int64())) for i in range(n)]
                columns += [pa.array(values, kind) for values, (_, _, kind) in zip(zip(*found), own)]
                if ids:
                    columns.append(lists(coded.astype(np.int32), np.array(bounds), pa.int32()))
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    path = scratch_path(docs.sparkSession, "pieces")
    kept.mapInArrow(run, T.StructType(fields)).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def pack(docs: DataFrame, vocabulary: Vocabulary, end_id: int, capacity: int = CAPACITY, keep: Sequence[str] = ("doc_id",),
         text: str = "text", ids: bool = True) -> DataFrame:
    """A row per piece: ``(*keep, piece, start, length, ids_crc32[, ids], sequence_id, offset)``.

    ``piece`` and ``start`` say which part of the document it is, ``sequence_id`` (from 0, without gaps) and ``offset`` where
    it stands. ``ids_crc32`` is of the ids as 32-bit numbers.
    """
    cut_up = pieces(docs, vocabulary, end_id, capacity, keep, text, ids)
    per_part = cut_up.groupBy("length", "part").agg(F.count(F.lit(1)).alias("_pieces"))
    # a row per task in each group
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranks = per_part.withColumn("_before", F.coalesce(F.sum("_pieces").over(before), F.lit(0))).drop("_pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for row in cut_up.groupBy("length").count().collect():  # a row per length, ``capacity`` at most
        counts[row["length"]] = row["count"]
    places = Places(patterns(counts, capacity), capacity)
    named = [F.col(f"_keep_{i}").alias(f"{c}_of_doc" if c in _OWN else c) for i, c in enumerate(keep)]
    own = ["piece", "start", "length", "ids_crc32", *["ids"] * ids]
    ranked = cut_up.join(ranks, ["length", "part"]).select(*named, *own, (F.col("turn") + F.col("_before")).alias("_rank"))
    fields = [*ranked.schema.fields[:-1], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(name).to_numpy(zero_copy_only=False) for name in ("length", "_rank"))
            sequence, offset = places.of(length, rank)
            columns = [*batch.columns[:-1], pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return ranked.mapInArrow(run, T.StructType(fields))


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves, from pieces with ids: ``(sequence_id, ids, lengths)``, ``lengths`` of the pieces in their order."""
    placed = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    rows = packed.groupBy("sequence_id").agg(placed.alias("p"))
    return rows.select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.length").alias("lengths"))
