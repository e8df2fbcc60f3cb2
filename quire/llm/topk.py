"""Exact top-k by inner product with MaxScore.

A query's terms are the dimensions in which it isn't zero. In a block of candidates a term can add no more than the larger
of its weight times the block's least and greatest value. Terms are sorted by that bound; those that together
can't lift a candidate to the query's k-th best score so far are non-essential. Only candidates in the essential
terms' postings are scored, and the other terms are looked up only for candidates that can still reach that score.
Each block gives its own best k, and all blocks' lists are merged.

Candidates are packed into blocks of ``BLOCK`` vectors (with postings, by dimension), queries into blocks of
``QUERIES``, and every block of queries meets every block of candidates: a stated query set against all rows, in blocks. A task
holds one block of either at a time.

Defined results: vectors that are null, or hold a null or a component that isn't finite,
take no part, neither do rows without an id. Components of any size are scored exactly; a result's score that doesn't fit a long is an error. Vectors of different length don't meet. Of equal scores the smaller id
comes first. Rows that repeat are rows of their own: a query's own row is left out, its copies are not, and
queries that share an id get a list each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.session import settle

BLOCK = 4096
QUERIES = 512
SHARDS = 8  # groups of candidate blocks, at least; each gets a copy of every query block


class Block:
    """Candidates in column order, with the postings of every dimension."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, values: np.ndarray):
        self.ids, self.rows = ids, rows
        self.columns = np.ascontiguousarray(values.T)
        self.least, self.most = self.columns.min(axis=1), self.columns.max(axis=1)
        # None: every candidate is in this dimension's postings
        self.postings = [None if c.all() else np.flatnonzero(c) for c in self.columns]


def max_score(block: Block, query: np.ndarray, own: int, k: int, bar: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Ids and scores of the block's best ``k`` for one query that reach ``bar``, and the bar that they raise.

    Values are whole numbers in floats; the caller sees to it that sums stay exact."""
    terms = np.flatnonzero(query)
    weights = query[terms]
    bounds = np.maximum(np.maximum(weights * block.least[terms], weights * block.most[terms]), 0)
    order = np.argsort(bounds, kind="stable")
    terms, weights, bounds = terms[order], weights[order], bounds[order]
    reach = np.cumsum(bounds)  # of the terms up to each
    # a candidate in none of the essential postings scores what the others reach, at most
    first = int(np.searchsorted(reach, bar, side="left")) if bar > 0 else 0
    if first == len(terms) and (first or bar > 0):
        return block.ids[:0], query[:0], bar
    scores = np.zeros(len(block.ids))
    met = np.zeros(len(block.ids), bool) if first else np.ones(len(block.ids), bool)
    dense = [i for i in range(first, len(terms)) if block.postings[terms[i]] is None]
    if dense:
        scores += weights[dense] @ block.columns[terms[dense]]
        met[:] = True
    for i in range(first, len(terms)):
        docs = block.postings[terms[i]]
        if docs is not None:
            scores[docs] += weights[i] * block.columns[terms[i], docs]
            met[docs] = True
    met &= block.rows != own
    docs = np.flatnonzero(met)
    left = scores[docs]
    for i in range(first - 1, -1, -1):
        going = left + reach[i] >= bar
        docs, left = docs[going], left[going]
        if not len(docs):
            break
        left = left + weights[i] * block.columns[terms[i], docs]
    keep = left >= bar
    docs, left = docs[keep], left[keep]
    if len(docs) > k:
        least = np.partition(left, len(left) - k)[len(left) - k]
        keep = left >= least  # ties stay until ids decide
        docs, left = docs[keep], left[keep]
        best = np.lexsort((block.ids[docs], -left))[:k]
        docs, left = docs[best], left[best]
    if len(docs) == k:
        bar = max(bar, float(left.min()))
    return block.ids[docs], left, bar


def _packed(values: np.ndarray, scale: float) -> tuple[bytes, float]:
    """Vectors as whole numbers of 32 bits where these fit, else as they are; and the largest whole number."""
    with np.errstate(over="ignore"):
        whole = np.floor(values * scale)
    largest = float(np.abs(whole).max(initial=0))
    return (whole.astype(np.int32) if largest < 1 << 31 else values).tobytes(), largest


def _matrix(data: bytes, n: int, dims: int, scale: float) -> np.ndarray:
    """Whole numbers in floats; infinite where a float is too small for them."""
    if len(data) == 4 * n * dims:
        return np.frombuffer(data, np.int32).reshape(n, dims).astype(np.float64)
    with np.errstate(over="ignore"):
        return np.floor(np.frombuffer(data, np.float64).reshape(n, dims) * scale)


def _integers(data: bytes, n: int, dims: int, scale: float) -> np.ndarray:
    """Whole numbers of any size, as Python's."""
    if len(data) == 4 * n * dims:
        return np.frombuffer(data, np.int32).reshape(n, dims).astype(object)
    values = np.frombuffer(data, np.float64)
    out = np.empty(len(values), object)
    out[:] = [math.floor(x * scale if math.isfinite(x * scale) else Fraction(x) * Fraction(scale)) for x in values.tolist()]
    return out.reshape(n, dims)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row whose id is divisible by ``every``, the ``k`` other rows with the
    highest inner products of ``floor(scale * component)``."""
    usable = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    rows = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & usable)
    rows = rows.select(F.col(key).cast("bigint").alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"), F.size(vector).alias("dims"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        counts: dict[int, int] = {}

        def block(dims: int) -> pa.RecordBatch:
            ids = np.concatenate([x for x, _ in held[dims]])
            values = np.concatenate([v for _, v in held[dims]])
            del held[dims], counts[dims]
            data, largest = _packed(values, scale)
            row = {"dims": [dims], "n": [len(ids)], "largest": [largest], "ids": [ids.tobytes()], "data": [data]}
            return pa.RecordBatch.from_pydict(row, pa.schema([("dims", pa.int32()), ("n", pa.int32()), ("largest", pa.float64()), ("ids", pa.binary()), ("data", pa.binary())]))

        for batch in batches:
            ids, dims = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            for d in np.unique(dims).tolist():
                mine = np.flatnonzero(dims == d)
                for a in range(0, len(mine), BLOCK):
                    some = mine[a : a + BLOCK]
                    flat = batch.column(1).take(pa.array(some)).flatten().to_numpy(zero_copy_only=False)
                    held.setdefault(d, []).append((ids[some], flat.reshape(len(some), d)))
                    counts[d] = counts.get(d, 0) + len(some)
                    if counts[d] >= BLOCK:
                        yield block(d)
        for d in list(held):
            yield block(d)

    blocks = rows.mapInArrow(pack, "dims int, n int, largest double, ids binary, data binary")
    # numbered once and written, so that a row is the same row on both sides
    blocks = settle(blocks.withColumn("block", F.monotonically_increasing_id()))
    asked = blocks.mapInArrow(_queries(every, scale), "dims int, q_largest double, q_rows binary, q_ids binary, q_data binary")
    shards = max(SHARDS, vectors.sparkSession.sparkContext.defaultParallelism)
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    held = blocks.withColumn("shard", F.pmod(F.xxhash64("block"), F.lit(shards)).cast("int"))
    pairs = held.join(asked, ["dims", "shard"]).select("block", "n", "largest", "ids", "data", "q_largest", "q_rows", "q_ids", "q_data", "dims")
    found = pairs.mapInArrow(_search(k, scale), "query_id long, query_row binary, vec_id long, score long, beyond boolean")
    best = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "beyond", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    score = F.when(F.col("beyond"), F.raise_error(F.lit("a score doesn't fit a long")).cast("bigint")).otherwise(F.col("score"))
    return ranked.select("query_id", "rank", "vec_id", score.alias("score"))


def _queries(every: int, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["dims", "q_largest", "q_rows", "q_ids", "q_data"]
        schema = pa.schema(list(zip(names, [pa.int32(), pa.float64(), pa.binary(), pa.binary(), pa.binary()])))
        for batch in batches:
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], np.int64)
                wide = len(r["data"]) != 4 * r["n"] * r["dims"]
                values = np.frombuffer(r["data"], np.float64 if wide else np.int32).reshape(r["n"], r["dims"])
                mine = np.flatnonzero(ids % every == 0)
                for a in range(0, len(mine), QUERIES):
                    some = mine[a : a + QUERIES]
                    # a row is its block's number and its place there
                    at = np.stack([np.full(len(some), r["block"], np.int64), some.astype(np.int64)], axis=1)
                    data, largest = _packed(values[some], scale if wide else 1.0)
                    row = [[r["dims"]], [largest], [at.tobytes()], [ids[some].tobytes()], [data]]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(row, schema)], schema=schema)

    return run


def _search(k: int, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bars: dict[bytes, float] = {}  # of queries, from what this task has seen
        last, block = None, None
        schema = pa.schema([("query_id", pa.int64()), ("query_row", pa.binary()), ("vec_id", pa.int64()), ("score", pa.int64()), ("beyond", pa.bool_())])
        for batch in batches:
            for i in range(batch.num_rows):
                r = {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}
                if last != r["block"]:
                    values = _matrix(r["data"], r["n"], r["dims"], scale)
                    block = Block(np.frombuffer(r["ids"], np.int64), np.arange(r["n"]), values)
                    last = r["block"]
                ids = np.frombuffer(r["q_ids"], np.int64)
                rows = np.frombuffer(r["q_rows"], np.int64).reshape(-1, 2)
                queries = _matrix(r["q_data"], len(ids), r["dims"], scale)
                reach = r["largest"] * r["q_largest"] * r["dims"]
                fits = max(reach, r["largest"], r["q_largest"]) < 1 << 62
                exact = fits and reach < 1 << 53
                if not fits:
                    wide = _integers(r["data"], r["n"], r["dims"], scale), _integers(r["q_data"], len(ids), r["dims"], scale)
                if len(bars) > 1 << 20:
                    bars.clear()
                got: list[tuple[int, bytes, int, int, bool]] = []
                for q in range(len(ids)):
                    row = rows[q].tobytes()
                    own = int(rows[q, 1]) if rows[q, 0] == r["block"] else -1
                    if exact:
                        found, scores, bars[row] = max_score(block, queries[q], own, k, bars.get(row, -np.inf))
                    elif fits:
                        found, scores = _by_whole_numbers(block, queries[q], own, k)
                    else:
                        found, scores = _by_integers(block, wide[0], wide[1][q], own, k)
                    got += [(int(ids[q]), row, int(v), max(-(1 << 63), min((1 << 63) - 1, int(s))), not -(1 << 63) <= s < 1 << 63) for v, s in zip(found, scores)]
                columns = list(zip(*got)) if got else [[], [], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def _by_whole_numbers(block: Block, query: np.ndarray, own: int, k: int) -> tuple[list[int], list[int]]:
    """For values so large that sums of floats are not exact."""
    scores = query.astype(np.int64) @ block.columns.astype(np.int64)
    docs = np.flatnonzero(block.rows != own)
    best = docs[np.lexsort((block.ids[docs], -scores[docs]))[:k]]
    return block.ids[best].tolist(), scores[best].tolist()


def _by_integers(block: Block, values: np.ndarray, query: np.ndarray, own: int, k: int) -> tuple[list[int], list[int]]:
    """For values so large that sums of longs could overflow."""
    scores = [sum(map(int.__mul__, map(int, query), map(int, v))) for v in values]
    best = sorted((n for n in range(len(scores)) if block.rows[n] != own), key=lambda n: (-scores[n], block.ids[n]))[:k]
    return block.ids[best].tolist(), [scores[n] for n in best]
