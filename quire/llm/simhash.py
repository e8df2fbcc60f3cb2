"""Near-duplicates by SimHash fingerprints and vantage-point trees.

A fingerprint's bit is set if over half the hashes of a text's word shingles have it. Texts whose fingerprints differ
in few bits are linked. Equal fingerprints are one before any comparison, so copies cost nothing.

A vantage-point tree splits fingerprints by their distance to a vantage point: those within its radius go inside, the
rest outside. By the triangle inequality two fingerprints within ``most`` bits can only lie on different sides if the
inner one is within ``most`` of the radius; those are sent outside as well. So every link has both ends in
some cell, and cells are searched by themselves. The upper tree is fitted on a bounded sample (``SAMPLE``
fingerprints, the least by hash) and every fingerprint is sent through it; inside a cell the tree goes on over all its members.
A cell of more than ``CELL`` members is cut into blocks and every pair of blocks is searched, so nothing is left out.
A part that no vantage point makes cheaper, such as many fingerprints within few bits, is compared in blocks; blocks
whose members are all joined are passed over.

A cell reports links that connect the same fingerprints as all its links do, one less than connected
fingerprints at most, and links over all cells are joined to components.

Defined results: a null text and one without words have fingerprint zero, which links like any other; a text with fewer words than a
shingle has them all as its one shingle; rows that repeat, or share a key, have their own rows in the result and the
same component; a component all of whose keys are null has none.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.components import components
from quire.session import settle

SEED = 42
SAMPLE = 1 << 15
LEAF = 1 << 16  # members of a cell that the upper tree aims at
CELL = 1 << 19  # members of a cell that are searched in one task
BRUTE = 512  # members that are compared pair by pair
PIVOTS = 3  # vantage points that are tried for a part

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingles(text: bytes, width: int) -> Iterator[bytes]:
    """Of a text in UTF-8. Words end at the six ASCII blanks."""
    words = text.translate(_LOWER).split()
    return map(b" ".join, zip(*[words[i:] for i in range(width)])) if len(words) >= width else iter([b" ".join(words)] if words else [])


def fingerprint(text: bytes, width: int = 3) -> int:
    """Of a text in UTF-8, as an unsigned number."""
    hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles(text, width)], np.uint64)
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text", width: int = 3) -> DataFrame:
    """``keep`` columns and ``fp``, the fingerprint's 64 bits as a signed number."""
    kept = docs.select(*keep, text)
    names = list(keep)
    fields = [*kept.select(*names).schema.fields, T.StructField("fp", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(names)).cast(pa.binary())
            found = np.array([fingerprint(x.as_py() or b"", width) for x in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(names))], pa.array(found)], [f.name for f in fields])

    return kept.mapInArrow(run, T.StructType(fields))


def _split(fps: np.ndarray, vantage: np.uint64) -> tuple[np.ndarray, int]:
    """Distances to a vantage point, and the radius that halves them best."""
    far = np.bitwise_count(fps ^ vantage)
    counts = np.cumsum(np.bincount(far, minlength=65))
    return far, int(np.argmin(np.abs(counts - len(fps) / 2)))


class Tree:
    """The upper tree: nodes ``(vantage, radius, inside, outside)``; a child below zero is cell ``-1 - child``."""

    def __init__(self, sample: np.ndarray, cells: int, most: int):
        self.nodes: list[tuple[int, int, int, int]] = []
        self.cells, self.most = 0, most
        depth = max(0, int(np.ceil(np.log2(max(1, cells)))))
        self.root = self._grow(np.unique(sample), depth)

    def _grow(self, fps: np.ndarray, depth: int) -> int:
        if depth > 0 and len(fps) >= 32:
            vantage = fps[len(fps) // 2]
            far, radius = _split(fps, vantage)
            inside, outside = fps[far <= radius], fps[far > radius - self.most]
            if len(inside) and len(outside) < 0.95 * len(fps):
                at = len(self.nodes)
                self.nodes.append((int(vantage), radius, 0, 0))
                a, b = self._grow(inside, depth - 1), self._grow(outside, depth - 1)
                self.nodes[at] = (int(vantage), radius, a, b)
                return at
        self.cells += 1
        return -self.cells

    def cells_of(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells, and the number of the fingerprint that goes there."""
        cells, who = [], []
        todo = [(self.root, np.arange(len(fps)))]
        while todo:
            at, members = todo.pop()
            if at < 0 or not len(members):
                cells.append(np.full(len(members), -1 - at if at < 0 else 0))
                who.append(members)
                continue
            vantage, radius, a, b = self.nodes[at]
            far = np.bitwise_count(fps[members] ^ np.uint64(vantage)).astype(np.int64)
            todo += [(a, members[far <= radius]), (b, members[far > radius - self.most])]
        return np.concatenate(cells), np.concatenate(who)


def _tops(parent: np.ndarray, at: np.ndarray) -> np.ndarray:
    top = parent[at]
    while (parent[top] != top).any():
        top = parent[top]
    parent[at] = top
    return top


def _halves(part: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Numbers of those inside and outside of a vantage point's radius, or None if searching both costs as much as comparing all pairs."""
    for i in range(1, PIVOTS + 1):
        far, radius = _split(part, part[i * len(part) // (PIVOTS + 1)])
        far = far.astype(np.int64)
        inside, outside = np.flatnonzero(far <= radius), np.flatnonzero(far > radius - most)
        # both are smaller than the part then, so this comes to an end
        if len(inside) ** 2 + len(outside) ** 2 < 0.9 * len(part) ** 2:
            return inside, outside
    return None


def links_in(fps: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Pairs of ``fps`` (distinct) that connect what pairs of at most ``most`` differing bits connect."""
    parent = np.arange(len(fps))
    out: list[tuple[int, int]] = []
    todo = [np.arange(len(fps))]
    while todo:
        part = todo.pop()
        if len(part) > BRUTE and (halves := _halves(fps[part], most)):
            todo += [part[half] for half in halves]
            continue
        for i in range(0, len(part), BRUTE):
            left = part[i : i + BRUTE]
            for j in range(i, len(part), BRUTE):
                right = part[j : j + BRUTE]
                one, two = _tops(parent, left), _tops(parent, right)
                if (one == one[0]).all() and (two == one[0]).all():
                    continue  # joined already
                x, y = np.nonzero(np.bitwise_count(fps[left][:, None] ^ fps[right][None, :]) <= most)
                new = one[x] != two[y]
                x, y = x[new], y[new]
                # one pair for each two that are not joined yet
                _, first = np.unique(one[x] * len(fps) + two[y], return_index=True)
                for a, b in zip(left[x[first]].tolist(), right[y[first]].tolist()):
                    ra, rb = (int(_tops(parent, np.array([n]))[0]) for n in (a, b))
                    if ra != rb:
                        parent[max(ra, rb)] = min(ra, rb)
                        out.append((int(fps[a]), int(fps[b])))
    return out


def links(fps: DataFrame, most: int = 3) -> DataFrame:
    """Links ``(a, b)`` between fingerprints, from a table of distinct ones ``(fp)`` that has been written."""
    total = fps.count()
    sample = fps.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).select("fp").collect() if total > LEAF else []
    tree = Tree(np.array([r.fp for r in sample], np.int64).view(np.uint64), min(len(sample) // 32, -(-total // LEAF)), most)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(0).to_numpy(zero_copy_only=False)
            cells, who = tree.cells_of(found.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(found[who])], ["cell", "fp"])

    sent = settle(fps.select("fp").mapInArrow(send, "cell long, fp long"))
    blocks = sent.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("blocks"))
    sent = sent.join(blocks, "cell").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    # pairs of blocks: (own, other) in ascending order, for every other
    pairs = sent.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select("cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")

    def search(table: pa.Table) -> pa.Table:
        found = links_in(np.unique(table.column("fp").to_numpy().view(np.uint64)), most)
        ends = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.table({"a": ends[:, 0], "b": ends[:, 1]})

    return pairs.groupBy("cell", "i", "j").applyInArrow(search, "a long, b long")


def near_duplicates(docs: DataFrame, keep: Sequence[str] = ("doc_id",), key: str = "doc_id", text: str = "text", width: int = 3, most: int = 3) -> DataFrame:
    """``keep`` columns, ``fp``, ``component_id``, the smallest key of all rows that links lead to, and ``component_fp``,
    a fingerprint of the component that no other component has."""
    marked = settle(fingerprints(docs, list(dict.fromkeys([*keep, key])), text, width))
    distinct = settle(marked.groupBy("fp").agg(F.min(key).alias("least")))
    roots = components(links(distinct, most)).select(F.col("node").alias("fp"), "root")
    placed = distinct.join(roots, "fp", "left").withColumn("component_fp", F.coalesce("root", "fp"))
    ids = placed.groupBy("component_fp").agg(F.min("least").alias("component_id"))
    placed = placed.join(ids, "component_fp").select("fp", "component_fp", "component_id")
    return marked.join(placed, "fp").select(*keep, "fp", "component_id", "component_fp")


def one_of_each(docs: DataFrame, key: str = "doc_id", **how) -> DataFrame:
    """The row that stays of each component: that with the smallest key, of equal ones the first by ``row``.

    ``docs`` has a column ``row`` that tells rows apart.
    """
    marked = near_duplicates(docs, keep=["row", key], key=key, **how)
    return marked.groupBy("component_fp").agg(F.min_by("row", F.struct(F.col(key).isNull(), key, "row")).alias("row")).select("row")
