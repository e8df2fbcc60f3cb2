"""Byte-level BPE over Arrow batches.

A task splits all texts of a slice at once (array operations over code points), lets the tokenizers library
encode every distinct piece once, and puts the ids together again by array look-ups. Splitting follows the
pattern that byte-level vocabularies share (``PATTERN``); ids, offsets and decoding equal those of encoding
each text by itself.

Defined results: a null text is encoded like an empty one (no ids) and decodes to no bytes; null ids decode to
null, ids outside the vocabulary to nothing. Control strings of a vocabulary are ordinary text. Rows that
repeat are encoded each by itself; columns that are not asked for are left behind before the encoder.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator, Sequence
from functools import cache, cached_property
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: The pattern that the splitter implements.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Bytes of text that are split at once, ids that are decoded at once, and pieces that a task remembers.
SLICE_BYTES = 2 << 20
SLICE_IDS = 1 << 19
CACHE_PIECES = 1 << 17
PARTING = b"\xff"

OTHER, LETTER, NUMBER, BLANK = range(4)


class Vocabulary(NamedTuple):
    """Where a vocabulary lies: a rank file (``token rank`` lines, tokens in base64) or a tokenizer's JSON file."""

    path: str
    kind: str = "json"


@cache
def byte_letters() -> tuple[str, ...]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it prints, else one above 255."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return tuple(chr(b if b in prints else next(rest)) for b in range(256))


@cache
def character_classes() -> np.ndarray:
    """The class of every code point."""
    classes = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for value, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
        for run in regex.finditer(pattern, every):
            classes[np.array(list(map(ord, run[0])))] = value
    return classes


def piece_starts(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where ``PATTERN`` begins a match, as a mask over the code points of several texts; ``firsts`` marks where
    texts begin."""
    n = len(points)
    cls = character_classes()[points]
    blank = cls == BLANK
    run = firsts.copy()
    run[1:] |= cls[1:] != cls[:-1]
    ends = np.ones(n, bool)
    ends[:-1] = firsts[1:]
    # a blank that a word follows closes its run; a space goes with that word
    before_word = np.zeros(n, bool)
    before_word[:-1] = blank[:-1] & ~blank[1:]
    before_word &= ~ends
    after_space = np.zeros(n, bool)
    after_space[1:] = points[:-1] == 32
    after_space &= ~firsts
    starts = (run & blank) | before_word | (run & ~blank & ~after_space)
    # contractions: an apostrophe by itself at a start, and letters that belong to it
    for i in np.flatnonzero(starts & (points == 39)):
        tail = points[i + 1 : i + 3].tolist()
        inside = 0 if ends[i] else 1 if i + 1 < n and (ends[i + 1] or len(tail) < 2) else 2
        if inside and tail[0] in (115, 116, 109, 100):
            size = 2
        elif inside == 2 and tuple(tail) in ((114, 101), (118, 101), (108, 108)):
            size = 3
        else:
            continue
        starts[i + 1 : i + size] = False
        if i + size < n:
            starts[i + size] = True
    return starts


def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in lines)}


def _spec(path: str) -> dict:
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    split = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        raise ValueError(f"{path} is not a byte-level vocabulary with the common pattern")
    return spec


def _placed(held: np.ndarray, at: int, new: list[int] | np.ndarray) -> np.ndarray:
    """``held`` with ``new`` from ``at`` on; room grows by doubling."""
    if at + len(new) > len(held):
        held = np.append(held, np.zeros(max(len(held), at + len(new) - len(held)), held.dtype))
    held[at : at + len(new)] = new
    return held


class Encoder:
    """A vocabulary in a task."""

    def __init__(self, vocabulary: Vocabulary):
        self._vocabulary = vocabulary
        if vocabulary.kind == "ranks":
            tokens = {r: t for t, r in _ranks(vocabulary.path).items()}
        else:
            spec = _spec(vocabulary.path)
            byte_of = {c: b for b, c in enumerate(byte_letters())}
            tokens = {x["id"]: x["content"].encode() for x in spec["added_tokens"]}
            tokens |= {i: bytes(byte_of[c] for c in t) for t, i in spec["model"]["vocab"].items() if byte_of.keys() >= set(t)}
        table = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.size = len(table)
        self._bytes = pa.array(table, pa.binary())
        self.lengths = np.array([len(t) for t in table], np.int64)
        self._letters = np.array([ord(c) for c in byte_letters()], "<u4")
        self._forget()

    @cached_property
    def _model(self):
        """The library's model; only who encodes needs it."""
        import tokenizers

        if self._vocabulary.kind != "ranks":
            return tokenizers.Tokenizer.from_file(self._vocabulary.path).model
        ranks = _ranks(self._vocabulary.path)
        name = lambda token: "".join(byte_letters()[b] for b in token)
        # every way to put a token together may be taken, the lowest rank first
        merges = [
            (name(t[:k]), name(t[k:]))
            for t in sorted(ranks, key=ranks.get)
            for k in range(1, len(t))
            if t[:k] in ranks and t[k:] in ranks
        ]
        return tokenizers.models.BPE(vocab={name(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True)

    def _forget(self) -> None:
        self._slots: dict[str, int] = {}
        self._flat, self._edges = np.zeros(1 << 16, np.int32), np.zeros(1 << 15, np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all texts one after the other: ids, bounds of texts among ids, bytes, bounds of texts among bytes."""
        texts = texts.cast(pa.string()).fill_null("") if texts.null_count else texts.cast(pa.string())
        offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
        data = texts.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
        bounds = offsets - offsets[0]
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64), raw, bounds
        points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        at = np.flatnonzero((raw & 0xC0) != 0x80)  # the byte where each character begins
        firsts = np.zeros(len(points), bool)
        filled = bounds[:-1][np.diff(bounds) > 0]
        firsts[np.searchsorted(at, filled)] = True
        starts = at[piece_starts(points, firsts)]
        piece_offsets = np.append(starts, len(raw)).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(starts), pa.py_buffer(piece_offsets), pa.py_buffer(raw.tobytes()))
        coded = pieces.dictionary_encode()
        slots = self._look_up(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        first, last = self._edges[slots], self._edges[slots + 1]
        sizes = last - first
        ends = np.cumsum(sizes)
        ids = self._flat[np.arange(ends[-1]) + np.repeat(first - ends + sizes, sizes)]
        per_text = np.append(0, ends)[np.searchsorted(starts, bounds)]
        return ids, per_text, raw, bounds

    def _look_up(self, pieces: list[str]) -> np.ndarray:
        if len(self._slots) > CACHE_PIECES:
            self._forget()
        slots = list(map(self._slots.get, pieces))
        new = [i for i, slot in enumerate(slots) if slot is None]
        if new:
            known = len(self._slots)
            fresh = [pieces[i] for i in new]
            # all at once to their byte letters; no text in UTF-8 has the byte that parts them
            joined = np.frombuffer(PARTING.join([piece.encode("utf-8") for piece in fresh]), np.uint8)
            mapped = self._letters[joined].tobytes().decode("utf-32-le").split(byte_letters()[PARTING[0]])
            tokenize = self._model.tokenize
            coded = [[t.id for t in tokenize(piece)] for piece in mapped]
            edges = int(self._edges[known]) + np.cumsum([len(x) for x in coded])
            self._flat = _placed(self._flat, int(self._edges[known]), list(chain.from_iterable(coded)))
            self._edges = _placed(self._edges, known + 1, edges)
            self._slots.update(zip(fresh, range(known, known + len(fresh))))
            for slot, i in enumerate(new, known):
                slots[i] = slot
        return np.array(slots, np.int64)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids one after the other, and where each id's bytes begin (and the last end)."""
        ids = np.where((ids < 0) | (ids >= self.size), self.size, ids)
        lengths = np.append(self.lengths, 0)[ids]
        edges = np.append(0, np.cumsum(lengths))
        taken = self._bytes.take(pa.array(ids[ids < self.size], pa.int64()))
        data = taken.buffers()[2]
        return np.frombuffer(data, np.uint8)[: edges[-1]] if data else np.zeros(0, np.uint8), edges


@cache
def encoder(vocabulary: Vocabulary) -> Encoder:
    return Encoder(vocabulary)


def ranges(sizes: Sequence[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to ``most``, one row at least."""
    begin = total = 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have about ``most`` bytes together."""
    return ranges(pa.compute.binary_length(texts).fill_null(0).to_pylist(), most)


def lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))


def encode(df: DataFrame, vocabulary: Vocabulary, keep: Sequence[str] = ("doc_id",), text: str = "text", offsets: bool = False) -> DataFrame:
    """``keep`` columns, ``ids`` and ``n_split``, the number of ids that begin inside a character.

    With ``offsets`` also ``byte_starts`` of each id in the UTF-8 text, and ``char_starts`` and ``char_ends``: an
    id that holds a part of a character has that whole character's place.
    """
    kept = df.select(*keep, text)
    names = list(keep)
    ints = T.ArrayType(T.IntegerType(), False)
    fields = [*kept.select(*names).schema.fields, T.StructField("ids", ints), T.StructField("n_split", T.LongType())]
    if offsets:
        fields += [T.StructField(n, ints) for n in ("byte_starts", "char_starts", "char_ends")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            for a, b in slices(batch.column(len(names))):
                part = batch.slice(a, b - a)
                ids, per_text, raw, bounds = enc.encode(part.column(len(names)))
                edges = np.append(0, np.cumsum(enc.lengths[ids]))
                inside = (raw & 0xC0) == 0x80
                splits = np.append(0, np.cumsum(inside[edges[:-1]])) if len(ids) else np.zeros(1, np.int64)
                columns = [*[part.column(i) for i in range(len(names))], lists(ids, per_text, pa.int32()), pa.array(np.diff(splits[per_text]), pa.int64())]
                if offsets:
                    number = np.append(np.cumsum(~inside) - 1, 0)  # of the character that a byte is in
                    text_of = np.repeat(np.arange(len(bounds) - 1), np.diff(per_text))
                    base = bounds[:-1][text_of]
                    first_char = number[base] if len(ids) else number[:0]
                    starts, ends = edges[:-1], edges[1:]
                    for x in (starts - base, number[starts] - first_char, number[ends - 1] + 1 - first_char):
                        columns.append(lists(x if len(ids) else number[:0], per_text, pa.int32()))
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return kept.mapInArrow(run, T.StructType(fields))


def decode(df: DataFrame, vocabulary: Vocabulary, keep: Sequence[str] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """``keep`` columns and ``decoded``, the bytes of ``ids``; a character that several ids share is whole again.

    Bytes are returned because ids cut out of a longer list may begin or end inside a character.
    """
    names = list(keep)
    kept = df.select(*names, ids) if ids not in names else df.select(*names)
    at = kept.columns.index(ids)
    fields = [*kept.select(*names).schema.fields, T.StructField("decoded", T.BinaryType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            counts = pa.compute.list_value_length(batch.column(at)).fill_null(0).to_numpy(zero_copy_only=False)
            for a, b in ranges(counts.tolist(), SLICE_IDS):
                part = batch.slice(a, b - a)
                flat = part.column(at).flatten().fill_null(-1).to_numpy(zero_copy_only=False)
                data, edges = enc.decode(flat)
                bounds = edges[np.append(0, np.cumsum(counts[a:b]))].tolist()
                data = memoryview(data)
                decoded = [bytes(data[x:y]) if ok else None for x, y, ok in zip(bounds[:-1], bounds[1:], part.column(at).is_valid().to_pylist())]
                columns = [*[part.column(i) for i in range(len(names))], pa.array(decoded, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return kept.mapInArrow(run, T.StructType(fields))
