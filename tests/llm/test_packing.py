import random
import zlib
from collections import Counter

import public_tokenizers
import pytest

from quire.llm import packing as P
from quire.llm import queries
from quire.llm.queries import JSON


def one_by_one(lengths, capacity):
    """Best-two-fit, a sequence at a time and a piece at a time."""
    left, out = Counter(lengths), []
    while left:
        bin_, gap = [], capacity
        while fits := max((x for x in left if x <= gap), default=0):
            bin_.append(fits)
            gap -= fits
            left -= Counter([fits])
        if len(bin_) > 1:
            least = bin_[-1]
            pool = left + Counter([least])
            pairs = [(a + b, a, b) for a in pool for b in pool if b <= a and a + b <= gap + least and (a != b or pool[a] > 1)]
            if pairs and max(pairs)[0] > least:
                _, a, b = max(pairs)
                bin_ = sorted([*bin_[:-1], a, b], reverse=True)
                left = pool - Counter([a, b])
        out.append(tuple(bin_))
    return out


@pytest.mark.parametrize("seed", range(12))
def test_patterns_equal_best_two_fit_one_by_one(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 24, 60])
    kinds = rng.sample(range(1, capacity + 1), rng.randint(1, min(capacity, 12)))
    lengths = [rng.choice(kinds) for _ in range(rng.choice([1, 7, 60, 400]))]
    counts = [lengths.count(x) for x in range(capacity + 1)]
    found = P.patterns(counts, capacity)
    want = one_by_one(lengths, capacity)
    got = [tuple(x for x, n in p.pieces for _ in range(n)) for p in found for _ in range(p.times)]
    assert got == want
    assert [p.first for p in found] == [sum(q.times for q in found[:i]) for i in range(len(found))]
    assert len(found) <= sum(capacity // x for x in kinds)


def test_two_pieces_replace_the_shortest():
    # 6 + 3 leave 1 of 10; 2 + 2 fill it
    counts = [0] * 11
    counts[6], counts[3], counts[2] = 1, 1, 2
    assert P.patterns(counts, 10)[0].pieces == ((6, 1), (2, 2))


def test_many_pieces_take_few_patterns():
    rng = random.Random(1)
    counts = [0] + [rng.randrange(10**9) for _ in range(1024)]
    found = P.patterns(counts)
    total = sum(n * x for x, n in enumerate(counts))
    assert sum(p.times for p in found) <= 1.02 * total / 1024 and len(found) < 7600


def check(rows, texts, capacity, end_id):
    """Rows of ``pack`` against the tokenizer, and against what a packing is."""
    import tokenizers

    tok = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert sorted(by_doc) == sorted(texts)
    for doc, text in texts.items():
        ids = tok.encode(text or "", add_special_tokens=False).ids + [end_id]
        got = sorted(by_doc[doc], key=lambda r: r.piece)
        assert [r.piece for r in got] == list(range(len(got)))
        assert [r.start for r in got] == [sum(x.length for x in got[:i]) for i in range(len(got))]
        assert sum(r.length for r in got) == len(ids) and all(r.length == capacity for r in got[1:])
        assert (len(got) == 1) == (len(ids) <= capacity)
        for r in got:
            part = ids[r.start : r.start + r.length]
            assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
    assert sorted(by_seq) == list(range(len(by_seq)))
    for held in by_seq.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    lengths = [r.length for r in rows]
    assert sorted(tuple(sorted((r.length for r in held), reverse=True)) for held in by_seq.values()) == sorted(one_by_one(lengths, capacity))


def test_the_query_packs_all_documents(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    check(queries.op11_packing(spark, sf).collect(), texts, 1024, 2)


def test_odd_rows(spark):
    rng = random.Random(3)
    texts = [None, "", " ", "a", "a", *[" ".join(rng.choice(["alpha", "bêta", "γ", "don't", "\n\n"]) for _ in range(rng.randrange(60))) for _ in range(60)], "word " * 30000]
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in enumerate(texts)], "doc_id long, text string, length int, part string").repartition(3)
    got = P.pack(df, JSON, 2, 16, keep=["doc_id", "length", "part"])
    rows = got.collect()
    check(rows, dict(enumerate(texts)), 16, 2)
    assert {(r.length_of_doc, r.part_of_doc) for r in rows} == {(7, "x")}
    whole = {r.sequence_id: r for r in P.sequences(got).collect()}
    for r in rows:
        assert whole[r.sequence_id]["ids"][r.offset : r.offset + r.length] == r["ids"]
    assert all(sum(s.lengths) == len(s["ids"]) <= 16 for s in whole.values())
    again = P.pack(df.unionByName(df), JSON, 2, 16, ids=False)
    assert again.count() == 2 * len(rows)
    assert P.pack(df.limit(0), JSON, 2, 16).collect() == []
