import base64

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from tokenizers import Tokenizer

from quire.llm import bpe

pa = bpe.pa
RANKS = bpe.Vocabulary(P.path("byte_bpe_multi_50k.tiktoken"), "ranks")
JSON = bpe.Vocabulary(P.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def tik():
    with open(RANKS.path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def lib():
    t = Tokenizer.from_file(JSON.path)
    t.encode_special_tokens = True
    return t


def ids_of(vocabulary, texts):
    ids, bounds, _, _ = bpe.encoder(vocabulary).encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]


HARD = [
    "", " ", "  ", "\n", " \n x", "a  b", "a\n\nb", "a \n", "'s", "x's it'll 'd''s '' 'sabc I'ves", " 's", "\n's", "'", "a'", "''ll", "'re", "'r", "'l'll",
    " x", "　　日本語 1２３", "éé", "👩‍👩‍👧 \x00\x1c\x1f\x85z", "²³½", "<|endoftext|> a", "a" * 5000, "=" * 999, "0123456789" * 50, "ha" * 300, "'t 't't",
]


def test_pattern_is_the_one_of_the_vocabularies():
    assert bpe.PATTERN == P.PATTERN


def test_hard_texts(tik, lib):
    assert ids_of(RANKS, HARD) == [tik.encode_ordinary(t) for t in HARD]
    assert ids_of(JSON, HARD) == [lib.encode(t, add_special_tokens=False).ids for t in HARD]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet="'stremvldSx \n\t1_é ", max_size=40)), max_size=6))
def test_any_texts(tik, lib, texts):
    assert ids_of(RANKS, texts) == [tik.encode_ordinary(t) for t in texts]
    assert ids_of(JSON, texts) == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_encode_and_decode(spark, tik, lib):
    texts = [*HARD, None, "日本語🙂" * 20, "日本語🙂" * 20]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids int, decoded string").repartition(3)
    coded = bpe.encode(df, JSON, offsets=True)
    back = bpe.decode(coded, JSON)
    rows = {r.doc_id: r for r in coded.join(back, "doc_id").collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        t = t or ""
        want = lib.encode(t, add_special_tokens=False)
        r = rows[i]
        assert list(r.ids) == want.ids and bytes(r.decoded).decode() == t
        assert list(zip(r.char_starts, r.char_ends)) == want.offsets
        raw = t.encode()
        assert r.n_split == sum(raw[b] & 0xC0 == 0x80 for b in r.byte_starts)


def test_odd_ids(spark):
    df = spark.createDataFrame([Row(doc_id=1, ids=[-1, 50, 99999999]), Row(doc_id=2, ids=None), Row(doc_id=None, ids=[])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.decoded for r in bpe.decode(df, JSON).collect()}
    assert got[2] is None and bytes(got[None]) == b"" and len(got[1]) == 1


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(empty, RANKS), RANKS).collect() == []
