import random
import zlib

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quire.llm.bpe import Vocabulary
from quire.llm.token_files import Sequence, read_token_files, write_token_files

V = Vocabulary(P.path("byte_bpe_50k.json"))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 9), st.integers(0, 2**40)), max_size=700))
def test_sequence(steps):
    values = np.cumsum(np.array(steps, np.int64)) if steps else np.zeros(0, np.int64)
    seq = Sequence.of(values)
    again = Sequence.load(memoryview(seq.dump()), seq.low_bits)
    assert again.every().tolist() == values.tolist()
    assert [again.select(i) for i in range(len(values))] == values.tolist()


def test_space_is_near_the_minimum():
    values = np.cumsum(np.random.default_rng(1).integers(1, 2000, 100_000))
    assert len(Sequence.of(values).dump()) * 8 / len(values) < np.log2(values[-1] / len(values)) + 3.2


def test_files_give_back_every_document(spark):
    rng = random.Random(3)
    texts = [None, "", "a", "word " * 3000, *["".join(rng.choice("ab c\né'") for _ in range(rng.randint(0, 90))) for _ in range(200)]]
    rows = [(k, t, 0) for k, t in zip([-5, -5, None, None, *rng.sample(range(10**12), 100), *[77] * 100], texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, first int").repartition(5)
    manifest = write_token_files(df, V)
    got = sorted(read_token_files(manifest).collect(), key=lambda r: r.start)
    lib = Tokenizer.from_file(V.path)
    want = [(k, lib.encode(t or "", add_special_tokens=False).ids + [0]) for k, t, _ in rows]
    order = lambda k: (k is not None, k or 0)
    assert sorted(((r.key, list(r.ids)) for r in got), key=lambda x: (order(x[0]), x[1])) == sorted(want, key=lambda x: (order(x[0]), x[1]))
    assert [order(r.key) for r in got] == sorted(order(r.key) for r in got)
    at = 0
    for r in got:
        assert (r.start, r.n_tokens) == (at, len(r.ids)) and r.crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens


def test_a_task_may_write_several_files(spark):
    rows = [(k, "one two three " * (k % 7)) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        whole, cut = (write_token_files(docs, V, file_ids=n) for n in (1 << 26, 50))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    read = [sorted((r.key, r.start, r.n_tokens, r.crc32) for r in read_token_files(m, ids=False).collect()) for m in (whole, cut)]
    assert read[0] == read[1] and [x[0] for x in read[0]] == list(range(300))
    assert cut.count() > whole.count()


def test_empty_table(spark):
    manifest = write_token_files(spark.createDataFrame([], "doc_id long, text string"), V)
    assert read_token_files(manifest).collect() == []
