import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quire.llm import queries
from quire.llm import variants as V


def edits(word, letters):
    """All words one edit away."""
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    out |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in letters}
    out |= {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters}
    return out - {word}


def plain(counted, factor=10):
    letters = {c for w in counted for c in w}
    near = {w: sorted((x for x in edits(w, letters) if x in counted), key=lambda x: (-counted[x], x)) for w in counted}
    form = {w: (x[0] if x and counted[x[0]] >= factor * counted[w] else None) for w, x in near.items()}
    out = {}
    for w in counted:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, counted[w], len(near[w]), counted[form[w]] if form[w] else None)
    return out


def got(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def some_words(rng, n, letters, least=1):
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(least, least + 7))) for _ in range(n // 4)]
    words = set(base)
    while len(words) < n:
        words.add(rng.choice(sorted(edits(rng.choice(base), letters))))
    return {w: rng.choice([2, 3, 5, 30, 50, 400, 5000]) for w in words if w}


@pytest.mark.parametrize("block,rows,cells", [(1024, 1 << 16, 1 << 22), (7, 50, 300)])
def test_variants_equal_all_single_edits(spark, monkeypatch, block, rows, cells):
    for name, value in (("BLOCK", block), ("ROWS", rows), ("CELLS", cells)):
        monkeypatch.setattr(V, name, value)
    counted = some_words(random.Random(block), 700, "abß𝄞e") | {"a" * k: 10 ** min(k, 9) for k in range(1, 14)}
    df = spark.createDataFrame([*counted.items(), (None, 5)], "word string, n long").repartition(3)
    assert got(V.variants(df)) == plain(counted)


def test_a_key_of_many_words_is_cut(spark, monkeypatch):
    # all words share their first four letters
    monkeypatch.setattr(V, "BLOCK", 40)
    rng = random.Random(5)
    counted = {"pref" + w: n for w, n in some_words(rng, 600, "abcd", 3).items()}
    df = spark.createDataFrame(list(counted.items()), "word string, n long")
    assert got(V.variants(df)) == plain(counted)


def test_chains_and_ties(spark):
    counted = {"abcdefgh": 10**6, "abcdefg": 10**4, "abcdef": 100, "abcde": 3, "xbcde": 3, "bbcde": 3, "zzzz": 10, "zzzy": 100, "zzzx": 100, "": 4}
    df = spark.createDataFrame([(w, n // 2) for w, n in counted.items()] + [(w, n - n // 2) for w, n in counted.items()], "word string, n long")
    want = plain(counted)
    assert got(V.variants(df)) == want and want["abcde"][1] == "abcdefgh" and want["zzzz"][0] == "zzzx"
    assert V.variants(df.limit(0)).collect() == []


def test_tiles_count_each_pair_once():
    words = ["abcdefg", "abcdefgh", "abcdxfg", "abcdef"]
    size = np.full(3, 7)
    count, first = V.near_in_tiles(size, np.zeros(3, bool), np.zeros(3), np.zeros(3, bool), np.zeros(3), pa.array([words[0], words[2], words[3]]))
    assert count.tolist() == [2, 1, 1] and first.tolist() == [1, 0, 0]
    # under their ends, the pair that shares its beginning doesn't count again
    count, _ = V.near_in_tiles(size[:2], np.ones(2, bool), np.zeros(2), np.zeros(2, bool), np.zeros(2), pa.array(["abcdefg", "abcxefg"]))
    assert count.tolist() == [0, 0]


def test_the_query_over_all_documents(spark, sf):
    counts = Counter()
    lower = {ord("A") + i: ord("a") + i for i in range(26)}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{r.doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    counted = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    assert got(queries.op12_spelling(spark, sf)) == plain(counted)
