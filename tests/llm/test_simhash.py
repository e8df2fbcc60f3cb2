import os
import random
import threading

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import simhash as S
from quire.llm.components import components


def roots_of(n, pairs):
    root = list(range(n))
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def components_of(n, x, y):
    """The smallest member of each one's component; ``roots_of`` without recursion."""
    root = np.arange(n)
    x, y = np.array(x), np.array(y)
    while len(x) and (root[x] != root[y]).any():
        np.minimum.at(root, x, root[y])
        np.minimum.at(root, y, root[x])
    return root.tolist()


def plain_fingerprint(text):
    words = (text or "").translate({i: i + 32 for i in range(65, 91)})
    for c in "\t\n\x0b\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    sh = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aAéÉ \t\n\x0b\x85  bcd", max_size=60))
def test_fingerprint(text):
    assert S.fingerprint(text.encode()) == plain_fingerprint(text)


def test_spark_hashes_alike(spark):
    assert spark.sql("select xxhash64('a b c')").first()[0] % (1 << 64) == xxhash.xxh64_intdigest(b"a b c", 42)


def clustered(rng, n):
    out = set()
    while len(out) < n:
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 1, 5, 40])):
            out.add(base)
            for _ in range(rng.randint(0, 4)):
                base ^= 1 << rng.randrange(64)
    return list(out)


@pytest.mark.parametrize("n", [1, 300, 3000])
def test_links_in_connect_what_all_pairs_connect(n):
    fps = np.array(clustered(random.Random(n), n), np.uint64)
    x, y = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3, 1))
    at = {int(f): i for i, f in enumerate(fps)}
    got = S.links_in(fps, 3)
    assert all((a ^ b).bit_count() <= 3 for a, b in got) and len(got) < len(fps)
    assert roots_of(len(fps), [(at[a], at[b]) for a, b in got]) == roots_of(len(fps), zip(x.tolist(), y.tolist()))


@pytest.mark.parametrize("most,dense,others", [(3, 529, 500), (3, 2081, 1700), (1, 2081, 300)])
def test_links_in_ends_on_a_dense_cluster(most, dense, others):
    rng = random.Random(dense)
    centre = rng.getrandbits(64)
    near = [centre] + [centre ^ (1 << i) for i in range(64)] + [centre ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i)]
    fps = np.array(sorted({*rng.sample(near, dense), *(rng.getrandbits(64) for _ in range(others))}), np.uint64)
    ended = threading.Event()
    threading.Thread(target=lambda: ended.wait(60) or os._exit(1), daemon=True).start()
    got = S.links_in(fps, most)
    ended.set()
    x, y = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= most, 1))
    at = {int(f): i for i, f in enumerate(fps)}
    want = components_of(len(fps), x, y)
    assert len(got) == len(fps) - len(set(want)) and components_of(len(fps), *zip(*[(at[a], at[b]) for a, b in got])) == want


@pytest.mark.parametrize("leaf,cell", [(200, 100_000), (200, 150), (100_000, 100_000)])
def test_cells_lose_no_link(spark, monkeypatch, leaf, cell):
    monkeypatch.setattr(S, "LEAF", leaf)
    monkeypatch.setattr(S, "CELL", cell)
    fps = np.array(clustered(random.Random(7), 2500), np.uint64)
    table = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long").repartition(4)
    got = [(r.a % (1 << 64), r.b % (1 << 64)) for r in S.links(table, 3).collect()]
    x, y = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3, 1))
    at = {int(f): i for i, f in enumerate(fps)}
    assert roots_of(len(fps), [(at[a], at[b]) for a, b in got]) == roots_of(len(fps), zip(x.tolist(), y.tolist()))


def test_components(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 80)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(300, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = roots_of(301, pairs)
    assert got == {n: want[n] for p in pairs if p[0] != p[1] for n in p}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_documents(spark):
    rng = random.Random(4)
    base = [" ".join(rng.choice("alpha beta gamma delta eps zeta eta theta".split()) + str(rng.randint(0, 50)) for _ in range(120)) for _ in range(12)]
    texts = [None, "", " \n", "one", "ONE", "one two", *base, *base[:4], *[b.replace("alpha", "Alpha") for b in base], *[b + " tail" for b in base]]
    rows = [(i if i != 9 else None, t, 5) for i, t in enumerate(texts)] + [(3, "one", 5)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int").repartition(5)
    got = S.near_duplicates(df, keep=["doc_id"]).collect()
    fps = [plain_fingerprint(t) for _, t, _ in rows]
    root = roots_of(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    least = {}
    for (k, _, _), r in zip(rows, root):
        least[r] = min((x for x in (least.get(r), k) if x is not None), default=None)
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted([(r.doc_id, r.fp % (1 << 64), r.component_id) for r in got], key=key) == sorted([(k, f, least[r]) for (k, _, _), f, r in zip(rows, fps, root)], key=key)
    assert S.near_duplicates(df.limit(0)).collect() == []


def test_one_of_each_tells_components_apart_by_their_texts(spark):
    # two unlike texts under one id, two near copies without ids, a text without words and a null one
    base = " ".join(f"word{i}" for i in range(300))
    rows = [(1, "alpha beta gamma delta"), (1, "one two three four"), (None, base), (None, base + " tail"), (7, ""), (6, None), (6, None)]
    df = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(rows)], "doc_id long, text string, row long").repartition(3)
    kept = sorted(r.row for r in S.one_of_each(df).collect())
    near = (plain_fingerprint(base) ^ plain_fingerprint(base + " tail")).bit_count() <= 3
    assert kept == sorted([0, 1, 2, *([] if near else [3]), 5])
    assert S.one_of_each(df.limit(0)).collect() == []
