import math
import random
from fractions import Fraction

import numpy as np
import pytest

from quire.llm import topk


def brute(rows, k=5, every=50):
    out = []
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for n, (q, v) in enumerate(whole):
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for m, (i, w) in enumerate(whole) if m != n and len(w) == len(v))
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["dense", "sparse", "alike", "large"])
def test_equals_brute_force(spark, monkeypatch, kind):
    rng = random.Random(kind)
    value = {
        "dense": lambda: rng.gauss(0, 0.2), "sparse": lambda: rng.gauss(0, 1) if rng.random() < 0.1 else 0.0,
        "alike": lambda: rng.choice([0.0, 0.5]), "large": lambda: rng.uniform(-(2**17), 2**17),
    }[kind]
    rows = [(i, [value() for _ in range(12)]) for i in range(700)] + [(i, [0.25] * 12) for i in range(700, 1000)]
    rows += [(1000, None), (None, [0.1] * 12), (1050, [float("nan")] * 12), (1100, [0.1, None]), (1150, [float("inf")] * 12), (1200, []), (1250, [0.5] * 3), (1300, [0.0] * 12)]
    rows += [(100, rows[100][1]), (1, rows[1][1])]
    monkeypatch.setattr(topk, "BLOCK", 128)
    monkeypatch.setattr(topk, "QUERIES", 4)
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int").repartition(3)
    assert sorted(tuple(r) for r in topk.top_k(df).collect()) == brute(rows)


def test_fewer_than_k_and_none(spark):
    df = spark.createDataFrame([(50, [0.5]), (3, [0.25])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(df).collect()] == [(50, 1, 3, 128 * 64)]
    assert topk.top_k(df.limit(0)).collect() == []


def test_terms_that_cannot_matter_are_left_out():
    rng = np.random.default_rng(3)
    values = np.zeros((500, 20))
    values[:40, 0] = rng.integers(50, 90, 40)
    values[:, 1:] = rng.integers(0, 2, (500, 19))
    block = topk.Block(np.arange(500), np.arange(500), values)
    query = np.ones(20)
    query[0] = 10
    ids, scores, bar = topk.max_score(block, query, -1, 5, -np.inf)
    again, same, _ = topk.max_score(block, query, -1, 5, bar)
    assert sorted(ids) == sorted(again) and sorted(scores) == sorted(same) and max(ids) < 40


@pytest.mark.parametrize("far", [300_000.0, 1e12, 1e307])
def test_large_components_take_part(spark, far):
    rng = random.Random(5)
    rows = [(i, [rng.choice([0.0, 0.25, -0.5]), rng.uniform(-1, 1), 0.0 if far > 1e6 else 2.0]) for i in range(120)]
    rows += [(150, [0.5, 0.25, far]), (7, [1.0, 1.0, -far])]
    if far > 1e6:  # their product is far below any long, so it must not be among the best
        rows += [(200, [0.25, -0.5, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    assert sorted(tuple(r) for r in topk.top_k(df).collect()) == brute([(i, [Fraction(x) for x in v]) for i, v in rows])


def test_a_score_beyond_longs_is_an_error(spark):
    df = spark.createDataFrame([(50, [1e12]), (3, [1e12])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="fit a long"):
        topk.top_k(df).collect()
