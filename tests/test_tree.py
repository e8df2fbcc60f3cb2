import random

import pytest
from pyspark.sql import functions as F

from quire.operators import outcomes, tree
from quire.operators.scans import running


def stack_model(levels):
    """Depth and parent as a stack gives them; None for items without a place."""
    out, stack, n = [], [], 0
    for level in levels:
        if level == 1:
            stack = []
        elif not stack:
            out.append(None)
            continue
        else:
            stack = stack[: level - 1]
        n += 1
        out.append((n, len(stack) + 1, stack[-1] if stack else None))
        stack.append(n)
    return out


@pytest.fixture(scope="module")
def lists(spark):
    rng = random.Random(3)
    lists = [[1, 2, 3, 2, 1], [2, 3, 1, 2], [1, 4, 4, 2], [1, 3, 2, 3], [2, 2], [1]]
    lists += [[rng.randint(1, 6) for _ in range(rng.randint(1, 60))] for _ in range(150)]
    rows = [(p, i, lv) for p, levels in enumerate(lists) for i, lv in enumerate(levels)]
    return lists, spark.createDataFrame(rows, "page_id long, ord int, level int").repartition(5)


@pytest.mark.parametrize("small", [True, False])
def test_nesting_matches_a_stack(lists, small):
    """Whole groups in one window each, and groups of any size in pieces."""
    lists, df = lists
    got = {(r.page_id, r.idx): (r.depth, r.parent_idx) for r in tree.nest_catalog(df, ["page_id"], ["ord"], small=small).collect()}
    want = {(p, m[0]): m[1:] for p, levels in enumerate(lists) for m in stack_model(levels) if m}
    assert got == want


def test_dropped_items(lists):
    lists, df = lists
    got = {r.page_id: (r["items"], r.dropped_items) for r in tree.dropped_items(df, ["page_id"], ["ord"]).collect()}
    assert got == {p: (len(lv), stack_model(lv).count(None)) for p, lv in enumerate(lists)}


def test_running_is_the_same_in_pieces(spark):
    rng = random.Random(5)
    rows = [(0 if i % 3 else rng.randint(1, 4), i, rng.choice([None, rng.randint(-9, 9)])) for i in range(2000)]
    df = spark.createDataFrame(rows, "k int, o int, v int").repartition(7)
    outs = {"s": ("sum", F.col("v")), "lo": ("min", F.col("v")), "hi": ("max", F.col("v")), "l": ("last", F.col("v")), "n": ("sum", F.lit(1))}
    for keys in (["k"], []):
        whole = {r.o: r.asDict() for r in running(df, keys, ["o"], outs, small=True).collect()}
        pieces = {r.o: r.asDict() for r in running(df, keys, ["o"], outs).collect()}
        assert pieces == whole


@pytest.mark.parametrize("small", [True, False])
def test_flatten_paths_and_collisions(spark, small):
    rows = [
        ("s", 1, 1, "A/B", "u1"), ("s", 2, 2, "index", "u2"), ("s", 3, 2, "x", "u3"), ("s", 4, 3, "y", "u4"),
        ("s", 5, 1, "same", "u5"), ("s", 6, 1, "same", "u6"), ("s", 7, 1, "..", "u7"), ("s", 8, 2, "", "u8"), ("t", 1, 1, "A", "v1"),
    ]
    items = spark.createDataFrame(rows, "site string, idx long, depth int, title string, url string")
    flat = tree.flatten_catalog(items, small=small)
    paths = tree.output_paths(flat, F.concat(F.lit("out/"), F.col("site")))
    got = {(r.site, r.idx): (r.parent_idx, [p.title for p in r.parent_path], r.output_path) for r in paths.collect()}
    assert got == {
        ("s", 1): (None, [], "out/s/A_B/index.md"), ("s", 2): (1, ["A/B"], "out/s/A_B/index.md"),
        ("s", 3): (1, ["A/B"], "out/s/A_B/x/index.md"), ("s", 4): (3, ["A/B", "x"], "out/s/A_B/x/y.md"),
        ("s", 5): (None, [], "out/s/same.md"), ("s", 6): (None, [], "out/s/same.md"),
        ("s", 7): (None, [], "out/s/__/index.md"), ("s", 8): (7, [".."], "out/s/__/untitled.md"), ("t", 1): (None, [], "out/t/A.md"),
    }
    lost = {(r.output_path, r["items"], r.kept_idx) for r in tree.path_collisions(paths).collect()}
    assert lost == {("out/s/A_B/index.md", 2, 2), ("out/s/same.md", 2, 6)}


def test_depth_has_no_limit(spark):
    items = spark.createDataFrame([("s", i, i, "t", "u") for i in range(1, 42)], "site string, idx long, depth int, title string, url string")
    deepest = tree.flatten_catalog(items).orderBy(F.desc("idx")).first()
    assert len(deepest.parent_path) == 40 and not deepest.has_children


def test_paths_of_a_deep_and_long_catalog(spark, monkeypatch):
    monkeypatch.setattr(tree, "LEVELS", 16)
    deep = [("deep", i, i if i <= 60 else 2 + i % 5, f"t{i}") for i in range(1, 120)]
    wide = [(site, i, 1 + (i - 1) % 4, f"w{i}") for site in ("a", None) for i in range(1, 200)]
    rows = deep + wide + [("one", 1, 1, None)]
    want = {}
    stacks = {}
    for site, i, depth, title in rows:
        stack = [x for x in stacks.get(site, []) if x[0] < depth]
        want[site, i] = [(x[1], x[2]) for x in stack]
        stacks[site] = [*stack, (depth, title, i)]
    inner = {(site, up[-1][1]) for (site, _), up in want.items() if up}
    items = spark.createDataFrame(rows, "site string, idx long, depth int, title string").repartition(3)
    for small in (True, False):
        flat = tree.flatten_catalog(items, small=small).collect()
        assert len(flat) == len(rows)
        assert {(r.site, r.idx): [tuple(p) for p in r.parent_path] for r in flat} == want
        assert {(r.site, r.idx) for r in flat if r.has_children} == inner
        assert all(r.parent_idx == (want[r.site, r.idx][-1][1] if want[r.site, r.idx] else None) for r in flat)


def test_paths_over_many_blocks(spark, monkeypatch):
    """Ancestors far before a row, levels that are skipped, and rows without a depth: the last earlier row of each level counts."""
    monkeypatch.setattr(tree, "LEVELS", 4)
    rng = random.Random(11)
    depths = {"walk": [1], "chain": [1 + i % 50 for i in range(230)], "roots": [1, *[2] * 100, 3, 2, 3], None: [1, 2, 3] * 30}
    while len(depths["walk"]) < 400:
        depths["walk"].append(rng.randint(max(1, depths["walk"][-1] - 2), depths["walk"][-1] + 1))
    depths["odd"] = [rng.choice([None, 0, 1, 2, 3, 5, 9]) for _ in range(150)]
    rows, want = [], {}
    for site, of_site in depths.items():
        last = {}
        for i, depth in enumerate(of_site, 1):
            rows.append((site, i, depth, f"t{i}", None))
            want[site, i] = [last[k] for k in sorted(last) if depth is not None and k < depth]
            if depth:
                last[depth] = (f"t{i}", i)
    inner = {(site, up[-1][1]) for (site, _), up in want.items() if up}
    items = spark.createDataFrame(rows, "site string, idx long, depth int, title string, parent_idx long").repartition(5)
    flat = tree.flatten_catalog(items)
    assert flat.columns == ["site", "idx", "depth", "title", "parent_idx", "parent_path", "has_children"]
    flat = flat.collect()
    assert len(flat) == len(rows)
    assert {(r.site, r.idx): [tuple(p) for p in r.parent_path] for r in flat} == want
    assert {(r.site, r.idx) for r in flat if r.has_children} == inner
    assert all(r.parent_idx == (want[r.site, r.idx][-1][1] if want[r.site, r.idx] else None) for r in flat)


def test_paths_are_neither_moved_nor_settled(spark, monkeypatch):
    settled = []
    monkeypatch.setattr(tree, "settle", lambda df: settled.append(df) or df)
    items = spark.range(1, 400).selectExpr("'s' AS site", "id AS idx", "CAST(id AS INT) AS depth", "string(id) AS title")
    flat = tree.flatten_catalog(items)
    assert len(settled) == 1 and not any("parent_path" in df.columns for df in settled)
    plan = flat._jdf.queryExecution().optimizedPlan().toString().split("\n")
    moving = [line for line in plan if "Join" in line or "Repartition" in line or "Window" in line or "Aggregate" in line]
    assert moving and not any("parent_path" in line for line in moving)
    assert "Join" not in plan[0] and flat.agg({"parent_idx": "sum"}).first()[0] == sum(range(1, 399))


def test_flatten_of_nothing(spark):
    items = spark.createDataFrame([], "site string, idx long, depth int, title string, url string")
    assert tree.flatten_catalog(items).collect() == []


def test_preview_and_counts(spark):
    items = spark.createDataFrame([("s", i, 1 + i % 2, f"t{i}", "u") for i in range(1, 14)], "site string, idx long, depth int, title string, url string")
    lines = [r.line for r in tree.preview_items(items).orderBy("idx").collect()]
    assert len(lines) == 10 and lines[:2] == ["  t1", "t2"]
    assert tuple(tree.count_items(items).first()) == ("s", 6, 13)


def test_retries(spark):
    log = {
        "first": [None], "third": ["a", "b", None], "late": ["a", "b", "c", None], "never": ["a", "b"], "again": [None, "x"],
        "long": ["e"] * 50,
    }
    rows = [(u, i, e) for u, es in log.items() for i, e in enumerate(es)]
    df = spark.createDataFrame(rows, "url string, attempt int, error string")
    got = {r.url: (r.attempts, r.success, r.error) for r in outcomes.retry_outcome(df, 2).collect()}
    assert got == {
        "first": (1, True, None), "third": (3, True, None), "late": (3, False, "c"), "never": (2, False, "b"),
        "again": (1, True, None), "long": (3, False, "e"),
    }
    once = {r.url: r.success for r in outcomes.retry_outcome(df, 0).collect()}
    assert [u for u, ok in once.items() if ok] and not once["third"]
    with pytest.raises(ValueError):
        outcomes.retry_outcome(df, -1)


def test_totals(spark):
    df = spark.createDataFrame([(1, True, None), (2, False, "render: x"), (3, True, None), (4, False, "odd")], "o int, success boolean, error string")
    assert tuple(outcomes.run_totals(df).first()) == (4, 2, 2, 50.0)
    stopped = spark.createDataFrame([(8,)], "total long")
    assert tuple(outcomes.run_totals(df, total=stopped).first()) == (8, 2, 2, 25.0)
    steps = [(r.completed, r.failed) for r in outcomes.running_progress(df, ["o"]).orderBy("o").collect()]
    assert steps == [(1, 0), (1, 1), (2, 1), (2, 2)]
    assert {tuple(r) for r in outcomes.error_breakdown(df).collect()} == {("render", 1), ("other", 1)}


def test_nesting_sorts_and_settles_once(spark, monkeypatch):
    from quire.operators import scans

    calls = []
    settle = scans.settle
    monkeypatch.setattr(scans, "settle", lambda df: (calls.append(1), settle(df))[1])
    df = spark.createDataFrame([(1, i, 1 + i % 3) for i in range(30)], "page_id int, ord int, level int")
    assert tree.nest_catalog(df, ["page_id"], ["ord"]).count() == 30 and len(calls) == 1
