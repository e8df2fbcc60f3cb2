import hashlib
import random
import re
import zlib

import pytest

from quire.llm import queries
from quire.llm import repair as R

LEGAL = re.compile(r"(s?(ua)+)?")


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.rstrip(R.BLANKS)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, turns) by plain dynamic programming over (row, state), keeping the least (cost, audit)."""
    marks = faults(rows)
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    names = {2: "user", 3: "assistant"}
    wanted = (2, 2, 3, 2)

    def inserts(states):
        for _ in range(3):
            for s, (cost, audit, turns) in list(states.items()):
                to = wanted[s]
                new = (cost + 2, audit + "I", turns + [(names[to], "")])
                if to not in states or new[:2] < states[to][:2]:
                    states[to] = new
        return states

    states = inserts({0: (0, "", [])})
    for (role, text), mark in zip(rows, marks):
        new = {}

        def put(to, cost, audit, turns):
            if to not in new or (cost, audit) < new[to][:2]:
                new[to] = (cost, audit, turns)

        for s, (cost, audit, turns) in states.items():
            put(s, cost + 3, audit + "D", turns)
            if mark in ("", "truncated"):
                late = mark == "truncated"
                if (s, role[:1]) in step:
                    put(step[s, role[:1]], cost + late, audit + "K", turns + [(role, text)])
                put(wanted[s], cost + 2 + late, audit + "R", turns + [(names[wanted[s]], text)])
        states = inserts(new)
    return min((states[s] for s in (0, 3) if s in states), key=lambda x: x[:2])


def plain(rows):
    """Of ``(turn, role, text)`` in their order."""
    known = [t for t, _, _ in rows if t is not None]
    said = [(r, x) for _, r, x in rows]
    marks = faults(said)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:]))
    cost, audit, turns = cheapest(said)
    assert LEGAL.fullmatch("".join(r[:1] for r, _ in turns))
    digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in turns).encode()).hexdigest()
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    return gaps, marks.count("blank"), marks.count("duplicate"), marks.count("truncated"), illegal, cost, audit, digest


def got(df):
    rows = df.collect()
    out = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


def talk(rng, n, roles="suax", texts=30):
    named = {"s": "system", "u": "user", "a": "assistant", "x": "tool", "-": ""}
    ends = [".", "!", "?", "", " ", ". \n", "…"]
    return [(i + i // 7, named[rng.choice(roles)], rng.choice(["", " ", f"say {rng.randrange(texts)}{rng.choice(ends)}"]) if rng.random() < 0.2 else f"say {rng.randrange(texts)}{rng.choice(ends)}") for i in range(n)]


@pytest.mark.parametrize("seed", range(40))
def test_trace_is_the_cheapest_and_least(seed):
    rng = random.Random(seed)
    rows = [(r, x) for _, r, x in talk(rng, rng.randint(0, 14), rng.choice(["suax-", "uuua", "ua", "u", "sa"]))]
    seen = set()
    kinds = bytes(R._kind(r, x, seen) for r, x in rows)
    audit, cost, turns = R.trace(kinds, rows, R.ENDED, R.START, True)
    assert (cost, audit, turns) == cheapest(rows)


def test_chunks_converge_or_wait():
    few = random.Random(3)
    mixed = bytes(few.choice([0, 2, 3, 4, 5]) for _ in range(200))
    assert len(set(R.speculate(mixed))) == 1
    assert len(set(R.speculate(bytes([2] * 200)))) > 1 and len(set(R.speculate(bytes([R.BLANK] * 9)))) == len(R.VECTORS)


@pytest.mark.parametrize("rows", [2, 4096])
def test_conversations_cut_anywhere(spark, monkeypatch, rows):
    monkeypatch.setattr(R, "ROWS", rows)
    rng = random.Random(rows)
    talks = {i: talk(rng, rng.randint(1, 9)) for i in range(30)}
    talks |= {100: talk(rng, 120), 101: talk(rng, 60, "u", 10**6), 102: [(i, "user", "same.") for i in range(50)], 103: talk(rng, 90, "sx"), None: talk(rng, 60, "ua", 10)}
    talks[104] = [(None, "user", "a."), (5, "assistant", "b."), (9, "user", "c")]
    talks[105] = [(None, "user", "alone.")]
    data = [(c, t, r, x, 1) for c, said in talks.items() for t, r, x in said]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, chunk int").repartition(5)
    repaired = R.repair(df)
    assert got(R.summary(repaired)) == {c: plain(said) for c, said in talks.items()}
    left = {}
    for r in sorted(R.turns(repaired).collect(), key=lambda r: (r.chunk, r.place)):
        left.setdefault(r.conv_id, []).append((r.role, r.text))
    assert left == {c: t for c, said in talks.items() if (t := cheapest([(r, x) for _, r, x in said])[2])}
    assert R.summary(R.repair(df.limit(0))).collect() == []


def test_copies_of_other_tasks_and_long_rows(spark, monkeypatch):
    monkeypatch.setattr(R, "CHARACTERS", 50)
    said = [(i, "user" if i % 2 else "assistant", f"text {i % 90}." if i % 50 else "x" * 200) for i in range(250)]
    df = spark.createDataFrame([(1, *row) for row in said] + [(2, 1, None, None), (2, 1, "user", "twice."), (2, 1, "user", "twice.")], "conv_id int, turn int, role string, text string")
    out = got(R.summary(R.repair(df.repartition(7))))
    assert out[1] == plain(said)
    assert out[2][1:4] == (1, 1, 0) and out[2][5] == 8 and sorted(out[2][6]) == ["D", "D", "I", "K"]


def test_the_query_over_all_conversations(spark, sf):
    want = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        want.setdefault(r.conv_id, [])
        h = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        text = "" if h == 1 else re.sub("[.!?]", "", r.text) if h == 2 else r.text
        want[r.conv_id] += [(r.turn, "user" if h == 4 else r.role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    assert got(queries.op13_repair(spark, sf)) == {c: plain(sorted(rows, key=lambda x: x[0])) for c, rows in want.items()}


def test_damage_of_nulls_and_a_conversation_that_goes(spark, tmp_path):
    rows = [(i, t, r, x) for i in range(60) for t, r, x in [(0, "user", "a."), (None, None, None)]] + [(None, 3, "user", "b.")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    out = got(queries.op13_repair(spark, str(tmp_path)))
    assert set(out) == {*range(60), None}
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    gone = [i for i in range(60) if zlib.crc32(f"{i}:0".encode()) % 20 == 0 and zlib.crc32(f"{i}: ".encode()) % 20 == 0]
    assert all(out[i] == empty for i in gone)
