import random
from collections import Counter, defaultdict

from quire.llm import chat, mixing, quality, sharding, url_filter
from quire.llm.queries import RULES

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omikron pi rho sigma tau".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice("abcdefgh") + rng.choice("stuvwxyz") for _ in range(n))


def test_shards(spark):
    rng = random.Random(1)
    rows = [(i, "x" * rng.randint(0, 90), 0) for i in range(600)] + [(7, "y" * 40, 0)] * 300 + [(None, None, 0)] * 3 + [(900, "z" * 5000, 0)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, bytes int").repartition(4)
    got = sharding.shards(df, 1000).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    size, n = defaultdict(int), Counter()
    for r in got:
        size[r.shard] += r.bytes
        n[r.shard] += 1
    assert all((size[r.shard], n[r.shard], len(r.shard)) == (r.shard_bytes, r.shard_docs, r.depth) for r in got)
    assert all(b <= 1000 or n[s] == 1 for s, b in size.items()) and sum(b > 1000 for b in size.values()) == 2
    names = sorted(s for s in size if size[s] <= 1000)  # documents above the limit stand outside of the directory
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))
    # only what overflowed was split: every shard's sibling and itself together exceed the limit
    assert all(sum(b for t, b in size.items() if t.startswith(s[:-1]) and b <= 1000) > 1000 for s in names if s)
    assert sharding.shards(df.limit(0), 1000).collect() == []


def test_quality(spark):
    rng = random.Random(2)
    good = [prose(rng, rng.randint(60, 300)) for _ in range(120)]
    bad = [" ".join(w + "###" for w in prose(rng, 100).split()) for _ in range(20)]
    odd = [None, "", " \n\x0b", "a b c a b c", "l one\nl one\n \nl two", "word " * 40_000]
    texts = good + bad + odd
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_words string")
    got = {r.doc_id: r for r in quality.judge(df).collect()}
    assert len(got) == len(texts)
    assert all(got[i].kept for i in range(120)) and not any(got[i].kept for i in range(120, 140))
    at = len(good) + len(bad)
    assert [got[at + i].n_words for i in range(6)] == [0, 0, 0, 6, 6, 40_000]
    assert [got[at + i].n_repeat_words for i in range(6)] == [0, 0, 0, 6, 5, 40_000]
    assert got[at + 4].n_dup_lines == 1 and got[at + 5].base_failed
    assert quality.judge(df.limit(0)).collect() == []
    kept = quality.judge(df, keep=["doc_id", "n_words"]).columns
    assert "n_words_of_doc" in kept


def test_mixing(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randint(0, 60)), rng.choice(["a", "a", "a", "b", "c", None, "é"])) for i in range(800)]
    rows += [(5, "same text", "b")] * 200 + [(None, None, "d"), (9001, "", "d")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int").repartition(5)
    got = mixing.taken_words(mixing.mix(df, keep=["doc_id", "size"]), keep=["doc_id", "source"]).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    goal, left, open_ = {}, 1.5 * sum(sizes.values()), set(sizes)
    while full := {s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) >= 2 * sizes[s]}:
        goal |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
        if not open_:
            break
    goal |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
    taken = Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and abs(r.target - goal[r.source]) < 1e-6 and r.source_size == sizes[r.source]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - goal[s]) <= 1 for s in sizes)
    again = mixing.taken_words(mixing.mix(df.repartition(3)), keep=["doc_id", "source"]).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    assert mixing.mix(df.limit(0)).collect() == []


def test_urls(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/x">l</a>' for h in hosts)
    rows = [
        (1, "http://A.Org/x?y", None), (2, "https://www.example.org/es/1", link("bad.net")), (3, "http://example.org/en/12", ""), (4, "http://example.org/en/2", link("fine.net", "fine.net")),
        (5, None, None), (6, "no url", link("x.net")), (7, "http://com/fr/", ""), (8, "http://b.com/de/1", ""), (9, "http://fine.net/", ""), (10, "http://spam.net", link("b.com")),
        (11, "http://xexample.org", ""), (9, "http://fine.net/", ""),
    ]
    df = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, host int")
    got = {r.page_id: r for r in url_filter.judge_urls(df, RULES).collect()}
    assert {i: r.rule for i, r in got.items()} == {
        1: "org/", 2: "example.org/es/", 3: "example.org/en/1", 4: "org/", 5: None, 6: None, 7: "com/fr/", 8: "com/de/", 9: None, 10: None, 11: None,
    }
    assert [got[i].verdict for i in range(1, 12)] == ["allow", "block", "block", "allow", "allow", "allow", "allow", "block", "allow", "block", "allow"]
    assert (got[1].host, got[1].path, got[10].path, got[5].host) == ("a.org", "/x", "", "")
    assert got[9].trust > 0 and got[10].distrust > got[10].trust
    assert url_filter.judge_urls(df.limit(0), RULES).collect() == []


def test_chat(spark):
    hard = ["\\", "</turn>\n", '<turn role="user">\n', "\\</turn>", "<\\/turn>", '">\n', None, "", "<", 'a"', "é" * 5000 + "</turn"]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(zip(["user", "assistant"] * 6, hard))] + [(2, 0, '">\n', "x"), (3, 1, "assistant", "b"), (3, 0, "user", "a"), (3, 1, "assistant", "b")]
    rows += [(None, None, None, None), (4, 0, "system", "s"), (4, 1, "user", "u")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, formatted int").repartition(3)
    made = chat.format_chats(df)
    got = {r.conv_id: r for r in chat.read_back(made).collect()}
    want = defaultdict(list)
    for c, i, r, t in sorted(rows, key=lambda x: (x[0] or 0, x[1] or 0, x[2] or "", x[3] or "")):
        want[c].append((r or "", t or ""))
    assert {c: [tuple(t) for t in r.turns] for c, r in got.items()} == dict(want)
    assert {c: list(r.learnt) for c, r in got.items()} == {c: [t for r, t in turns if r == "assistant"] for c, turns in want.items()}
    wrong = {r.conv_id: r.first_wrong for r in made.collect()}
    assert wrong == {1: 11, 2: 0, 3: 2, None: 0, 4: 2}
    assert chat.format_chats(df.limit(0)).collect() == []
