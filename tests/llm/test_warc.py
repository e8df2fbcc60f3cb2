import random
import time

import pytest

from quire.llm import warc


def fake(n):
    return warc.record(900 + n, "http://fake/", b"x" * 50, None, False).decode()


def pages_of():
    html = [
        None, "", "a", "a", "", fake(0), "before " + fake(1) * 5 + " behind", "WARC/1.1\r\n", "WARC/1.1\r\nContent-Length: 5\r\n\r\nabc",
        "é" * 3000, "a", "\r\n\r\n", fake(2) + "WARC/1.1\r\nContent-Length: 99999999\r\n\r\n",
    ]
    html += [f"<p>{i}</p>" * (i % 40) for i in range(300)]
    rows = [(i, f"http://h/{i} x\n", h) for i, h in enumerate(html)]
    return rows + [(2, "http://h/2", "a"), (-7, None, "a"), (None, "u", "a"), (None, "u", "only")]


@pytest.mark.parametrize("block", [64, 997, 1 << 20])
def test_records_come_back(spark, block):
    rows = pages_of()
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, first int").repartition(3)
    manifest = warc.write_warc(df)
    assert sum(r.records for r in manifest.collect()) == len(rows)
    got = warc.read_warc(manifest, block).collect()
    texts = {}
    for i, _, h in rows:
        texts.setdefault(h or "", []).append(i)
    want = []
    for i, _, h in rows:
        ids = [x for x in texts[h or ""] if x is not None]
        first = min(ids, default=None)
        again = first is not None and len(texts[h or ""]) > 1 and i != first
        raw = (h or "").encode()
        want.append((i, "revisit" if again else "response", first if again else None, len(raw), warc.digest(raw), None if again else raw))
    order = lambda r: tuple((x is None, x if x is not None else 0) for x in r[:3])
    got = [(r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, None if r.payload is None else bytes(r.payload)) for r in got]
    assert sorted(got, key=order) == sorted(want, key=order)


def test_candidates_inside_payloads_are_rejected(spark):
    df = spark.createDataFrame([(i, "u", fake(i) * 3) for i in range(20)], "page_id long, url string, html string").coalesce(1)
    manifest = warc.write_warc(df)
    entries, seen = warc.boundaries(manifest, 512)
    assert seen.count() == 80 and entries.count() <= 20
    assert warc.read_warc(manifest, 512).count() == 20


def test_least_bytes_and_empty_table(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    got = {r.page_id: r.record_type for r in warc.read_warc(warc.write_warc(df, least=3)).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}
    assert warc.read_warc(warc.write_warc(df.limit(0))).collect() == []


def test_damage_is_noticed(spark):
    df = spark.createDataFrame([(1, "u", "abc" * 100)], "page_id long, url string, html string")
    manifest = warc.write_warc(df)
    path = manifest.first().path.removeprefix("file:")
    with open(path, "r+b") as f:
        f.seek(-30, 2)
        f.write(b"X")
    with pytest.raises(Exception, match="damaged"):
        warc.read_warc(manifest).collect()


@pytest.mark.parametrize("block", [4096, 1 << 20])
def test_long_urls_come_back(spark, block):
    rows = [(i, "http://h/" + ("é" * 200_000 if i in (0, 7, 8) else f"{i}"), f"<p>{i}</p>" * 40) for i in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    got = warc.read_warc(warc.write_warc(df), block).collect()
    assert sorted((r.page_id, r.url, bytes(r.payload).decode()) for r in got) == rows


@pytest.mark.parametrize("change", ["bytes + 1", "records + 1"])
def test_chain_must_fit_the_manifest(spark, change):
    df = spark.createDataFrame([(i, "u", f"{i}") for i in range(5)], "page_id long, url string, html string").coalesce(1)
    name = change.split()[0]
    manifest = warc.write_warc(df)
    with pytest.raises(ValueError, match="were written"):
        warc.read_warc(manifest.selectExpr("path", *[f"{c if c != name else change} as {c}" for c in ("bytes", "records")])).collect()


@pytest.mark.parametrize("unit", ["WARC/1.1\r\nx:", "WARC/1.1\r\nContent-Length: 3\r\nx:", "WARC/1.1\r\n", "WARC/1.1\r\nContent-Length: " + "9" * 5000 + "\r\n\r\n"])
def test_payload_of_record_heads(spark, unit):
    html = unit * (1_000_000 // len(unit))
    rows = [(0, "u", html), (1, "u", html + "\r\n\r\n"), (2, "http://h/WARC/1.1", "behind")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    manifest = warc.write_warc(df)
    start = time.monotonic()
    got = warc.read_warc(manifest, 1 << 18).collect()
    assert sorted((r.page_id, r.url, bytes(r.payload).decode()) for r in got) == rows
    assert time.monotonic() - start < 30


def test_lengths_are_those_of_whole_headers():
    pieces = [b"WARC/1.1\r\n", b"Content-Length: 7\r\n", b"content-length : x\r\n", b"a:b\r\n", b"none\r\n", b"\r\n", b"x:", b"\r"]
    draw = random.Random(5)
    for _ in range(400):
        span = warc.Span.__new__(warc.Span)
        span.data, span.more = b"".join(draw.choices(pieces, k=draw.randrange(1, 40))), lambda: False
        lengths, at = warc.Lengths(span), span.data.find(warc.MAGIC)
        while at >= 0:
            whole = warc.parse_header(span, at)
            assert lengths.of(at) == (whole and (whole[1], int(whole[0]["content-length"])))
            at = span.data.find(warc.MAGIC, at + 1)
