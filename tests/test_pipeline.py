import json
import random
import time

import pytest
from pyspark.sql import functions as F

from quire.operators import markdown as M
from quire.operators import replies as R
from quire.plans import fetch as FP
from quire.plans import verify as V
from quire.session import scratch_path
from quire.sources import cache as C
from quire.sources import catalogs as CAT
from quire.sources import markdown_files as MF
from quire.sources.pages import render_pages
from quire.streaming.fetch import stream_fetch
from quire.streaming.progress import ProgressListener, observed

NOW = "2024-01-01"

FRAGMENTS = {
    "<h1>T &amp; x</h1><p>one <b>two</b> <i></i>three</p><p>four<p>five<br>six <a href='/x?a=1&amp;b'>link <code>c</code></a>":
        ("T & x", "# T & x\n\none **two** three\n\nfour\n\nfive\nsix [link `c`](/x?a=1&b)\n"),
    "<ul><li>a<ul><li>b</li><li><p>c</p><p>c2</p></li></ul></li><li>d</li></ul><ol><li>x<li>y</ol>after":
        ("未命名文档", "- a\n  - b\n  - c\n\n    c2\n\n- d\n\n1. x\n2. y\n\nafter\n"),
    "<blockquote><p>q1</p><p>q2</p></blockquote><pre><code>x = 1\n  y &lt; 2</code></pre><hr><img src=a.png alt='p q'>":
        ("未命名文档", "> q1\n>\n> q2\n\n```\nx = 1\n  y < 2\n```\n\n* * *\n\n![p q](a.png)\n"),
    "<table><tr><th>a</th><th>b</th></tr><tr><td>1<td>2</table>": ("未命名文档", "a b\n1 2\n"),
    "<nav>n</nav>text<header><h1> H </h1></header><script>var x</script> tail<div class=ad>ad</div>": ("H", "text tail\n\nad\n"),
    "": ("未命名文档", "\n"),
    "<p> </p>": ("未命名文档", "\n"),
    "<title>t</title>  <p>  lead <em>x</em></p>\n\n<p>z</p>": ("t", "lead _x_\n\nz\n"),
    "<p>1 *s* _u_ `c` [l] a\\b # h<br>- x<br># y<br>12. z<br>3.5<br>&gt; q<br>--- <br>-1</p><ul><li>+ p</li></ul>":
        ("未命名文档", "1 \\*s\\* \\_u\\_ \\`c\\` \\[l\\] a\\\\b # h\n\\- x\n\\# y\n12\\. z\n3.5\n\\> q\n\\---\n-1\n\n- \\+ p\n"),
    "<code>a_b*</code> c_d <b>- e*</b><pre># *k*</pre>": ("未命名文档", "`a_b*` c\\_d **- e\\***\n\n```\n# *k*\n```\n"),
    "<h1>a_b</h1>": ("a_b", "# a\\_b\n"),
    "<h1>  </h1><title>u</title>": ("", "\n"),
    "<h1></h1><title>u</title>x": ("u", "x\n"),
    "a<h2><b></b></h2># b": ("未命名文档", "a\n\n\\# b\n"),
}


def frame(spark, docs):
    return spark.createDataFrame([(i, f"http://h/{i}", d) for i, d in enumerate(docs)], "page_id long, url string, html string")


def test_rendering(spark):
    rows = M.process(frame(spark, FRAGMENTS), include_meta=False).orderBy("page_id").collect()
    got = {d: (r.title, r.body) for d, r in zip(FRAGMENTS, rows)}
    for d, want in FRAGMENTS.items():
        assert got[d] == want, d


def test_render_options(spark):
    docs = ["<div class='x ad'>ad</div>y", "<table><tr><td>1<td>2</table>"]
    rows = M.process(frame(spark, docs), include_meta=False, prune_ads=True, tables="pipe").orderBy("page_id").collect()
    assert [r.body for r in rows] == ["y\n", "1 | 2\n"]
    with pytest.raises(ValueError):
        M.process(frame(spark, docs), tables="grid")


def test_clean_html(spark):
    docs = ["<div id=a class='x' data-x=1 data-*=2 title=\"class=q\"><nav>n<p>m</nav>t<script>x</script>u</div><p>k<footer>f</footer>z"]
    got = M.clean_html(frame(spark, docs)).first().html
    assert got == "<div data-x=1 title=\"class=q\">tu</div><p>kz"


def test_content_selection(spark):
    docs = ["<article></article>", "<p>x</p>", "<article>1</article><article>2</article>", "<head><title>t</title></head>body", None]
    df = frame(spark, docs)
    assert [r.content for r in M.extract_content(df, "article").orderBy("page_id").collect()] == ["", "", "1", "", ""]
    pairs = [("article", "css"), M.BODY]
    rows = M.convert(df.withColumn("want", F.when(F.col("page_id") == 3, 1).otherwise(0)), pairs, fetched_at=NOW).orderBy("page_id").collect()
    assert [r.error for r in rows] == ["content_not_found", "content_not_found", None, "content_not_found", "content_not_found"]  # no body tag, no match
    assert rows[2].content == "---\ntitle: 未命名文档\nsource: http://h/2\nfetched_at: 2024-01-01 00:00:00\nword_count: 1\n---\n\n1\n"


# ---- catalogs -------------------------------------------------------------------------------------------------


def document(depth):
    item = None
    for d in range(depth, 0, -1):
        item = {"title": f't"{d}', "url": f"u{d}"} | ({"children": [item]} if item else {})
    return {"site": f"s.{depth}:8", "url": "http://s", "selectors": {"toc": "a", "content": "b"}, "items": [item, {"title": "z", "url": "zz"}],
            "ai_generated": False, "confidence": 0.5, "scanned_at": "2024"}


def test_catalogs_survive_a_round_trip(spark):
    docs = [document(1), document(3), document(6), {**document(1), "items": None}]
    texts = spark.createDataFrame([(str(i), json.dumps(d)) for i, d in enumerate(docs)], "catalog_id string, value string")
    catalogs, items = CAT.catalogs_from_json(texts)
    assert items.where("catalog_id = '1'").orderBy("idx").select("idx", "parent_idx", "depth", "title").collect() == [
        (1, None, 1, 't"1'), (2, 1, 2, 't"2'), (3, 2, 3, 't"3'), (4, None, 1, "z")
    ]
    back = {r.catalog_id: json.loads(r.json) for r in CAT.catalog_documents(catalogs, items).collect()}
    assert back == {str(i): d for i, d in enumerate(docs)}


def test_deep_catalogs_in_one_pass(spark):
    deep = document(700)
    texts = spark.createDataFrame([("deep", json.dumps(deep)), ("flat", json.dumps(document(1)))], "catalog_id string, value string")
    catalogs, items = CAT.catalogs_from_json(texts)
    back = {r.catalog_id: r.json for r in CAT.catalog_documents(catalogs, items).collect()}
    assert back["deep"] == json.dumps(deep, separators=(",", ":"))
    assert items.where("catalog_id = 'deep'").agg(F.max("depth"), F.count("*")).first()[:] == (700, 701)


def test_catalogs_are_read_chunk_after_chunk(spark, monkeypatch):
    monkeypatch.setattr(CAT, "FAN", 2)
    monkeypatch.setattr(CAT, "CHUNK", 2**4)
    rng = random.Random(7)
    docs, want = {}, []
    for c in range(12):
        n, stack, roots = 0, [], []
        for _ in range(rng.choice([1, 2, 3, 7, 40, 90])):
            stack = stack[: rng.randint(0, len(stack))]
            n, item = n + 1, {"title": f"t{rng.random()}", "url": rng.choice(["u,]}", None, 'q"\\'])}
            want.append((str(c), n, stack[-1][0] if stack else None, len(stack) + 1, item["title"], item["url"]))
            (stack[-1][1].setdefault("children", []) if stack else roots).append(item)
            stack.append((n, item))
        docs[str(c)] = json.dumps({"meta": [{"title": "no", "children": [{}]}] * c, "site": "s", "items": roots, "more": [[{}]] * c})
    docs["open"] = docs["11"] + "]"
    _, items = CAT.catalogs_from_json(spark.createDataFrame(list(docs.items()), "catalog_id string, value string"))
    got = items.select("catalog_id", "idx", "parent_idx", "depth", "title", "url").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_a_long_catalog_takes_no_longer_than_many_short_ones(spark):
    def seconds(documents, size):
        item = '{"title":"Customer#000000001","url":"http://world/0/1"}'
        rows = [(str(i), '{"site":"s","items":[' + ",".join([item] * size) + "]}") for i in range(documents)]
        _, items = CAT.catalogs_from_json(spark.createDataFrame(rows, "catalog_id string, value string").coalesce(1))
        began = time.perf_counter()
        assert items.agg(F.count("title"), F.max("idx")).first()[:] == (documents * size, size)
        return time.perf_counter() - began

    seconds(20, 1000)
    assert seconds(1, 24000) < 2.5 * seconds(24, 1000) + 1


def test_odd_catalog_documents(spark):
    odd = {
        "more": '{"site":"s","meta":{"items":[{"title":"no"}]},"items" : [ {"title":"a\\"]}","x":[{"title":"no"}],"children":[{"url":"u","children":[]}],"url":"v\\u00e9"}, 5 , {"t\\u0069tle":7,"url":null} ]}',
        "open": '{"site":"s","items":[{"title":"a"}', "text": "no JSON", "null": None, "none": '{"site":"s","items":[]}', "empty": "",
    }
    texts = spark.createDataFrame(list(odd.items()), "catalog_id string, value string")
    catalogs, items = CAT.catalogs_from_json(texts)
    assert catalogs.count() == len(odd)
    got = sorted((r.catalog_id, r.site, r.idx, r.parent_idx, r.depth, r.title, r.url) for r in items.collect())
    assert got == [("more", "s", 1, None, 1, 'a"]}', "vé"), ("more", "s", 2, 1, 2, None, "u"), ("more", "s", 3, None, 1, "7", None)]


# ---- cache ------------------------------------------------------------------------------------------------------


def test_cache(spark):
    t = lambda d: f"2024-01-0{d} 00:00:00"
    old = spark.createDataFrame([("u1", "a", t(1)), ("u2", "b", t(3))], "url string, html string, fetched_at string")
    old = old.select(F.md5("url").alias("url_hash"), "url", "html", F.col("fetched_at").cast("timestamp").alias("fetched_at"))
    new = spark.createDataFrame([("u1", "A", t(1)), ("u2", "B", t(2)), ("u3", "é", t(1)), ("u3", "f", t(2))], "url string, html string, fetched_at string")
    merged = C.cache_upsert(old, new.withColumn("fetched_at", F.col("fetched_at").cast("timestamp")))
    assert {(r.url, r.html) for r in merged.collect()} == {("u1", "A"), ("u2", "b"), ("u3", "f")}
    assert tuple(C.cache_stats(merged).first()) == (3, 3)
    urls = spark.createDataFrame([("u1",), ("u9",)], "url string")
    assert {(r.url, r.from_cache, r.html) for r in C.cache_lookup(urls, merged).collect()} == {("u1", True, "A"), ("u9", False, None)}
    assert [r.url for r in C.cache_has(urls, merged).collect()] == ["u1"]


def test_cache_metadata(spark, tmp_path):
    good = tmp_path / "meta.json"
    good.write_text(json.dumps({"entries": {"u": {"url": "u", "file": "f.html", "fetched_at": "2024", "status": 0}, "v": {"file": "g"}}}, indent=1))
    assert {tuple(r) for r in C.read_cache_meta(spark, str(good)).collect()} == {("u", "f.html", "2024", 0), ("v", "g", None, None)}
    for text in ("{broken", '{"entries": null}'):
        (tmp_path / "bad.json").write_text(text)
        assert C.read_cache_meta(spark, str(tmp_path / "bad.json")).count() == 0
    assert C.read_cache_meta(spark, str(tmp_path / "none.json")).count() == 0


# ---- fetch ------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def corpus(spark):
    pages = spark.createDataFrame(
        [(1, "http://s/a", "<article><h1>A</h1>live</article>"), (2, "http://s/b", "<article>b</article>"),
         (3, "http://s/c", "<p>no article</p>"), (4, "http://s/d", "<article>d <b>d</b></article>")],
        "page_id long, url string, html string",
    )
    items = spark.createDataFrame(
        [("s", 1, 1, "A", "http://s/a"), ("s", 2, 2, "B", "http://s/b"), ("s", 3, 2, "C", "http://s/c"), ("s", 4, 1, "D", "http://s/d"),
         ("s", 5, 1, "D", "http://s/a"), ("s", 6, 1, "E", "http://s/e"), ("t", 1, 1, "X", "http://s/c")],
        "site string, idx long, depth int, title string, url string",
    )
    catalogs = spark.createDataFrame(
        [("s", ("", "article", None, None)), ("t", ("", "//p", None, "xpath"))],
        "site string, selectors struct<toc:string,content:string,toc_type:string,content_type:string>",
    )
    cache = spark.createDataFrame([("http://s/b", "<article>cached</article>")], "url string, html string")
    return pages, items, catalogs, cache.withColumn("url_hash", F.md5("url"))


def test_fetch_job(spark, corpus, tmp_path):
    pages, items, catalogs, cache = corpus
    first = FP.fetch_corpus(items, catalogs, pages, "out", cache, fetched_at=NOW)
    got = {(r.site, r.idx): (r.output_path, r.from_cache, r.word_count, r.success, r.error) for r in first.results.collect()}
    assert got == {
        ("s", 1): ("out/s/A/index.md", False, 2, True, None), ("s", 2): ("out/s/A/B.md", True, 1, True, None),
        ("s", 3): ("out/s/A/C.md", False, 0, False, "content_not_found"), ("s", 4): ("out/s/D.md", False, 2, True, None),
        ("s", 5): ("out/s/D.md", False, 2, True, None), ("s", 6): ("out/s/E.md", False, 0, False, "render: page not available"),
        ("t", 1): ("out/t/X.md", False, 2, True, None),
    }
    docs = {r.output_path: r.source for r in first.documents.collect()}
    assert docs == {"out/s/A/index.md": "http://s/a", "out/s/A/B.md": "http://s/b", "out/s/D.md": "http://s/a", "out/t/X.md": "http://s/c"}
    assert {r.url for r in first.new_pages.collect()} == {"http://s/a", "http://s/c", "http://s/d"}
    # a second run writes nothing
    table = str(tmp_path / "out")
    MF.write_markdown(first.documents, table)
    again = FP.fetch_corpus(items, catalogs, pages, "out", cache, MF.read_markdown(spark, table), fetched_at=NOW)
    assert again.documents.count() == 0
    assert again.results.where("skipped and success and word_count = 0").count() == 4


def test_markdown_files(spark, corpus, tmp_path):
    pages, items, catalogs, cache = corpus
    docs = FP.fetch_corpus(items, catalogs, pages, str(tmp_path / "md"), fetched_at=NOW).documents
    MF.export_markdown(docs)
    files = {r.output_path: r.source for r in MF.read_markdown(spark, str(tmp_path / "md"), files=True).collect()}
    assert files == {r.output_path: r.source for r in docs.collect()}


def test_streamed_fetch_equals_one_batch(spark, corpus, tmp_path):
    pages, items, catalogs, _ = corpus
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    seen = []
    read = lambda: spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    run = lambda: stream_fetch(
        read(), items, catalogs, "out", out, str(tmp_path / "ckpt"), fetched_at=NOW,
        on_batch=lambda n, results: seen.append((n, results.where("success").count())),
    ).awaitTermination()
    pages.where("page_id <= 2").coalesce(1).write.mode("append").parquet(folder)
    run()
    pages.where("page_id > 2").coalesce(1).write.mode("append").parquet(folder)
    run()  # resumes where the first one stopped
    one = FP.fetch_corpus(items, catalogs, pages, "out", fetched_at=NOW).documents
    cols = ["output_path", "source", "content"]
    assert sorted(map(tuple, spark.read.parquet(out).select(cols).collect())) == sorted(map(tuple, one.select(cols).collect()))
    assert len(seen) == 2


def test_render_source(spark):
    def render(url):
        if "bad" in url:
            raise OSError("gone")
        return f"<p>{url}"

    df = spark.createDataFrame([("u",), ("bad",)], "url string")
    assert {tuple(r) for r in render_pages(df, render).collect()} == {("u", "<p>u", None), ("bad", None, "render: gone")}


def test_progress_callbacks(spark, tmp_path):
    df = spark.createDataFrame([(True,), (False,), (True,)], "success boolean")
    watched, observation = observed(df)
    watched.collect()
    assert observation.get == {"total": 3, "completed": 2, "failed": 1}
    from quire.streaming.progress import observed_stream

    calls = []
    listener = ProgressListener(lambda *a: calls.append(a))
    spark.streams.addListener(listener)
    try:
        df.write.parquet(str(tmp_path / "p"))
        q = observed_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "p"))).writeStream.format("noop")
        q.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        import time

        for _ in range(50):
            if calls:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert calls[-1] == (3, 2, 1)


# ---- verify -----------------------------------------------------------------------------------------------------


def test_checks_and_updates(spark, corpus):
    pages, _, catalogs, cache = corpus
    asked = spark.createDataFrame(
        [("s", "http://s/a", "", None), ("s", "http://s/c", "//p", "xpath"), ("t", "http://s/c", None, "css"),
         ("s", "http://s/zz", "main", "css"), ("u", "http://s/a", "", ""), ("s", "http://s/b", "article", "jquery")],
        "site string, url string, selector string, type string",
    )
    chosen = V.resolve_selector(asked, catalogs)
    got = {(r.site, r.url): (r.selector, r.type, r.error) for r in chosen.collect()}
    assert got == {
        ("s", "http://s/a"): ("article", "css", None), ("s", "http://s/c"): ("//p", "xpath", None),
        ("t", "http://s/c"): ("//p", "xpath", None), ("s", "http://s/zz"): ("main", "css", None),
        ("u", "http://s/a"): (None, "css", "no_selector"), ("s", "http://s/b"): ("article", "jquery", "type"),
    }
    checks = V.verify_selectors(chosen.where("error is null"), pages, cache, fetched_at=NOW)
    found = {(r.url, r.selector): (r.success, r.word_count, r.error) for r in checks.collect()}
    assert found == {
        ("http://s/a", "article"): (True, 2, None), ("http://s/c", "//p"): (True, 2, None),
        ("http://s/zz", "main"): (False, 0, "render: page not available"),
    }
    verdicts = spark.createDataFrame([("s", "main", "css", True, 2), ("s", "zz", "css", True, 1), ("t", "x", "css", False, 3)], "site string, selector string, type string, success boolean, checked_at int")
    new = {r.site: (r.selectors.content, r.selectors.content_type) for r in V.update_selectors(catalogs, verdicts).collect()}
    assert new == {"s": ("main", "css"), "t": ("//p", "xpath")}


# ---- replies ----------------------------------------------------------------------------------------------------


def test_replies(spark):
    ok = json.dumps({"choices": [{"message": {"content": "hi"}}, {"message": {"content": "no"}}]})
    rows = [("ok", 200, ok), ("down", 500, "x"), ("bad", 200, "{"), ("err", 200, '{"error":{"message":"m","type":"t"}}'), ("none", 200, '{"choices":[]}')]
    got = {r.request_id: (r.text, r.error) for r in R.read_replies(spark.createDataFrame(rows, "request_id string, status int, body string")).collect()}
    assert got == {"ok": ("hi", None), "down": (None, "http 500: x"), "bad": (None, "bad json"), "err": (None, "api: m"), "none": (None, "no choices")}


def test_streamed_replies(spark):
    chunk = lambda s: "data: " + json.dumps({"choices": [{"delta": {"content": s}}]})
    streams = {
        "plain": [chunk("a"), "", "event: x", "  " + chunk("b") + " ", "data: {broken", "data: [DONE]", chunk("late")],
        "open": [chunk("x"), 'data: {"choices":[]}', chunk("y")],
        "error": [chunk("x"), 'data: {"error":{"message":"no"}}', 'data: {"error":{"message":"later"}}'],
        "after": [chunk("x"), "data: [DONE]", 'data: {"error":{"message":"no"}}'],
        "empty": ["nothing"],
        "tight": ["data:" + chunk("x")[6:]],
    }
    rows = [(k, i, line) for k, lines in streams.items() for i, line in enumerate(lines)]
    got = {r.request_id: (r.text, r.error) for r in R.read_stream(spark.createDataFrame(rows, "request_id string, line_no int, line string")).collect()}
    assert got == {"plain": ("ab", None), "open": ("xy", None), "error": (None, "api: no"), "after": ("x", None), "empty": ("", None), "tight": ("", None)}


def test_payload_and_analysis(spark):
    df = spark.createDataFrame([("s", "u")], "s string, u string")
    bare = json.loads(df.select(R.request_payload(F.col("s"), F.col("u"), "m")).first()[0])
    assert bare == {"model": "m", "messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}]}
    full = json.loads(df.select(R.request_payload(F.col("s"), F.col("u"), "m", 5, 0.2, True)).first()[0])
    assert (full["max_tokens"], full["temperature"], full["stream"]) == (5, 0.2, True)
    rows = [("a", '{"toc_selector":"x","content_selector":"y","confidence":0.5,"reasoning":"z"}'), ("b", "prose")]
    got = [tuple(r) for r in R.read_analysis(spark.createDataFrame(rows, "request_id string, text string")).orderBy("request_id").collect()]
    assert got == [("a", "x", "y", 0.5, "z", None), ("b", None, None, None, None, "bad json")]


def test_shared_folder(spark):
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_a_cache_that_holds_an_address_twice_gives_one_row(spark):
    from quire.functions.urls import url_hash as hashed
    from quire.sources import cache as C

    rows = [("http://h/1", "old", 1), ("http://h/1", "new", 2), ("http://h/2", "b", 1)]
    cache = spark.createDataFrame(rows, "url string, html string, fetched_at int").withColumn("url_hash", hashed("url"))
    items = spark.createDataFrame([("http://h/1",), ("http://h/1",), ("http://h/3",)], "url string")
    got = sorted((r.url, r.html, r.from_cache) for r in C.cache_lookup(items, cache).collect())
    assert got == [("http://h/1", "new", True), ("http://h/1", "new", True), ("http://h/3", None, False)]
