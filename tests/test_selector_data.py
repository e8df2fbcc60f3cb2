"""Selectors that are data: taken apart in their rows, tested against the page they belong to."""

import time

import pytest
from pyspark.sql import functions as F

from quire.functions import constants as K
from quire.functions.urls import url_hash
from quire.operators import html as H
from quire.operators import markdown as M
from quire.operators import selectors as S
from quire.plans import fetch as FP
from quire.plans import verify as V
from tests.test_html import SELECTORS, pages, random_document

NOW = "2024-05-06 07:08:09"
GOOD = [(s, "css") for s in [*SELECTORS, *[s for s, _ in K.TOC_CANDIDATES], *K.CONTENT_CANDIDATES, *K.COLLAPSED_SELECTORS, "A.B#c", "[data-x = 'a b'] > p", "div:not( .x )", ' [a="," ] , p']]
GOOD += [(p, "xpath") for p in ["//li", "//ul/li[2]", "/html/body/ul", "//div[contains(@class,'content')]//li[2]", "//*[@id='q']", "//A[@HREF=\"x\"][3]", " //p "]]
BAD = [(s, "css") for s in ["a:hover", "a + b", "a,,b", "> a", "a >", "", "a~b", "a[x^='y']", "a,", "::x", ":not(a b)", "p:first-child", "a[", "a > > b", "a'", ".1x"]]
BAD += [(p, "xpath") for p in ["a", "", "//a/@href", "//a[text()='x']", "//a[1][2]", "//a|//b", "//a[1]x", "///a"]] + [("a", "jquery"), ("a", None), (None, "css")]


def steps_of(chains):
    out = []
    for chain in chains:
        for k, s in enumerate(chain):
            tests = [(w, n if w.endswith(("class", "id")) else n.lower(), v) for w, n, v in s.tests]
            out.append((k == 0, k == len(chain) - 1, s.link, s.tag and s.tag.lower(), tests, s.nth))
    return out


def test_compiled_in_a_row_as_on_the_driver(spark):
    df = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(GOOD + BAD)], "i int, s string, t string")
    rows = df.select("i", S.compiled(F.col("s"), F.col("t")).alias("c")).orderBy("i").collect()
    for r in rows[: len(GOOD)]:
        got = [(x.first, x.last, x.link, x.tag, [(t.what, t.name, t.value) for t in x.tests], x.nth) for x in r.c]
        assert got == steps_of(S.parse(*GOOD[r.i])), GOOD[r.i]
    for r in rows[len(GOOD) :]:
        assert r.c is None, (GOOD + BAD)[r.i]


def test_first_span_is_the_first_hit(spark):
    import random

    rng = random.Random(11)
    docs = ["<html><body>" + random_document(rng) + "</body></html>" for _ in range(20)] + [None, "", "<p>x"]
    wanted = [(s, "css") for s in ("section div > em", ".d .d .d", "li:not(.c2) > *")] + [("//li[2]", "xpath"), ("/html/body/*[2]", "xpath"), ("//*[@id='i1']//p", "xpath")]
    rows = H.shredded(pages(spark, docs))
    by_list = F.array(*[F.get(S.hits(F.col("elements"), [w]), F.lit(0))["start_pos"] for w in wanted])
    known = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(t).alias("t")) for s, t in wanted])
    by_row = F.transform(known, lambda w: S.first_span(F.col("elements"), S.compiled(w["s"], w["t"]))["start_pos"])
    got = rows.select(by_list.alias("a"), by_row.alias("b")).collect()
    assert all(r.a == r.b for r in got) and any(x is not None for r in got for x in r.a)


def test_many_selectors_and_a_bad_one(spark):
    """5,000 different selectors over 58 sites, one of them outside the grammar: it has an error, the others their content."""
    doc = "<html><body><article><h1>T</h1><p>one two</p></article></body></html>"
    sites = [f"h{i}.example" for i in range(58)]
    page_rows = spark.createDataFrame([(f"http://{s}/p", doc) for s in sites], "url string, html string")
    asked = [(f"http://{sites[i % 58]}/p", f"article:not(.c{i})", "css") for i in range(4999)] + [(f"http://{sites[0]}/p", "p:first-child", "css")]
    checks = V.verify_selectors(spark.createDataFrame(asked, "url string, selector string, type string"), page_rows, fetched_at=NOW)
    began = time.time()
    got = {(r.url, r.selector): (r.success, r.word_count, r.error) for r in checks.select("url", "selector", "success", "word_count", "error").collect()}
    assert len(got) == 5000 and time.time() - began < 300
    assert got.pop((f"http://{sites[0]}/p", "p:first-child")) == (False, 0, S.UNSUPPORTED)
    assert set(got.values()) == {(True, 3, None)}


def test_a_bad_catalog_fails_by_itself(spark):
    css = "struct<toc:string,content:string,toc_type:string,content_type:string>"
    catalogs = spark.createDataFrame([("a", (None, "p:hover", None, None)), ("b", (None, "article", None, ""))], f"site string, selectors {css}")
    items = spark.createDataFrame([(s, 1, 1, "t", f"http://{s}/x") for s in "abc"], "site string, idx long, depth int, title string, url string")
    docs = spark.createDataFrame([(f"http://{s}/x", "<article><p>hi</p></article>") for s in "abc"], "url string, html string")
    rows = FP.fetch_corpus(items, catalogs, docs, "out", fetched_at=NOW).results.collect()
    assert {r.site: (r.success, r.error) for r in rows} == {"a": (False, S.UNSUPPORTED), "b": (True, None), "c": (False, "parse: no usable selector")}


def test_a_page_is_taken_apart_once_for_all_selectors(spark):
    wants = F.array(*[F.struct(F.lit(s).alias("selector"), F.lit("css").alias("type")) for s in ("h1", "p", "main")])
    work = pages(spark, ["<h1>a</h1><p>b <b>c</b></p>"]).withColumn("wants", wants).withColumn("url_hash", url_hash("url"))
    rows = M.convert_wanted(work, ("url_hash",), include_meta=False).collect()
    assert {r.selector: (r.content, r.error) for r in rows} == {"h1": ("a\n", None), "p": ("b **c**\n", None), "main": (None, "content_not_found")}


@pytest.mark.parametrize("n", [20_000])
def test_long_pages_in_one_pass(spark, n):
    """Tens of thousands of elements, open ones and cuts: linear work."""
    doc = "<ul>" + "".join(f"<li>a<nav>x</nav><b>{i}" for i in range(n // 10)) + "</ul>" + "<p>t" * (n // 10) + "<i></i>" * (n // 10)
    began = time.time()
    assert H.html_nodes(pages(spark, [doc])).count() == 1 + 3 * (n // 10) + 2 * (n // 10)
    html = M.clean_html(pages(spark, [doc])).first().html
    assert "nav" not in html and html.count("<li>") == n // 10 and time.time() - began < 60
