import random

import pytest
from pyspark.sql import functions as F

from quire.functions import constants as K
from quire.operators import html as H
from quire.operators import selectors as S


def pages(spark, docs):
    return spark.createDataFrame([(i, f"http://h/{i}", d) for i, d in enumerate(docs)], "page_id long, url string, html string")


BROKEN = [
    "<div id=a><p>one<p>two <b>x<div>y</div></div>z",
    "<ul><li>a<li><b>b</b><ul><li>c</ul><li>d</ul>",
    "<table><tr><td>1<td>2<tr><td>3</table>",
    "<A href='x>y' Class=\"k j\">t<p>q</p></A><br/>w",
    "<div><b>x</div>y</b>",
    "<script>var t='<p>';</script>tail</div><i>",
    "hello a < b <b>c</b>",
    None,
    "",
    "<!-- <p> --><!DOCTYPE x><p>a",
]
BROKEN_NODES = {
    (0, 1, 7, None, "div"), (0, 2, 3, 1, "p"), (0, 3, 5, 1, "p"), (0, 4, 5, 3, "b"), (0, 5, 6, 1, "div"),
    (1, 1, 10, None, "ul"), (1, 2, 3, 1, "li"), (1, 3, 9, 1, "li"), (1, 4, 5, 3, "b"), (1, 6, 8, 3, "ul"), (1, 7, 8, 6, "li"),
    (1, 9, 10, 1, "li"), (2, 1, 7, None, "table"), (2, 2, 5, 1, "tr"), (2, 3, 4, 2, "td"), (2, 4, 5, 2, "td"),
    (2, 5, 7, 1, "tr"), (2, 6, 7, 5, "td"), (3, 1, 4, None, "a"), (3, 2, 3, 1, "p"), (3, 5, 6, None, "br"),
    (4, 1, 3, None, "div"), (4, 2, 3, 1, "b"), (5, 1, 2, None, "script"), (5, 3, 4, None, "i"), (6, 1, 2, None, "b"),
    (9, 3, 4, None, "p"),
}


def nodes_of(df):
    return {(r.page_id, r.start_pos, r.end_pos, r.parent_pos, r.tag) for r in df.collect()}


def test_broken_markup(spark):
    assert nodes_of(H.html_nodes(pages(spark, BROKEN), parents=True)) == BROKEN_NODES


def random_document(rng, depth=0):
    """Well-formed markup together with the elements a stack finds in it."""
    out = []
    for _ in range(rng.randint(1, 3)):
        tag = rng.choice(["div", "section", "span", "em", "ul", "li", "p", "br", "custom-x"])
        if tag == "br":
            out.append("<br>t")
        elif tag == "p" or depth > 4:
            out.append(f"<{tag} class='c{rng.randint(0, 2)}'>x</{tag}>")
        else:
            out.append(f"<{tag} id=i{rng.randint(0, 3)} class='c{rng.randint(0, 2)} d'>{random_document(rng, depth + 1)}</{tag}>u")
    return "".join(out)


def stack_nodes(page, doc):
    """Elements by the textbook stack."""
    import re

    out, stack = [], []
    for pos, m in enumerate(re.finditer(r"<(/?)([a-z-]+)([^>]*)>[^<]*", doc), 1):
        close, tag, attrs = m.groups()
        if close:
            i = stack.pop()
            out[i][2] = pos
            continue
        parent = out[stack[-1]][1] if stack else None
        out.append([page, pos, pos + 1, parent, tag, attrs])
        if tag != "br":
            stack.append(len(out) - 1)
    return out


@pytest.fixture(scope="module")
def random_pages():
    rng = random.Random(7)
    docs = ["<html><body>" + random_document(rng) + "</body></html>" for _ in range(40)]
    # a paragraph cannot hold one, so keep documents in which no p sits around a block
    return docs


def test_well_formed_markup_matches_a_stack(spark, random_pages):
    got = nodes_of(H.html_nodes(pages(spark, random_pages), parents=True))
    want = {tuple(n[:5]) for i, d in enumerate(random_pages) for n in stack_nodes(i, d)}
    assert got == want


def matches(nodes, chain):
    """Selector matching by walking up from every element."""
    by_pos = {n[1]: n for n in nodes}

    def fits(n, step):
        attrs = n[5]
        if step.tag and n[4] != step.tag:
            return False
        import re

        cls = (re.search(r"class='([^']*)'", attrs) or [None, ""])[1].split()
        ident = (re.search(r"id=(\w+)", attrs) or [None, None])[1]
        for what, name, _ in step.tests:
            hit = name in cls if what.endswith("class") else ident == name
            if hit == what.startswith("not-"):
                return False
        return True

    def climb(n, i):
        if not fits(n, chain[i]):
            return False
        if i == 0:
            return True
        up = by_pos.get(n[3])
        if chain[i].link == ">":
            return up is not None and climb(up, i - 1)
        while up is not None:
            if climb(up, i - 1):
                return True
            up = by_pos.get(up[3])
        return False

    return {n[1] for n in nodes if climb(n, len(chain) - 1)}


SELECTORS = [
    "div .c1", "div > .c0", "#i1 span", "section div > em", ".d .d .d", "ul > li", "li:not(.c2) > *", "div.c1.d#i2",
    "body > div section p", "* > * > p, br", "custom-x .c1:not(#i1)",
]


def test_selectors_match_brute_force(spark, random_pages):
    nodes = H.html_nodes(H.clustered(pages(spark, random_pages)))
    hits = S.css_select(nodes, list(enumerate(SELECTORS))).collect()
    got = {(r.selector_id, r.page_id, r.start_pos) for r in hits}
    want = set()
    for p, d in enumerate(random_pages):
        trees = stack_nodes(p, d)
        for i, sel in enumerate(SELECTORS):
            for chain in S.parse_css(sel):
                want |= {(i, p, pos) for pos in matches(trees, chain)}
    assert got == want


def test_xpath_takes_the_first_match(spark):
    doc = "<html><body><div class='x content'><ul><li>a</li><li id=q>b</li></ul></div><ul><li>c</li><li>d</li></ul></body></html>"
    nodes = H.html_nodes(pages(spark, [doc]))
    cases = {"//li": 5, "//ul/li[2]": 7, "/html/body/ul": 11, "//div[contains(@class,'content')]//li[2]": 7, "//*[@id='q']": 7}
    for path, start in cases.items():
        assert S.xpath_select(nodes, path).first().start_pos == start, path
    assert S.xpath_select(nodes, "/body").count() == 0


@pytest.mark.parametrize("bad", ["a:hover", "a + b", "a,,b", "> a", "a >", "", "a~b", "a[x^='y']", "a,", "::x", ":not(a b)"])
def test_unsupported_css_is_refused(bad):
    with pytest.raises(ValueError):
        S.parse_css(bad)


@pytest.mark.parametrize("bad", ["a", "", "//a/@href", "//a[text()='x']", "//a[1][2]", "//a|//b"])
def test_unsupported_xpath_is_refused(bad):
    with pytest.raises(ValueError):
        S.parse_xpath(bad)


def test_all_fixed_selectors_parse():
    for sel in [s for s, _ in K.TOC_CANDIDATES] + K.CONTENT_CANDIDATES + K.COLLAPSED_SELECTORS:
        assert S.parse_css(sel)
    with pytest.raises(ValueError):
        S.parse("a", "jquery")


def test_attributes(spark):
    doc = """<a HREF="x&amp;y" class='p  q' data-k disabled title="a class=z" href=2>t</a>"""
    row = H.html_tokens(pages(spark, [doc])).where("kind = 'open'").select(
        "attrs", H.attr("href"), H.attr("class"), H.attr("disabled"), H.attr("missing"), H.attr("title"), "classes"
    ).first()
    assert row[0] == {"href": "x&y", "class": "p  q", "data-k": "", "disabled": "", "title": "a class=z"}
    assert list(row[1:6]) == ["x&y", "p  q", "", None, "a class=z"]
    assert row[6] == ["p", "q"]


def test_long_documents_do_not_overflow(spark):
    doc = "<p>" + "a < b " * 50_000 + "<i title='" + "x" * 100_000 + "'>y</i>"
    assert H.html_tokens(pages(spark, [doc]), with_attributes=False).count() == 4


def test_odd_quotes_keep_their_text(spark):
    markup = ["<a href=foo'>LOST text</a> end", '<p title="a>b">in</p>', "<p don't>in</p>", '<a href="x>kept</a>', "<a x = 'y'>in</a>"]
    df = spark.createDataFrame(list(enumerate(markup)), "page_id int, html string")
    tokens = df.select("page_id", F.array_join(F.transform(H.token_array("html"), H.text_of), "|").alias("t"))
    got = {r.page_id: r.t.strip("|") for r in tokens.collect()}
    assert got == {0: "LOST text| end", 1: "in", 2: "in", 3: "kept", 4: "in"}


def test_elements_that_hold_text_only(spark):
    docs = [
        "<title>a <b>b</b></title><p>x</p>",
        "<div><textarea rows=2><a href='/x'>n</a></textareas></TEXTAREA><noscript><img src=y></noscript></div>",
        "<iframe><p>never closed",
        "<xmp></xmp><titles><b>t</b></titles>",
    ]
    df = pages(spark, docs)
    assert nodes_of(H.html_nodes(df, parents=True)) == {
        (0, 1, 2, None, "title"), (0, 3, 4, None, "p"), (1, 1, 6, None, "div"), (1, 2, 3, 1, "textarea"), (1, 4, 5, 1, "noscript"),
        (2, 1, 2, None, "iframe"), (3, 1, 2, None, "xmp"), (3, 3, 6, None, "titles"), (3, 4, 5, 3, "b"),
    }
    texts = df.select("page_id", F.transform(H.token_array("html"), H.text_of).alias("t")).collect()
    by_page = {r.page_id: r.t for r in texts}
    assert by_page[0][1] == "a <b>b</b>" and by_page[1][2] == "<a href='/x'>n</a></textareas>"
