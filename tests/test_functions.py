from urllib.parse import urljoin

from quire.functions import text as T
from quire.functions import urls as U

BASE = "http://a/b/c/d;p?q"
RFC = [
    "g:h", "g", "./g", "g/", "/g", "//g", "?y", "g?y", "#s", "g#s", "g?y#s", ";x", "g;x", "g;x?y#s", ".", "./", "..",
    "../", "../g", "../..", "../../", "../../g", "../../../g", "../../../../g", "/./g", "/../g", "g.", ".g", "g..", "..g",
    "./../g", "./g/.", "g/./h", "g/../h", "g;x=1/./y", "g;x=1/../y", "g?y/./x", "g#s/../x",
]


def run(spark, values, column):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_resolve_follows_rfc_3986(spark):
    df = spark.createDataFrame([(i, BASE, r) for i, r in enumerate(RFC)], "i int, base string, ref string")
    got = [r[0] for r in df.orderBy("i").select(U.resolve("base", "ref")).collect()]
    assert got == [urljoin(BASE, r) for r in RFC]


def test_resolve_special_cases(spark):
    cases = {
        ("http://a/x?q#f", ""): "http://a/x?q#f", ("http://a/x?q#f", "#"): "http://a/x?q#f",
        ("http://a/", "/für"): "http://a/f%C3%BCr", ("http://a/", "/the,"): "http://a/the,",
        ("http://a/", "/a%20ü"): "http://a/a%20%C3%BC", ("http://a/", "/😀"): "http://a/%F0%9F%98%80",
        ("http://a/", "HTTP://h:80/p q"): "http://h:80/p%20q", ("http://a/", "mailto:x@y"): "mailto:x@y",
        ("http://a/", "javascript:void(0)"): "javascript:void(0)", ("http://a/", "//h x/p"): None,
        ("http://a/", "/a%zz"): None, ("http://a/", "1:2"): None, ("http://a b/", "/x"): None, ("http://a", "b"): "http://a/b",
    }
    df = spark.createDataFrame([(i, *k) for i, k in enumerate(cases)], "i int, base string, ref string")
    got = [r[0] for r in df.orderBy("i").select(U.resolve("base", "ref")).collect()]
    assert got == list(cases.values())


def test_host(spark):
    urls = ["http://A.b:80/x", "https://u:p@h/x", "http://[::1]:8/x", "mailto:x", "/p", "http://a b/", None]
    assert run(spark, urls, U.host("t")) == ["A.b", "h", "::1", "", "", None, None]


def test_names(spark):
    titles = ['a/\\:*?"<>|b\n\rc', "x" * 100, "x" * 101, "a" * 99 + "é", "   ", "", ".", "..", " x "]
    want = ["a_________bc", "x" * 100, "x" * 100, "a" * 99 + "�", "untitled", "untitled", "_", "__", "x"]
    assert run(spark, titles, T.safe_name("t")) == want
    assert run(spark, ["a.b:8"], U.site_file("t")) == ["catalog-a-b-8.json"]
    assert run(spark, ["http://x", "https://x", "ftp://x", "http:/"], U.is_http("t")) == [True, True, False, False]


def test_words(spark):
    texts = ["well-known", "中a文b", "a\rb", "a b", " x ", "", "# a *b* [c](d)", "a\n\n\nb\tc"]
    assert run(spark, texts, T.count_words("t")) == [1, 4, 1, 1, 1, 0, 3, 3]


def test_clean_markdown(spark):
    cases = {
        "本页总览  \nx": "x\n", "a目录 \nq": "a\nq\n", "get_user_id a": "a\n", "codeBlockLines_e6Vv": "codeBlockLines_e6Vv\n",
        "```text\nx\n```\n": "```\nx\n```\n", "```Go\nx": "```Go\nx\n", "```golang\nx": "```\nx\n", "``` go\nx": "``` go\nx\n",
        "```\nword\n": "```\n", "```\ngo\n": "```\ngo\n", "a\n\n\n\nb": "a\n\nb\n", "a\n \n \n \nb  \t": "a\n\n\n\nb\n",
        "": "\n", "　x ": "x\n",
    }
    assert run(spark, list(cases), T.clean_markdown("t")) == list(cases.values())
    assert run(spark, ["get_user_id", "```text\nx"], T.clean_markdown("t", False, False)) == ["get_user_id\n", "```text\nx\n"]


def test_front_matter_source(spark):
    cases = {
        "---\ntitle: a\nsource: http://x\nword_count: 1\n---\n\nb": "http://x", '---\nsource: "http://x"\n---\n': "http://x",
        "source: x": None, "---\nsource: x\n": None, "---\nsource: a\nsource: b\n---\n": "a",
        "---\ntitle: a\n---\nsource: x": None, "---\n  source:   y'\n---\n": "y",
    }
    assert run(spark, list(cases), T.front_matter_source("t")) == list(cases.values())


def test_title_cannot_forge_a_source(spark):
    df = spark.createDataFrame([("x\nsource: evil", "http://u")], "t string, u string")
    from pyspark.sql import functions as F

    head = T.front_matter(F.col("t"), F.col("u"), F.lit("now"), F.lit(1))
    assert df.select(T.front_matter_source(head)).first()[0] == "http://u"


def test_unescape_and_preview(spark):
    texts = ["&amp;lt; &#65;&#x42; &copy; &bogus; &", "x", None, "&#0;&#xD800;&#128512;"]
    assert run(spark, texts, T.unescape("t")) == ["&lt; AB © &bogus; &", "x", None, "��😀"]
    assert run(spark, ["a\nb\nc", "a"], T.preview_head("t", 2)) == ["a\nb", "a"]
    assert run(spark, ["a\nb\nc", "a", None], T.preview_rest("t", 2)) == [1, 0, None]


def test_long_blank_runs_take_linear_time(spark):
    import time

    run = " " * 200_000
    df = spark.createDataFrame([("a" + run + "b",), (run,)], "t string")
    start = time.time()
    rows = df.select(T.trim_unicode("t").alias("a"), T.right_trim_lines("t").alias("b"), T.count_words("t").alias("n")).collect()
    assert time.time() - start < 10
    assert [len(r.a) for r in rows] == [200_002, 0] and [len(r.b) for r in rows] == [200_002, 0] and [r.n for r in rows] == [2, 0]


def test_character_references_follow_the_standard(spark):
    cases = {
        "&copy 2024": "© 2024", "&amp b": "& b", "&check;": "✓", "&#0000000065;": "A", "&#150;": "–", "&#x41": "A", "&notit;": "¬it;",
        "&unknown;": "&unknown;", "&#0;": "�", "&#99999999999999999999;": "�", "&": "&", "&&lt;": "&<", "&ampx": "&x", "&#xD800;": "�",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: (r.u, r.a) for r in df.select("t", T.unescape("t").alias("u"), T.unescape("t", attribute=True).alias("a")).collect()}
    assert {k: v[0] for k, v in got.items()} == cases
    assert got["&ampx"][1] == "&ampx" and got["&copy 2024"][1] == "© 2024"
