"""The registered queries: every operator run over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions import urls as U
from quire.operators import html as H
from quire.operators import markdown as M
from quire.operators import outcomes as O
from quire.operators import replies as R
from quire.operators import selectors as S
from quire.operators import toc, tree
from quire.plans import fetch as FP
from quire.plans import verify as V
from quire.plans.scan import scan_catalogs
from quire.session import scratch_path, settle
from quire.sources import cache as C
from quire.sources import catalogs as CAT
from quire.sources import markdown_files as MF
from quire.sources.pages import read_pages, render_pages, stream_pages, stream_place
from quire.streaming.fetch import stream_fetch, stream_progress

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

STAMP = "2024-01-01 00:00:00"
TREE_COLUMNS = ("idx", "parent_idx", "depth", "title", "url")
CSS = ["nav ul a", "article p", "ul > li > a", "body > article h1", "div.ad", "p b", "html:not([dir]) > body > nav", "h1, footer"]
CHECKS = [("article", "css"), ("//div[@class='ad']", "xpath"), ("main", "css")]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pages_of(spark: SparkSession, sf: str) -> DataFrame:
    return read_pages(spark, f"{sf}/pages.parquet")


def markup_of(spark: SparkSession, sf: str) -> DataFrame:
    """The pages for work on their markup."""
    return H.spread(pages_of(spark, sf))


def stamp() -> Column:
    return F.lit(STAMP).cast("timestamp")


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


# ---- pages, tokens, elements, selection ---------------------------------------------------------------------


@query
def page_scan(spark, sf):
    return pages_of(spark, sf).select("page_id", "url", F.length("html").cast("bigint").alias("chars"))


@query
def html_tokens(spark, sf):
    tokens = H.html_tokens(markup_of(spark, sf), with_attributes=False)
    return longs(tokens.select("page_id", "pos", "kind", "tag", "text"), "pos")


@query
def html_nodes(spark, sf):
    nodes = H.html_nodes(markup_of(spark, sf).select("page_id", "html"), parents=True)
    return longs(nodes.select("page_id", "start_pos", "end_pos", "parent_pos", "depth", "tag"), "start_pos", "end_pos", "parent_pos", "depth")


#: Elements that hold text only, around markup that is none.
TEXT_ONLY = ("<textarea><q>a</q></textarea>", "<title><q>b</q></title>", "<noscript><q>c</q>", "</noscript><iframe><q></iframe>", "<xmp></q></xmp>", "<q>d</q>")


@query
def odd_markup(spark, sf):
    """How many elements of some names each page has behind elements that hold text only."""
    pages = markup_of(spark, sf).withColumn("html", F.concat(F.lit("".join(TEXT_ONLY)), F.coalesce("html", F.lit(""))))
    nodes = H.html_nodes(pages).where(F.col("tag").isin("textarea", "noscript", "iframe", "xmp", "q", "title"))
    return nodes.groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("elements"))


@query
def tag_attributes(spark, sf):
    tokens = H.html_tokens(markup_of(spark, sf)).where(F.col("kind").isin("open", "void"))
    rows = tokens.select("page_id", "pos", "tag", F.explode("attrs").alias("name", "value"))
    return longs(rows, "pos")


@query
def css_select(spark, sf):
    pages = markup_of(spark, sf).select("page_id", "html")
    nodes = H.html_nodes(pages)
    hits = S.css_select(nodes, list(enumerate(CSS)))
    return longs(hits.select("page_id", "selector_id", "start_pos", "end_pos"), "selector_id", "start_pos", "end_pos")


@query
def xpath_select(spark, sf):
    nodes = H.html_nodes(markup_of(spark, sf).select("page_id", "html"))
    return longs(S.xpath_select(nodes, "//ul/li[2]/a"), "start_pos", "end_pos")


@query
def content_html(spark, sf):
    return M.extract_content(markup_of(spark, sf), "article")


@query
def node_text(spark, sf):
    return M.extract_text(markup_of(spark, sf), "article")


@query
def clean_html(spark, sf):
    return M.clean_html(markup_of(spark, sf))


# ---- navigation and content regions ----------------------------------------------------------------------------


@query
def toc_links(spark, sf):
    links = toc.toc_links(markup_of(spark, sf))
    links = links.withColumn("ord", F.rank().over(_by("page_id", "selector_id", order="ord")))
    return longs(links, "selector_id", "ord", "level")


def _by(*keys: str, order: str):
    from pyspark.sql import Window

    return Window.partitionBy(*keys).orderBy(order)


@query
def toc_scores(spark, sf):
    scores = toc.toc_scores(markup_of(spark, sf)).withColumn("score", F.round("score", 6))
    return longs(scores, "selector_id", "links", "valid_links")


@query
def toc_best(spark, sf):
    best = toc.best_toc(toc.toc_scores(markup_of(spark, sf)))
    return best.select("page_id", "selector", F.round("score", 6).alias("score"))


@query
def content_selector(spark, sf):
    return toc.detect_content(markup_of(spark, sf))


@query
def scan_catalog(spark, sf):
    catalogs, _ = scan_catalogs(markup_of(spark, sf))
    return catalogs.select(
        "page_id", "site", "url", F.col("selectors.toc").alias("toc"), F.col("selectors.content").alias("content"),
        "ai_generated", F.round("confidence", 6).alias("confidence"), "root_items", "error",
    )


@query
def scan_items(spark, sf):
    _, items = scan_catalogs(markup_of(spark, sf))
    return longs(items.select("page_id", *TREE_COLUMNS), "idx", "parent_idx", "depth")


@query
def catalog_items_count(spark, sf):
    _, items = scan_catalogs(markup_of(spark, sf))
    return tree.count_items(items, ["page_id"])


@query
def collapsed_nav(spark, sf):
    return toc.collapsed_nav(markup_of(spark, sf))


#: Folded-up navigation and the same opened, a pair for each selector of ``K.COLLAPSED_SELECTORS``.
FOLDED = [
    ("<button aria-expanded='false'>x</button>", "<button aria-expanded='true'>x</button>"),
    ("<i class='collapse-toggle'>x</i>", "<i class='collapse-toggle open'>x</i>"),
    ("<i class='expand-button'>x</i>", "<i class='expand-button expanded'>x</i>"),
    ("<i data-toggle='collapse'>x</i>", "<i data-toggle='collapse' class='collapsed'>x</i>"),
    ("<div class='sidebar-group'><p class='sidebar-heading'>x</p></div>", "<div class='sidebar-group open'><p class='sidebar-heading'>x</p></div>"),
    ("<a class='nav-link' aria-expanded='false'>x</a>", "<a class='nav-link' aria-expanded='true'>x</a>"),
    ("<div class='vp-sidebar-group'><p><i class='caret open'>x</i></p></div>", "<div class='vp-sidebar-group open'><i class='caret open'>x</i></div>"),
    ("<div class='menu__list-item--collapsed'><i class='menu__link--sublist'>x</i></div>", "<div class='menu__list-item'><i class='menu__link--sublist'>x</i></div>"),
    ("<div class='theme-doc-sidebar-item-collapsed'><p><i class='menu__link--sublist'>x</i></div>", "<div><i class='menu__link--sublist'>x</i></div>"),
    ("<p data-expanded='false'>x</p>", "<p data-expanded='true'>x</p>"),
    ("<i class='arrow'>x</i>", "<i class='arrow down'>x</i>"),
    ("<i class='caret'>x</i>", "<i class='caret open'>x</i>"),
    ("<i class='chevron right'>x</i>", "<i class='chevron rotated'>x</i>"),
    ("<details><summary>x</summary>y</details>", "<details open><summary>x</summary>y</details>"),
    ("<div class='nav-item collapsed'><a class='nav-link'>x</a></div>", "<div class='nav-item'><a class='nav-link'>x</a></div>"),
    ("<div class='folder'><i class='folder-toggle'>x</i></div>", "<div class='folder open'><i class='folder-toggle'>x</i></div>"),
    ("<div class='toc-item'><p><i class='toc-toggle'>x</i></p></div>", "<div class='toc-item expanded'><i class='toc-toggle'>x</i></div>"),
    ("<div class='tree-item'><i class='tree-toggle'>x</i></div>", "<div class='tree-item open'><i class='tree-toggle'>x</i></div>"),
]


@query
def collapsed_nav_wrapped(spark, sf):
    """The report on pages that hold one folded-up element per selector, each on the pages that its place in the list divides."""
    pieces = [F.when(F.col("page_id") % (i + 1) == 0, folded).otherwise(opened) for i, (folded, opened) in enumerate(FOLDED)]
    return toc.collapsed_nav(markup_of(spark, sf).withColumn("html", F.concat(F.lit("<div>"), *pieces, F.lit("</div>"), F.coalesce("html", F.lit("")))))


#: References of every form: named with and without a semicolon, unknown, decimal, hexadecimal, Windows-1252, impossible, none.
REFERRING = ["&amp;", "&copy", "&notin;", "&notit;", "&nosuch;", "&#65;", "&#x41;", "&#150;", "&#0;", "&#xD800;", "& ", "&CounterClockwiseContourIntegral;", "&fjlig;"]


@query
def text_references(spark, sf):
    """Every kind of reference behind the source of every document, decoded."""
    docs = table(spark, sf, "documents").select("doc_id", F.posexplode(F.array(*map(F.lit, REFERRING))).alias("kind", "ref"), "source")
    text = F.concat(F.coalesce("source", F.lit("")), F.col("ref"), F.lit("|"))
    return docs.select("doc_id", F.col("kind").cast("bigint").alias("kind"), T.unescape(text).alias("text"))


# ---- content pipeline -----------------------------------------------------------------------------------------------


@query
def page_markdown(spark, sf):
    work = markup_of(spark, sf).withColumn("want", F.lit(0))
    return M.convert(work, [("article", "css")], fetched_at=stamp()).select("page_id", "title", "content", "word_count", "error")


@query
def body_markdown(spark, sf):
    work = markup_of(spark, sf).withColumn("want", F.lit(0))
    return M.convert(work, [M.BODY], include_meta=False).select("page_id", "content", "word_count")


def _requests(spark, sf) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(s).alias("selector"), F.lit(t).alias("type")) for s, t in CHECKS])
    return pages_of(spark, sf).select("url", F.explode(pairs).alias("s")).select("url", "s.*")


@query
def selector_checks(spark, sf):
    checks = V.verify_selectors(_requests(spark, sf), pages_of(spark, sf), fetched_at=stamp())
    return longs(checks.select("url", "selector", "type", "success", "word_count", "bytes", "preview", "lines_left", "error"), "lines_left")


@query
def selector_coverage(spark, sf):
    checks = V.verify_selectors(_requests(spark, sf), pages_of(spark, sf), fetched_at=stamp())
    return V.selector_coverage(checks)


def _site_catalogs(spark, sf) -> DataFrame:
    """One catalog per host, read with ``article``."""
    site = pages_of(spark, sf).select(U.host("url").alias("site")).distinct()
    css = F.lit(None).cast("string")
    selectors = F.struct(
        F.lit("nav ul a").alias("toc"), F.lit("article").alias("content"), css.alias("toc_type"), css.alias("content_type")
    )
    return site.withColumn("selectors", selectors)


def _site_items(spark, sf) -> DataFrame:
    """The pages of each host as its items, titled by the last part of their address."""
    pages = pages_of(spark, sf).select("page_id", "url", U.host("url").alias("site"))
    flat = tree.preorder_index(pages, ["site"], ["page_id"])
    title = F.regexp_extract("url", r"([^/?#]*)(?:[?#].*)?$", 1)
    return flat.select("site", "idx", F.lit(1).alias("depth"), title.alias("title"), "url")


def _page_cache(spark, sf) -> DataFrame:
    """A cache of the pages that came by https."""
    secure = pages_of(spark, sf).where(F.col("url").startswith("https://"))
    return secure.select(U.url_hash("url").alias("url_hash"), "url", "html", stamp().alias("fetched_at"))


def _done(spark, sf) -> DataFrame:
    """What has been written: the pages whose number is among the labelled documents."""
    items = tree.output_paths(tree.flatten_catalog(_site_items(spark, sf)), F.concat(F.lit("out/"), F.col("site")))
    labelled = table(spark, sf, "labels").select(F.col("doc_id").alias("page_id"))
    pages = pages_of(spark, sf).join(labelled, "page_id", "left_semi").select("url")
    return items.join(pages, "url", "left_semi").select("output_path", F.col("url").alias("source"))


def _fetch(spark, sf) -> FP.Fetch:
    return FP.fetch_corpus(
        _site_items(spark, sf), _site_catalogs(spark, sf), pages_of(spark, sf), "out", _page_cache(spark, sf),
        _done(spark, sf), fetched_at=stamp(),
    )


@query
def fetch_results(spark, sf):
    r = _fetch(spark, sf).results
    return r.select("site", "idx", "title", "url", "output_path", "skipped", "from_cache", "word_count", "success", "error")


@query
def fetch_documents(spark, sf):
    d = _fetch(spark, sf).documents
    return d.select("site", "output_path", "source", F.md5("content").alias("content_md5"))


@query
def fetch_word_totals(spark, sf):
    return O.word_totals(_fetch(spark, sf).results)


@query
def fetch_new_pages(spark, sf):
    return _fetch(spark, sf).new_pages.select("url", F.md5("html").alias("html_md5"))


@query
def fetch_stream(spark, sf):
    """Two passes over the stream: the second finds everything done and writes nothing."""
    out = scratch_path(spark, "stream-out")
    for attempt in ("first", "second"):
        stream_fetch(
            stream_pages(spark, *stream_place(spark, f"{sf}/pages.parquet")), _site_items(spark, sf), _site_catalogs(spark, sf), "out", out,
            scratch_path(spark, f"stream-{attempt}"), fetched_at=stamp(),
        ).awaitTermination()
    return spark.read.parquet(out).select("site", "output_path", "source", F.md5("content").alias("content_md5"))


@query
def rendered_pages(spark, sf):
    """Pages missing from the cache, from a function of the caller."""
    pending = pages_of(spark, sf).select("url").join(_page_cache(spark, sf).select("url"), "url", "left_anti")
    return render_pages(pending, lambda url: f"<h1>{url}</h1>")


@query
def markdown_round_trip(spark, sf):
    """Documents written with front matter; their source read back from the text itself."""
    docs = table(spark, sf, "documents")
    source = F.concat(F.lit("http://example.org/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"))
    content = F.concat(T.front_matter(T.one_line(F.col("lang")), source, F.lit(STAMP), F.col("n_chars")), F.col("text"))
    path = F.concat(F.lit("out/"), F.col("doc_id").cast("string"), F.lit(".md"))
    out = scratch_path(spark, "markdown")
    MF.write_markdown(docs.select(F.col("source").alias("site"), path.alias("output_path"), source.alias("source"), content.alias("content")), out)
    return MF.sources_of(spark.read.parquet(out))


# ---- selectors of catalogs -----------------------------------------------------------------------------------------


@query
def resolve_selector(spark, sf):
    """Checks on pages with a query bring a selector of their own; the others use the catalog's."""
    own = F.col("url").contains("?")
    requests = pages_of(spark, sf).select(
        U.host("url").alias("site"), "url", F.when(own, "//h1").otherwise("").alias("selector"),
        F.when(own, "xpath").alias("type"),
    )
    return V.resolve_selector(requests, _site_catalogs(spark, sf))


@query
def update_selectors(spark, sf):
    """Sites with a secure page get a new selector."""
    checks = pages_of(spark, sf).select(
        U.host("url").alias("site"), F.lit("main").alias("selector"), F.lit("css").alias("type"),
        F.col("url").startswith("https://").alias("success"), F.col("page_id").alias("checked_at"),
    )
    out = V.update_selectors(_site_catalogs(spark, sf), checks)
    return out.select("site", F.col("selectors.content").alias("content"), F.col("selectors.content_type").alias("content_type"))


# ---- cache -------------------------------------------------------------------------------------------------------------


@query
def cache_lookup(spark, sf):
    found = C.cache_lookup(pages_of(spark, sf).select("page_id", "url"), _page_cache(spark, sf))
    return found.select("page_id", "url_hash", "from_cache", F.length("html").cast("bigint").alias("chars"))


@query
def cache_has(spark, sf):
    return C.cache_has(pages_of(spark, sf).select("page_id", "url"), _page_cache(spark, sf))


@query
def cache_upsert(spark, sf):
    new = pages_of(spark, sf).where(F.col("url").contains("?")).select(
        "url", F.concat(F.lit("new "), F.col("url")).alias("html"), F.lit("2024-02-01").cast("timestamp").alias("fetched_at")
    )
    merged = C.cache_upsert(_page_cache(spark, sf), new)
    return merged.select("url_hash", "url", F.md5("html").alias("html_md5"), "fetched_at")


@query
def cache_stats(spark, sf):
    return C.cache_stats(_page_cache(spark, sf))


@query
def cache_names(spark, sf):
    return C.cache_names(pages_of(spark, sf))


@query
def pending_items(spark, sf):
    items = tree.output_paths(tree.flatten_catalog(_site_items(spark, sf)), F.concat(F.lit("out/"), F.col("site")))
    done = _done(spark, sf).withColumnRenamed("source", "url")
    return items.join(done, ["output_path", "url"], "left_anti").select("site", "idx", "url", "output_path")


# ---- trees ---------------------------------------------------------------------------------------------------------------

LEVEL_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_linenumber"]


def _levels(spark, sf) -> DataFrame:
    """Order lines as flat links: the order is the page, the line number the level."""
    return table(spark, sf, "lineitem").select("l_orderkey", *LEVEL_ORDER)


@query
def nested_depth(spark, sf):
    out = tree.nest_depth(_levels(spark, sf), ["l_orderkey"], LEVEL_ORDER, "l_linenumber")
    return longs(out.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "depth", "idx", "dropped"), "depth", "idx")


@query
def nested_parent(spark, sf):
    out = tree.nest_catalog(_levels(spark, sf), ["l_orderkey"], LEVEL_ORDER, "l_linenumber")
    return longs(out.select("l_orderkey", "idx", "parent_idx", "depth"), "idx", "parent_idx", "depth")


@query
def dropped_orphans(spark, sf):
    return tree.dropped_items(_levels(spark, sf), ["l_orderkey"], LEVEL_ORDER, "l_linenumber")


def _world(spark, sf) -> DataFrame:
    """Regions, nations and customers as one catalog, in walking order."""
    region, nation, customer = (table(spark, sf, n) for n in ("region", "nation", "customer"))
    none = F.lit(-1)
    top = region.select(
        F.col("r_regionkey").alias("a"), none.alias("b"), none.cast("bigint").alias("c"), F.lit(1).alias("depth"),
        F.col("r_name").alias("title"),
    )
    middle = nation.select(
        F.col("n_regionkey").alias("a"), F.col("n_nationkey").alias("b"), none.cast("bigint").alias("c"),
        F.lit(2).alias("depth"), F.col("n_name").alias("title"),
    )
    leaf = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_regionkey").alias("a"), F.col("n_nationkey").alias("b"), F.col("c_custkey").alias("c"),
        F.lit(3).alias("depth"), F.col("c_mktsegment").alias("title"),
    )
    rows = top.unionByName(middle).unionByName(leaf).withColumn("site", F.lit("world"))
    indexed = tree.preorder_index(rows, ["site"], ["a", "b", "c"])
    url = F.concat_ws("/", F.lit("http://world"), F.col("a"), F.col("b"), F.col("c"))
    return indexed.select("site", "idx", "depth", "title", url.alias("url"))


@query
def catalog_flatten(spark, sf):
    flat = tree.flatten_catalog(_world(spark, sf))
    out = flat.select("site", "idx", "parent_idx", "depth", "title", "url", tree.path_text().alias("parent_path"), "has_children")
    return longs(out, "depth")


@query
def output_paths(spark, sf):
    return tree.output_paths(tree.flatten_catalog(_world(spark, sf)), "out").select("idx", "output_path")


@query
def path_collisions(spark, sf):
    return tree.path_collisions(tree.output_paths(tree.flatten_catalog(_world(spark, sf)), "out"))


@query
def preview_items(spark, sf):
    return longs(tree.preview_items(_world(spark, sf)), "depth")


def _region_items(spark, sf) -> DataFrame:
    """A catalog per region: its nations, with their customers."""
    nation, customer = table(spark, sf, "nation"), table(spark, sf, "customer")
    top = nation.select(
        F.col("n_regionkey").alias("catalog_id"), F.col("n_nationkey").alias("b"), F.lit(-1).cast("bigint").alias("c"),
        F.lit(1).alias("level"), F.col("n_name").alias("title"),
    )
    leaf = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_regionkey").alias("catalog_id"), F.col("n_nationkey").alias("b"), F.col("c_custkey").alias("c"),
        F.lit(2).alias("level"), F.col("c_name").alias("title"),
    )
    rows = top.unionByName(leaf).withColumn("url", F.concat_ws("/", F.lit("http://world"), F.col("b"), F.col("c")))
    return tree.nest_catalog(rows, ["catalog_id"], ["b", "c"]).select("catalog_id", *TREE_COLUMNS)


def _region_catalogs(spark, sf) -> DataFrame:
    none = F.lit(None).cast("string")
    selectors = F.struct(F.lit("nav a").alias("toc"), F.lit("main").alias("content"), none.alias("toc_type"), none.alias("content_type"))
    return table(spark, sf, "region").select(
        F.col("r_regionkey").alias("catalog_id"),
        F.concat(F.lower("r_name"), F.lit(".example.org:80")).alias("site"),
        F.concat(F.lit("http://"), F.lower("r_name")).alias("url"), selectors.alias("selectors"),
        F.lit(False).alias("ai_generated"), F.lit(0.5).alias("confidence"), F.lit(STAMP).alias("scanned_at"),
    )


@query
def catalog_documents(spark, sf):
    return CAT.catalog_documents(_region_catalogs(spark, sf), _region_items(spark, sf)).select("file", "json")


@query
def catalog_round_trip(spark, sf):
    """Catalogs written as documents and read back."""
    out = scratch_path(spark, "catalogs")
    CAT.write_catalogs(_region_catalogs(spark, sf), _region_items(spark, sf), out)
    _, items = CAT.read_catalogs(spark, out)
    return longs(items.select("site", *TREE_COLUMNS), "idx", "parent_idx", "depth")


#: Levels of a deep catalog, and so many order numbers of one.
DEEP, DEEP_ORDERS = 500, 2000


@query
def deep_catalog(spark, sf):
    """Orders as catalogs in which each is below the one before it, down to level 500: made into documents, read back, flattened."""
    orders = table(spark, sf, "orders").select(
        F.floor(F.col("o_orderkey") / DEEP_ORDERS).cast("string").alias("catalog_id"), F.col("o_orderkey").cast("string").alias("title"),
        F.concat_ws("/", F.lit("http://orders"), "o_orderpriority").alias("url"), "o_orderkey",
    )
    items = tree.preorder_index(orders, ["catalog_id"], ["o_orderkey"]).withColumn("depth", (F.pmod(F.col("idx") - 1, F.lit(DEEP)) + 1).cast("int"))
    none = F.lit(None).cast("string")
    heads = items.groupBy("catalog_id").agg(F.concat(F.lit("orders-"), "catalog_id").alias("site"))
    selectors = F.struct(none.alias("toc"), none.alias("content"), none.alias("toc_type"), none.alias("content_type"))
    catalogs = heads.select("*", F.lit("http://orders").alias("url"), selectors.alias("selectors"), F.lit(False).alias("ai_generated"),
                            F.lit(0.5).alias("confidence"), F.lit(STAMP).alias("scanned_at"))
    documents = CAT.catalog_documents(catalogs, items).select("catalog_id", F.col("json").alias("value"))
    _, back = CAT.catalogs_from_json(documents)
    flat = tree.flatten_catalog(settle(back.select("site", "idx", "depth", "title", "url")))
    above = F.aggregate("parent_path", F.lit(0).cast("bigint"), lambda n, a: n + a["title"].cast("bigint"))
    out = flat.select("site", "idx", "parent_idx", "depth", "title", "url", "has_children", above.alias("orders_above"))
    return longs(out, "idx", "parent_idx", "depth")


@query
def catalog_projection(spark, sf):
    rows = CAT.project_catalogs(_region_catalogs(spark, sf))
    return rows.select("catalog_id", "site", "url", F.col("selectors.toc").alias("toc"), F.col("selectors.content").alias("content"))


# ---- text and address functions ---------------------------------------------------------------------------------------------


def _documents(spark, sf) -> DataFrame:
    return table(spark, sf, "documents")


@query
def word_count(spark, sf):
    return _documents(spark, sf).select("doc_id", T.count_words("text").cast("bigint").alias("words"))


DECORATION = ("本页总览 \n目录\t\n```text\n get_user_id \n```Go\n\n\n\n", " \t\n \n\n\n中文 well-known 　")


@query
def clean_markdown(spark, sf):
    """Documents between a head and a tail that give every cleaning step something to do."""
    head, tail = DECORATION
    text = F.concat(F.lit(head), F.col("text"), F.lit(tail))
    return _documents(spark, sf).select("doc_id", T.clean_markdown(text).alias("cleaned"))


@query
def front_matter(spark, sf):
    docs = _documents(spark, sf)
    words = T.count_words("text").cast("bigint")
    head = T.front_matter(F.split_part("text", F.lit("\n"), F.lit(1)), F.col("source"), F.lit(STAMP), words)
    return docs.select("doc_id", head.alias("header"))


@query
def preview_lines(spark, sf):
    docs = _documents(spark, sf)
    return docs.select("doc_id", T.preview_head("text").alias("head"), T.preview_rest("text").cast("bigint").alias("lines_left"))


@query
def text_sizes(spark, sf):
    docs = _documents(spark, sf)
    return docs.select(
        "doc_id", F.octet_length("text").cast("bigint").alias("bytes"), F.char_length("text").cast("bigint").alias("chars"),
        T.trim_unicode(F.concat(F.lit("　  "), F.col("text"), F.lit("  \n"))).alias("trimmed"),
    )


@query
def safe_names(spark, sf):
    part = table(spark, sf, "part")
    name = F.concat_ws("", F.lit(' <a/b\\c:d*e?"f>|\n'), F.col("p_name"), F.repeat(F.lit(" long"), F.col("p_size")))
    return part.select("p_partkey", T.safe_name(name).alias("name"))


@query
def url_hosts(spark, sf):
    pages = pages_of(spark, sf).select("page_id", "url")
    ported = F.regexp_replace("url", r"^(https?://)([^/]*)", "$1user@$2:8080")
    return pages.select("page_id", U.host("url").alias("host"), U.host(ported).alias("ported"), U.is_http("url").alias("http"))


REFERENCES = ["/für/a b", "../x/./y", "?q=1", "#f", "//other.example/p", "mailto:a@b", "http://h:1/p?q#f", "a%zz"]


@query
def url_resolve(spark, sf):
    pages = pages_of(spark, sf).select("page_id", "url", F.explode(F.array(*[F.lit(r) for r in REFERENCES])).alias("ref"))
    return pages.select("page_id", "ref", U.resolve("url", "ref").alias("resolved"))


# ---- outcomes -------------------------------------------------------------------------------------------------------------------


def _attempts(spark, sf) -> DataFrame:
    events = table(spark, sf, "events")
    return events.select("user_id", "ts", "event_id", F.when(F.col("event_type") == "error", F.col("props")).alias("error"))


def _outcomes(spark, sf) -> DataFrame:
    """Events as results: an error fails, in the class that its time of day names."""
    classes = F.array(*[F.lit(c) for c in O.ERROR_CLASSES], F.lit("unheard"))
    error = F.concat(F.get(classes, F.pmod(F.hour("ts"), F.lit(6))), F.lit(": "), F.col("props"))
    failed = F.col("event_type") == "error"
    return table(spark, sf, "events").select("event_id", "ts", (~failed).alias("success"), F.when(failed, error).alias("error"))


@query
def retry_outcome(spark, sf):
    return O.retry_outcome(_attempts(spark, sf), 3, ["user_id"], ["ts", "event_id"])


@query
def run_totals(spark, sf):
    return O.run_totals(_outcomes(spark, sf)).withColumn("percent", F.round("percent", 6))


@query
def running_progress(spark, sf):
    out = O.running_progress(_outcomes(spark, sf), ["ts", "event_id"])
    return out.select("event_id", "completed", "failed")


@query
def error_breakdown(spark, sf):
    return O.error_breakdown(_outcomes(spark, sf))


@query
def stream_totals(spark, sf):
    """Totals of a stream of events, kept in state and written whenever they change."""
    schema = table(spark, sf, "events").schema
    folder, names = stream_place(spark, f"{sf}/events.parquet")
    events = spark.readStream.schema(schema).option("pathGlobFilter", names).parquet(folder)
    totals = stream_progress(events.select((F.col("event_type") != "error").alias("success")))
    out = scratch_path(spark, "totals")
    writer = totals.writeStream.outputMode("complete").option("checkpointLocation", scratch_path(spark, "totals-state"))
    writer.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(out)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


# ---- model replies -------------------------------------------------------------------------------------------------------------


@query
def reply_payload(spark, sf):
    talk = table(spark, sf, "conversations")
    payload = R.request_payload(F.lit("Answer briefly."), F.col("text"), "m-1", max_tokens=100, temperature=0.5, stream=True)
    return talk.select("conv_id", "turn", payload.alias("payload"))


@query
def analysis_requests(spark, sf):
    requests = R.analysis_requests(pages_of(spark, sf), "m-1", "Name the selectors of navigation and content as JSON.", "The page:\n")
    return requests.select("page_id", F.length("payload").cast("bigint").alias("chars"))


@query
def stream_reply(spark, sf):
    """Conversations as event streams: a turn is a line, a system turn ends it."""
    talk = table(spark, sf, "conversations")
    chunk = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("delta"))).alias("choices")))
    line = (
        F.when(F.col("role") == "user", F.concat(F.lit("  data: "), chunk))
        .when(F.col("role") == "assistant", F.concat(F.lit("event: "), chunk))
        .otherwise("data: {broken")
    )
    lines = talk.select(F.col("conv_id").alias("request_id"), F.col("turn").alias("line_no"), line.alias("line"))
    return R.read_stream(lines)


@query
def sync_reply(spark, sf):
    """Turns as replies: users get an answer, assistants an error, systems a broken body."""
    talk = table(spark, sf, "conversations")
    good = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message"))).alias("choices")))
    bad = F.to_json(F.struct(F.struct(F.lit("busy").alias("message")).alias("error")))
    body = F.when(F.col("role") == "user", good).when(F.col("role") == "assistant", bad).otherwise("{")
    request = F.concat_ws("-", "conv_id", "turn")
    status = F.when(F.col("turn") == 0, 200).when(F.col("turn") == 5, 503).otherwise(200)
    return R.read_replies(talk.select(request.alias("request_id"), status.alias("status"), body.alias("body")))


@query
def analysis_reply(spark, sf):
    """Documents as structure analyses."""
    docs = _documents(spark, sf)
    good = F.to_json(F.struct(F.lit("nav a").alias("toc_selector"), F.lit("main").alias("content_selector"), F.lit(0.5).alias("confidence"), F.col("lang").alias("reasoning")))
    text = F.when(F.col("lang") == "en", F.col("text")).otherwise(good)
    return R.read_analysis(docs.select(F.col("doc_id").alias("request_id"), text.alias("text")))
