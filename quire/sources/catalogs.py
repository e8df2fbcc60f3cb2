"""Catalog documents: nested JSON to rows and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.bind import let, then
from quire.functions.urls import site_file
from quire.operators.elements import empty

FIELDS = (
    "site string, url string, selectors struct<toc:string, content:string, toc_type:string, content_type:string>, "
    "ai_generated boolean, confidence double, scanned_at string"
)


def read_catalogs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(catalogs, items)`` of all documents below ``path``.

    Items are tree rows ``(catalog_id, site, idx, parent_idx, depth, title, url)`` in walking order, however
    deep a catalog is.
    """
    texts = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    texts = texts.select(F.md5(F.col("_metadata.file_path")).alias("catalog_id"), "value")
    return catalogs_from_json(texts)


#: A name with its colon, a string, a bracket, or another value.
_TOKEN = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"(?:\s*+:)?|[\[\]{}]|[^\s\[\]{}:,"]++'
_OBJECT, _LIST, _END, _NAME, _VALUE = range(5)
#: Tokens that are walked together: groups of groups of ... FAN.
FAN = 8
CHUNK = FAN**5
_ITEM = "struct<idx:bigint,parent_idx:bigint,depth:int,title:string,url:string>"  # of an item, or of one of its fields


def _plain(json: Column) -> Column:
    """The text of a JSON value."""
    return F.try_variant_get(F.try_parse_json(json), "$", "string")


def _token(raw: Column) -> Column:
    name = F.regexp_extract(raw, r'(?s)\A"(.*)"\s*:\z', 1)
    name = F.when(name.contains("\\"), _plain(F.concat(F.lit('"'), name, F.lit('"')))).otherwise(name)
    kind = F.when(raw == "{", _OBJECT).when(raw == "[", _LIST).when(raw.isin("}", "]"), _END)
    kind = kind.when(raw.startswith('"') & raw.endswith(":"), _NAME).otherwise(_VALUE)
    return let(kind, lambda k: F.struct(k.alias("kind"), F.when(k == _NAME, name).when(k == _VALUE, raw).alias("text")))


def _merge(s: Column, t: Column, say: bool) -> Column:
    """The walk after one more token, and if ``say``, what that token says.

    Items are the objects on the path ``items[].children[]...``; ``depth`` counts open brackets, ``good`` those of them that
    are on that path. So an item's brackets are at odd depths from 3 on.
    """
    on_path, odd = s["good"] == s["depth"], s["depth"] % 2 == 1
    inside = on_path & odd & (s["depth"] >= 3)
    kind, text = t["kind"], t["text"]
    last = F.try_element_at(s["open"], F.lit(-1))

    def state(depth=s["depth"], good=s["good"], name=s["name"], n=s["n"], stack=s["open"], said=s["said"]) -> Column:
        return F.struct(depth.alias("depth"), good.alias("good"), name.alias("name"), n.alias("n"), stack.alias("open"), said.alias("said"))

    def row(idx: Column, parent=None, depth=None, title=None, url=None) -> Column:
        if not say:
            return s["said"]
        return F.array_append(s["said"], F.struct(idx.alias("idx"), *[F.lit(c).alias(k) for k, c in (("parent_idx", parent), ("depth", depth), ("title", title), ("url", url))]).cast(_ITEM))

    deeper, shallower = s["depth"] + 1, s["depth"] - 1
    begins = on_path & ~odd
    item = row(s["n"] + 1, last, (s["depth"] / 2).cast("int"))
    opened = F.when(begins & (s["depth"] >= 2), state(deeper, deeper, n=s["n"] + 1, stack=F.array_append(s["open"], s["n"] + 1), said=item))
    opened = opened.otherwise(state(deeper, F.when(begins, deeper).otherwise(s["good"])))
    lists = on_path & ((s["depth"] == 1) & (s["name"] == "items") | inside & (s["name"] == "children"))
    listed = state(deeper, F.when(lists, deeper).otherwise(s["good"]))
    closed = F.when(inside, state(shallower, shallower, stack=F.slice(s["open"], F.lit(1), F.size(s["open"]) - 1)))
    closed = closed.otherwise(state(shallower, F.least(s["good"], shallower)))
    valued = F.when(inside & (s["name"] == "title"), state(said=row(last, title=text))).when(inside & (s["name"] == "url"), state(said=row(last, url=text))).otherwise(s)
    named = F.when(on_path, state(name=text)).otherwise(s)
    return F.when(kind == _OBJECT, opened).when(kind == _LIST, listed).when(kind == _END, closed).when(kind == _NAME, named).otherwise(valued)


def _chunks(raw: str) -> Column:
    """A document's tokens by ``CHUNK``, each chunk with the state of the walk before it; null if brackets don't match up.

    The states are found by a fold that says nothing. A document of one chunk needs none.
    """
    start = F.struct(
        F.lit(0).alias("depth"), F.lit(0).alias("good"), F.lit(None).cast("string").alias("name"), F.lit(0).cast("bigint").alias("n"),
        empty("bigint").alias("open"), empty(_ITEM).alias("said"),
    )
    level = F.aggregate(raw, F.lit(0), lambda n, t: n + F.when(t.isin("{", "["), 1).when(t.isin("}", "]"), -1).otherwise(0))
    last = F.greatest(F.ceil(F.size(raw) / CHUNK), F.lit(1)).cast("int") - 1
    part = lambda c: F.slice(raw, c * CHUNK + 1, F.lit(CHUNK))

    def after(states: Column, c: Column) -> Column:
        walked = F.aggregate(F.transform(part(c), _token), F.element_at(states, F.lit(-1)), lambda s, t: _merge(s, t, say=False))
        return then(states, walked, F.array_append)

    states = F.when(last > 0, F.aggregate(F.sequence(F.lit(0), F.greatest(last - 1, F.lit(0))), F.array(start), after)).otherwise(F.array(start))
    return F.when(level == 0, F.transform(states, lambda s, c: F.struct(s.alias("state"), part(c).alias("tokens"))))


def _said(state: Column, tokens: Column) -> Column:
    """What is said of a document's items in a chunk, in its order, by folds over its tokens with an explicit stack.

    Every step of a fold copies its state. So the stack holds numbers only, and rows are gathered for ``FAN`` tokens, then for ``FAN``
    such groups, and so on: a row is copied a bounded number of times.
    """

    def walk(s: Column, start: Column, span: int) -> Column:
        if span == FAN:
            return F.aggregate(F.transform(F.slice(tokens, start + 1, F.lit(FAN)), _token), s, lambda s, t: _merge(s, t, say=True))

        def group(s: Column, at: Column) -> Column:
            inner = walk(s.withField("said", empty(_ITEM)), at, span // FAN)
            return then(s, inner, lambda s, w: w.withField("said", F.concat(s["said"], w["said"])))

        end = F.least(start + span, F.greatest(F.size(tokens), F.lit(1))) - 1
        return F.aggregate(F.sequence(start, end, F.lit(span // FAN)), s, group)

    return walk(state, F.lit(0), CHUNK)["said"]


def catalogs_from_json(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``read_catalogs`` for documents that are already in a column ``value``.

    A document is taken apart in its task, chunk after chunk, whatever its depth. One that is not JSON has no fields and no items; what is no object
    in a list of items is no item; of a title that stands twice the last one counts.
    """
    unlimited = {"maxNestingDepth": str((1 << 31) - 1)}  # the reader's own limit is 1000
    catalogs = texts.select("catalog_id", F.from_json("value", FIELDS, unlimited).alias("c")).select("catalog_id", "c.*")
    site = F.from_json("value", "site string", unlimited)["site"].alias("site")
    items = texts.select("catalog_id", site, F.regexp_extract_all("value", F.lit(_TOKEN), F.lit(0)).alias("raw"))
    items = items.select("catalog_id", "site", F.posexplode_outer(_chunks("raw")).alias("chunk", "c")).where(F.col("c").isNotNull())
    said = items.select("catalog_id", "site", "chunk", F.posexplode_outer(_said(F.col("c.state"), F.col("c.tokens"))).alias("at", "i"))
    said = said.where(F.col("i").isNotNull()).select("catalog_id", "site", F.struct("chunk", "at").alias("at"), "i.*")
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(c)
    items = said.groupBy("catalog_id", "site", "idx").agg(F.max("parent_idx").alias("parent_idx"), F.max("depth").alias("depth"), latest("title"), latest("url"))
    return catalogs, items.select("catalog_id", "site", "idx", "parent_idx", "depth", _plain(F.col("title")).alias("title"), _plain(F.col("url")).alias("url"))


def _text(c: str) -> Column:
    return F.regexp_extract(F.to_json(F.struct(F.coalesce(F.col(c), F.lit("")).alias("v"))), r'(?s)\A\{"v":(.*)\}\z', 1)


def nested_items(items: DataFrame, keys: Sequence[str] = ("catalog_id",)) -> DataFrame:
    """Tree rows to one JSON array per catalog, ``(*keys, items)``; ``children`` is left out where there are none.

    Rows are in walking order, so brackets open and close between neighbours: an item with a deeper one behind it opens its
    ``children``, any other closes as many as the next one is less deep. A catalog is one text, so its rows are gathered once.
    """
    row = F.struct("idx", "depth", _text("title").alias("t"), _text("url").alias("u"))
    nested = items.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("rows"))

    def written(r: Column, i: Column) -> Column:
        before, behind = F.when(i > 0, F.get("rows", i - 1)["depth"]), F.get("rows", i + 1)["depth"]
        comma = F.when(before >= r["depth"], ",").otherwise("")
        ends = F.concat(F.lit("}"), F.repeat(F.lit("]}"), r["depth"] - F.coalesce(behind, F.lit(1))))
        return F.concat(comma, F.lit('{"title":'), r["t"], F.lit(',"url":'), r["u"], F.when(behind > r["depth"], ',"children":[').otherwise(ends))

    return nested.select(*keys, F.concat(F.lit("["), F.array_join(F.transform("rows", written), ""), F.lit("]")).alias("items"))


def catalog_documents(catalogs: DataFrame, items: DataFrame, keys: Sequence[str] = ("catalog_id",)) -> DataFrame:
    """``(*keys, file, json)``: every catalog as the document other tools read."""
    nested = nested_items(items, keys)
    rows = catalogs.join(nested, list(keys), "left")
    head = F.to_json(F.struct("site", "url", "selectors"))
    tail = F.to_json(F.struct(F.coalesce("ai_generated", F.lit(False)).alias("ai_generated"), "confidence", "scanned_at"))
    document = F.concat(
        F.regexp_replace(head, r"\}\z", ""), F.lit(',"items":'), F.coalesce("items", F.lit("null")), F.lit(","), F.regexp_replace(tail, r"\A\{", "")
    )
    return rows.select(*keys, site_file("site").alias("file"), document.alias("json"))


def write_catalogs(catalogs: DataFrame, items: DataFrame, path: str, keys: Sequence[str] = ("catalog_id",)) -> None:
    """One folder per document name below ``path``, with the document in it."""
    documents = catalog_documents(catalogs, items, keys)
    documents.select("file", F.col("json").alias("value")).write.partitionBy("file").mode("overwrite").text(path)


def project_catalogs(catalogs: DataFrame) -> DataFrame:
    """The fields a fetch needs."""
    return catalogs.select("catalog_id", "site", "url", "selectors")
