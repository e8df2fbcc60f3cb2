"""HTML to Markdown by folds over the events of a page.

Every start tag, end tag and piece of text of a page is an event. A first fold knows what is open around it (is it inside
something removed, inside ``pre``, how deep in lists and quotes) and keeps what can be seen; a second one finds marks around
nothing; a third one joins the pieces with the breaks that are due between them. All of it happens inside the page's row, so a page
is neither sorted nor moved.

Own rendering rules: headings ``#``, ``**strong**``, ``_emphasis_``, `` `code` ``, fences without a language,
``-`` and ``1.`` list items, ``> `` quotes, ``[text](target)``, ``![alt](source)``, ``* * *``. White space is
collapsed outside ``pre``. Cells of a table stand in a line, separated by a blank, or by ``|`` with
``tables="pipe"``.

Outside ``pre`` and ``code``, a backslash stands before the characters of text that Markdown would read as marks:
``\\ * _ ` [ ]`` anywhere, ``|`` with ``tables="pipe"``, and at the beginning of a line ``#``, ``>``, ``~~~``, a ``+``, ``-`` or ``=`` that could be a
bullet or a rule, and the dot or bracket of a number. Titles, addresses and descriptions of images are left as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import constants as K
from quire.functions.bind import let, then
from quire.functions.text import clean_markdown, count_words, format_time, front_matter, trim_unicode, unescape, with_names
from quire.operators.elements import empty, pile, piled, unpiled
from quire.operators.html import PAGE, attr, attribute_list, inner_html, inner_text, name_of, shredded, tag_of, text_of
from quire.operators.selectors import UNSUPPORTED, compiled, first_span, hits, parse

BODY = ("body", "css")

# --- fixed values: Markdown marks --------------------------------------------------------------------------
STRONG, EMPHASIS, CODE, FENCE, BULLET, RULE, QUOTE = "**", "_", "`", "```", "- ", "* * *", "> "
INLINE_MARKS = {"strong": STRONG, "b": STRONG, "em": EMPHASIS, "i": EMPHASIS, "code": CODE}
LINE_TAGS = ["li", "tr", "dt", "dd", "br", "option"]
CELL_TAGS = ["td", "th"]
HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
HEAD_TAGS = ["head", "title"]  # not part of a body
SPACED_TAGS = [t for t in K.BLOCK_TAGS if t not in ("html", "body", "thead", "tbody", "tfoot")] + ["p", "hr"]


# ---- cleaning -------------------------------------------------------------------------------------------------


def strip_attributes(raw: Column, names: Sequence[str] = tuple(K.STRIPPED_ATTRIBUTES)) -> Column:
    """A tag without some of its attributes. ``data-*`` is a literal name, not a pattern."""
    kept = F.filter(attribute_list(raw), lambda a: ~F.lower(F.regexp_extract(a, r"\A[^\s=]+", 0)).isin(list(names)))
    rebuilt = F.concat(
        F.lit("<"), F.regexp_extract(raw, r"\A<([a-zA-Z][^\s/>]*)", 1), F.array_join(F.transform(kept, lambda a: F.concat(F.lit(" "), a)), ""), F.lit(">")
    )
    return F.when(raw.rlike(r"(?is)\A<[a-z][^\s/>]*[\s/]+[^\s/>]") & ~name_of(raw).isin(K.RAW_TEXT_TAGS), rebuilt).otherwise(raw)


def _prune_selectors(prune_ads: bool) -> list[tuple[str, str]]:
    ads = [f".{c}" for c in K.AD_CLASSES] if prune_ads else []
    return [(s, "css") for s in [*K.PRUNED_TAGS, *HEAD_TAGS, *ads]]


def cuts(elements: Column, prune_ads: bool = False) -> Column:
    """Intervals that cleaning removes, those inside another left out: ``array<struct<start_pos, end_pos, void, tag>>``.

    Advertisement classes are only looked at with ``prune_ads``: by default attributes are stripped first.
    """
    kind = "struct<start_pos:int,end_pos:int,void:boolean,tag:string>"
    start = F.struct(F.lit(0).alias("end"), pile(kind))

    def merge(s: Column, h: Column) -> Column:
        outer = h["start_pos"] >= s["end"]
        cut = F.struct(*[h[c].alias(c) for c in ("start_pos", "end_pos", "void", "tag")])
        out = F.when(outer, F.array(cut)).otherwise(empty(kind))
        return then(s, out, lambda s, out: F.struct(F.when(outer, h["end_pos"]).otherwise(s["end"]).alias("end"), piled(s, out)))

    return F.aggregate(hits(elements, _prune_selectors(prune_ads)), start, merge, unpiled)


def clean_html(pages: DataFrame, keys: Sequence[str] = PAGE, prune_ads: bool = False) -> DataFrame:
    """Markup without the stripped attributes and the removed elements: ``(*keys, html)``.

    What stays of a page are the stretches of tokens between one cut and the next, so tokens and cuts are walked once.
    """
    rows = shredded(pages, keys)
    tokens = F.col("tokens")

    def shown(token: Column) -> Column:
        def of(tag: Column) -> Column:
            text = F.substr(token, F.length(tag) + 1)
            return F.when(tag == "<!>", text).otherwise(F.concat(strip_attributes(tag), text))

        return let(tag_of(token), of)

    def stretch(gone: Column, i: Column) -> Column:
        before = F.get(gone, i - 1)
        begin = F.when(i == 0, 0).when(before["void"], before["start_pos"]).otherwise(before["end_pos"])
        end = F.coalesce(F.get(gone, i)["start_pos"], F.size(tokens))
        first = F.get(tokens, begin)
        # of the end tag of what is gone, and of a tag that is gone by itself, the text behind stays
        bare = (i > 0) & (before["void"] | F.lower(first).startswith(F.concat(F.lit("</"), before["tag"])))
        head = F.when(bare, text_of(first)).otherwise(shown(first))
        rest = F.transform(F.slice(tokens, begin + 2, F.greatest(end - begin - 1, F.lit(0))), shown)
        own = F.when(F.coalesce(before["void"], F.lit(False)), F.greatest(end, begin + 1)).otherwise(end)
        return F.when(begin < own, F.concat(head, F.array_join(rest, ""))).otherwise("")

    def joined(gone: Column) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(gone)), lambda i: stretch(gone, i)), "")

    return rows.select(*keys, let(cuts(F.col("elements"), prune_ads), joined).alias("html"))


# ---- content of a page ------------------------------------------------------------------------------------------


def normal_selector(selector: Column, kind: Column) -> Column:
    """``(selector, type)`` with defaults filled in: no type is css, no selector or ``body`` is css ``body``."""
    whole = F.coalesce(selector, F.lit("")).isin("", "body")
    return F.struct(
        F.when(whole, "body").otherwise(selector).alias("selector"),
        F.when(whole, "css").otherwise(F.coalesce(F.nullif(kind, F.lit("")), F.lit("css"))).alias("type"),
    )


def _first(pages: DataFrame, selector: tuple[str, str], keys: Sequence[str]) -> DataFrame:
    rows = shredded(pages, keys)
    return rows.select(*keys, "tokens", F.get(hits(F.col("elements"), [selector]), F.lit(0)).alias("hit"))


def extract_content(pages: DataFrame, selector: str = "", kind: str = "", keys: Sequence[str] = PAGE) -> DataFrame:
    """Markup inside the first match of a selector: ``(*keys, content)``, ``""`` where nothing matches."""
    wanted = BODY if selector in ("", "body") else (selector, kind or "css")
    content = inner_html(F.col("tokens"), F.col("hit.start_pos"), F.col("hit.end_pos"))
    return _first(pages, wanted, keys).select(*keys, F.coalesce(content, F.lit("")).alias("content"))


def extract_text(pages: DataFrame, selector: str, kind: str = "css", keys: Sequence[str] = PAGE) -> DataFrame:
    """Text of the first match of a selector with all its descendants: ``(*keys, text)``, null without a match."""
    text = inner_text(F.col("tokens"), F.col("hit.start_pos"), F.col("hit.end_pos"))
    return _first(pages, (selector, kind), keys).select(*keys, F.when(F.col("hit").isNotNull(), text).alias("text"))


# ---- events -------------------------------------------------------------------------------------------------------


def _events(tokens: Column, elements: Column, start: Column, end: Column) -> Column:
    """Start, end and text events, in order, of the tokens from ``start`` to before ``end``.

    An element's own tags stay outside, the text behind its start tag is inside.
    """

    def event(pos: Column, phase: int, turn: Column, name: Column, of: Column | None = None, text: Column | None = None) -> Column:
        none = F.lit(None).cast("string")
        tag, raw = (of["tag"], of["raw"]) if of is not None else (none, none)
        fields = [pos, F.lit(phase), turn, name, tag, raw, none if text is None else text]
        return F.struct(*[c.alias(n) for c, n in zip(fields, ("pos", "phase", "turn", "ev", "tag", "raw", "text"))])

    texts = F.transform(F.slice(tokens, start + 1, F.greatest(end - start, F.lit(0))), lambda t, i: event(start + i, 2, F.lit(0), F.lit("text"), None, text_of(t)))
    inside = F.filter(elements, lambda e: (e["start_pos"] > start) & (e["start_pos"] < end))
    opens = F.transform(inside, lambda e: event(e["start_pos"], 1, F.lit(0), F.when(e["void"], "void").otherwise("open"), e))
    stops = F.transform(F.filter(inside, lambda e: ~e["void"]), lambda e: event(e["end_pos"], 0, -e["start_pos"], F.lit("close"), e))
    return F.sort_array(F.concat(F.filter(texts, lambda t: t["text"] != ""), opens, stops))


def escape_text(text: Column, tables: str = "text") -> Column:
    """Text with a backslash before what could be a mark anywhere in a line."""
    return F.regexp_replace(text, r"([\\*_`\[\]|])" if tables == "pipe" else r"([\\*_`\[\]])", r"\\$1")


def escape_line(text: Column) -> Column:
    """The beginning of a line with a backslash before what could be a mark there."""
    marked = F.regexp_replace(text, r"\A(#|>|~(?=~~)|[+=-](?=[ =-]|\z))", r"\\$1")
    return F.regexp_replace(marked, r"\A([0-9]{1,9})([.)])(?= |\z)", r"$1\\$2")


#: An event that shows, or breaks a line: ``kind`` is B a boundary, M a mark that takes the break before it, S one that text follows at once,
#: E the end of a mark, F that of a fence, C a cell, T text.
_ITEM = "struct<kind:string,level:int,br:boolean,own:int,ev:string,heading:boolean,rule:boolean,mark:string,pre:boolean,code:boolean,quote:int,indent:int>"


def _items(events: Column, tables: str, prune_ads: bool, names: Column) -> Column:
    """The events that show or break lines, outside what cleaning removes."""
    start = F.struct(
        *[F.lit(0).alias(c) for c in ("cuts", "pre", "code", "quote", "indent")], empty("struct<kind:string,items:int>").alias("lists"),
        pile(_ITEM),
    )

    def merge(s: Column, x: Column) -> Column:
        ev, tag, raw = x["ev"], x["tag"], x["raw"]
        opens, closes, is_list = ev == "open", ev == "close", tag.isin("ul", "ol")
        step = F.when(opens, 1).when(closes, -1).otherwise(0)
        cut = F.coalesce(tag.isin(K.PRUNED_TAGS + HEAD_TAGS), F.lit(False))
        if prune_ads:
            cut = cut | F.coalesce(attr("class", raw, names).rlike(rf"(?:\A|\s)(?:{'|'.join(K.AD_CLASSES)})(?:\s|\z)"), F.lit(False))

        def counted(cut: Column) -> Column:
            now = {c: s[c] + F.when(F.coalesce(test, F.lit(False)), step).otherwise(0) for c, test in (("cuts", cut), ("pre", tag == "pre"), ("code", tag == "code"), ("quote", tag == "blockquote"))}
            now["indent"] = s["indent"] + F.when(tag == "ul", step * 2).when(tag == "ol", step * 3).otherwise(0)
            top = F.when(F.size(s["lists"]) > 0, F.get(s["lists"], F.size(s["lists"]) - 1))
            numbered = F.struct(top["kind"].alias("kind"), (top["items"] + 1).alias("items"))
            lists = (
                F.when(opens & is_list, F.array_append(s["lists"], F.struct(tag.alias("kind"), F.lit(0).alias("items"))))
                .when(closes & is_list, F.slice(s["lists"], F.lit(1), F.greatest(F.size(s["lists"]) - 1, F.lit(0))))
                .when(opens & (tag == "li") & top.isNotNull(), F.array_append(F.slice(s["lists"], F.lit(1), F.size(s["lists"]) - 1), numbered))
                .otherwise(s["lists"])
            )
            gone = cut | (now["cuts"] > 0)
            return let(F.struct(*[c.alias(n) for n, c in now.items()], lists.alias("lists"), gone.alias("gone")), with_kind)

        def with_kind(now: Column) -> Column:
            depth = F.size(now["lists"])
            marked = tag.isin([*INLINE_MARKS, "a"]) & ~((tag == "code") & (now["pre"] > 0))
            heading = F.coalesce(tag.isin(HEADINGS), F.lit(False))
            kind = (
                F.when(ev == "text", "T")
                .when(opens & marked, "M")
                .when(closes & marked, "E")
                .when((ev == "void") & tag.isin("img", "hr"), "M")
                .when(opens & (heading | tag.isin("li", "pre")), "S")
                .when(closes & (tag == "pre"), "F")
                .when(opens & tag.isin(CELL_TAGS), "C")
                .when(tag.isin(SPACED_TAGS + LINE_TAGS), "B")
            )
            top = F.when(depth > 0, F.get(now["lists"], depth - 1))
            known = F.struct(F.when(~now["gone"], kind).alias("kind"), heading.alias("heading"), top.alias("top"), (now["pre"] > 0).alias("pre"), (now["code"] > 0).alias("code"))
            item = let(known, lambda k: F.when(k["kind"].isNotNull(), F.array(shown(now, k))).otherwise(empty(_ITEM)))
            return F.struct(now.alias("now"), item.alias("item"))

        def shown(now: Column, k: Column) -> Column:
            depth, top, kind = F.size(now["lists"]), k["top"], k["kind"]
            level = (
                F.when(ev == "text", 0)
                .when(is_list & (depth - F.when(opens, 1).otherwise(0) > 0), 1)
                .when(tag.isin(SPACED_TAGS), 2)
                .when(tag.isin(LINE_TAGS), 1)
                .otherwise(0)
            )
            plain = unescape(F.when(k["pre"], x["text"]).otherwise(F.regexp_replace(x["text"], r"[ \t\n\r\f]+", " ")), names=names)
            attribute = lambda name: F.coalesce(attr(name, raw, names), F.lit(""))
            is_li = opens & (tag == "li")
            mark = (
                F.when(ev == "text", let(plain, lambda p: F.when(k["pre"] | k["code"], p).otherwise(escape_text(p, tables))))
                .when((ev == "void") & (tag == "img"), F.concat(F.lit("!["), attribute("alt"), F.lit("]("), attribute("src"), F.lit(")")))
                .when((ev == "void") & (tag == "hr"), RULE)
                .when(kind == "C", "")
                .when(opens & k["heading"], F.concat(F.repeat(F.lit("#"), F.substr(tag, F.lit(2)).try_cast("int")), F.lit(" ")))
                .when(is_li, F.when(top["kind"] == "ol", F.concat(top["items"].cast("string"), F.lit(". "))).otherwise(BULLET))
                .when(opens & (tag == "pre"), FENCE + "\n")
                .when(closes & (tag == "pre"), "\n" + FENCE)
                .when(opens & (tag == "a"), "[")
                .when(closes & (tag == "a"), F.concat(F.lit("]("), attribute("href"), F.lit(")")))
                .when(tag.isin("strong", "b"), STRONG)
                .when(tag.isin("em", "i"), EMPHASIS)
                .when(tag == "code", CODE)
            )
            width = F.when(top["kind"] == "ol", 3).otherwise(2)
            return F.struct(
                kind.alias("kind"), level.alias("level"), ((ev == "void") & (tag == "br")).alias("br"), F.when(closes, -x["turn"]).otherwise(x["pos"]).alias("own"),
                ev.alias("ev"), k["heading"].alias("heading"), (tag == "hr").alias("rule"), mark.alias("mark"), k["pre"].alias("pre"), k["code"].alias("code"),
                now["quote"].alias("quote"), F.greatest(now["indent"] - F.when(is_li, width).otherwise(0), F.lit(0)).alias("indent"),
            )

        names_of_state = ("cuts", "pre", "code", "quote", "indent", "lists")
        return then(s, let(cut, counted), lambda s, x: F.struct(*[x["now"][c].alias(c) for c in names_of_state], piled(s, x["item"])))

    return F.aggregate(events, start, merge, unpiled)


def _solid(items: Column) -> Column:
    """``(i, blank, solid)`` of each item: a blank beside an edge is dropped, and solid ones take the break before them."""
    edges = ["B", "S", "F", "C"]
    edge = lambda i: F.coalesce(F.get(items, i)["kind"], F.lit("B")).isin(edges)

    def flags(x: Column, i: Column) -> Column:
        blank = (x["ev"] == "text") & (x["mark"] == " ") & (edge(i - 1) | edge(i + 1))
        return let(blank, lambda blank: F.struct(x.alias("x"), blank.alias("blank"), (~blank & x["kind"].isin("T", "M", "S", "C")).alias("solid")))

    return F.transform(items, flags)


def _hollow(items: Column) -> Column:
    """Start positions of inline elements and headings around nothing, which leave no marks."""
    kind = "struct<own:int,words:int>"
    start = F.struct(empty(kind).alias("open"), F.lit(0).alias("words"), empty("int").alias("found"))

    def merge(s: Column, f: Column) -> Column:
        x = f["x"]
        word = f["solid"] & x["ev"].isin("text", "void")
        takes = x["kind"].isin("M", "E") | x["heading"]
        last = F.get(s["open"], F.size(s["open"]) - 1)
        opened = F.when(takes & (x["ev"] == "open"), F.array_append(s["open"], F.struct(x["own"].alias("own"), s["words"].alias("words"))))
        opened = opened.when(takes & (x["ev"] == "close"), F.slice(s["open"], F.lit(1), F.greatest(F.size(s["open"]) - 1, F.lit(0)))).otherwise(s["open"])
        nothing = F.coalesce(takes & (x["ev"] == "close") & (last["words"] == s["words"]), F.lit(False))
        found = F.when(nothing, F.array_append(s["found"], x["own"])).otherwise(s["found"])
        return F.struct(opened.alias("open"), (s["words"] + F.when(word, 1).otherwise(0)).alias("words"), found.alias("found"))

    return F.aggregate(items, start, merge, lambda s: s["found"])


def _joined(items: Column, hollow: Column, tables: str) -> Column:
    """The pieces with the breaks that are due between them, as one text."""
    start = F.struct(
        F.lit(0).alias("level"), F.lit(0).alias("brs"), F.lit(True).alias("first"), F.lit(False).alias("after"), F.lit(False).alias("ruled"), F.lit(0).alias("quoted"),
        pile("string"),
    )

    def merge(s: Column, f: Column) -> Column:
        x = f["x"]
        bare = (x["kind"].isin("M", "E") | (x["heading"] & (x["ev"] == "open"))) & (x["ev"] != "void") & F.array_contains(hollow, x["own"])

        def of(bare: Column) -> Column:
            level, brs = F.greatest(s["level"], x["level"]), s["brs"] + F.when(x["br"], 1).otherwise(0)
            breaks = F.when(s["ruled"], 2).otherwise(F.least(F.lit(2), F.greatest(level, brs)))
            fields = [(f["solid"] & ~bare).alias("solid"), level.alias("level"), brs.alias("brs"), F.when(s["after"], 0).otherwise(breaks).alias("breaks")]
            return let(F.struct(*fields, bare.alias("bare")), with_piece)

        def with_piece(now: Column) -> Column:
            margin = F.concat(F.repeat(F.lit(QUOTE), x["quote"]), F.repeat(F.lit(" "), x["indent"]))
            between = F.rtrim(F.repeat(F.lit(QUOTE), F.least(x["quote"], s["quoted"])))
            lead_in = (
                F.when(s["first"], margin)
                .when(now["breaks"] == 0, F.when(x["kind"] == "C", F.lit(" | " if tables == "pipe" else " ")).otherwise(""))
                .when(now["breaks"] == 1, F.concat(F.lit("\n"), margin))
                .otherwise(F.concat(F.lit("\n"), between, F.lit("\n"), margin))
            )
            begins = s["first"] | (now["breaks"] > 0) | s["after"]
            own = F.when((x["ev"] == "text") & begins & ~x["pre"], F.when(x["code"], F.ltrim(x["mark"])).otherwise(escape_line(F.ltrim(x["mark"])))).otherwise(x["mark"])
            piece = F.when(now["solid"], F.array(F.concat(lead_in, own))).when(x["kind"].isin("E", "F") & ~now["bare"], F.array(x["mark"])).otherwise(empty("string"))
            return F.struct(now["solid"].alias("solid"), now["level"].alias("level"), now["brs"].alias("brs"), piece.alias("piece"))

        def step(s: Column, now: Column) -> Column:
            solid = now["solid"]
            return F.struct(
                F.when(solid, 0).otherwise(now["level"]).alias("level"), F.when(solid, 0).otherwise(now["brs"]).alias("brs"), (s["first"] & ~solid).alias("first"),
                F.when(solid, x["kind"] == "S").otherwise(s["after"]).alias("after"), F.when(solid, F.coalesce(x["rule"], F.lit(False))).otherwise(s["ruled"]).alias("ruled"),
                F.when(solid, x["quote"]).otherwise(s["quoted"]).alias("quoted"), piled(s, now["piece"]),
            )

        return then(s, let(F.coalesce(bare, F.lit(False)), of), step)

    return F.array_join(F.aggregate(items, start, merge, unpiled), "")


def _title(tokens: Column, elements: Column, start: Column, end: Column, names: Column) -> Column:
    """Text of the first ``h1``, else of the first ``title``, up to the next one."""

    def first(tag: str) -> Column:
        found = F.filter(elements, lambda e: (e["tag"] == tag) & (e["start_pos"] > start) & (e["start_pos"] < end))
        return let(found, lambda f: inner_text(tokens, F.get(f, F.lit(0))["start_pos"], F.least(F.get(f, F.lit(0))["end_pos"], F.get(f, F.lit(1))["start_pos"]), names))

    def of(x: Column) -> Column:
        return F.when(x["h1"] != "", trim_unicode(x["h1"])).when(x["title"] != "", trim_unicode(x["title"])).otherwise(K.UNTITLED_DOCUMENT)

    return let(F.struct(first("h1").alias("h1"), first("title").alias("title")), of)


def rendered(tokens: Column, elements: Column, start: Column, end: Column, tables: str = "text", prune_ads: bool = False) -> Column:
    """``(matched, title, markdown)`` of the tokens from ``start`` to before ``end``."""

    def of(names: Column) -> Column:
        def on(events: Column) -> Column:
            flags = let(_items(events, tables, prune_ads, names), _solid)
            text = let(flags, lambda f: let(_hollow(f), lambda h: _joined(f, h, tables)))
            return F.struct((F.size(events) > 0).alias("matched"), _title(tokens, elements, start, end, names).alias("title"), text.alias("markdown"))

        return let(_events(tokens, elements, start, end), on)

    return with_names(of)


def _records(rows: DataFrame, keys: list[str], fetched_at: Column | str | None, include_meta: bool, tables: str, prune_ads: bool,
             strip_class_names: bool, fence_whitelist: bool, carry: Sequence[str], whole: bool = False) -> DataFrame:
    """Records of rows ``(*keys, url, tokens, elements, span, bad, *carry)``; without a ``span`` there is no content.
    A ``whole`` page has a record, be it empty."""
    if tables not in ("text", "pipe"):
        raise ValueError("tables must be 'text' or 'pipe'")
    now = F.lit(fetched_at).cast("timestamp") if isinstance(fetched_at, str) else fetched_at
    stamp = format_time(F.current_timestamp() if now is None else now)

    def record(r: Column) -> Column:
        def of(body: Column, words: Column) -> Column:
            content = F.concat(front_matter(r["title"], F.col("url"), stamp, words), body) if include_meta else body
            return F.struct(r["title"].alias("title"), content.alias("content"), body.alias("body"), words.alias("word_count"))

        done = let(clean_markdown(r["markdown"], strip_class_names, fence_whitelist), lambda body: let(count_words(body).cast("bigint"), lambda words: of(body, words)))
        return F.when(F.lit(True) if whole else r["matched"], done)

    done = let(rendered(F.col("tokens"), F.col("elements"), F.col("span.start_pos"), F.col("span.end_pos"), tables, prune_ads), record)
    found = rows.select(*keys, "url", *carry, "bad", F.when(F.col("span").isNotNull(), done).alias("_r"))
    return found.select(
        *keys, "url", *[F.col(f"_r.{c}").alias(c) for c in ("title", "content", "body", "word_count")],
        F.when(F.col("bad"), UNSUPPORTED).when(F.col("_r").isNull(), "content_not_found").alias("error"),
        *carry,
    )


def convert_wanted(
    work: DataFrame,
    keys: Sequence[str] = PAGE,
    fetched_at: Column | str | None = None,
    include_meta: bool = True,
    tables: str = "text",
    prune_ads: bool = False,
    strip_class_names: bool = True,
    fence_whitelist: bool = True,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Pages to Markdown records, one for each of a page's selectors: ``(*keys, selector, type, url, title, content, body,
    word_count, error, *carry)``.

    ``work`` holds ``(*keys, url, html, wants)``, ``wants`` being an array of ``(selector, type)`` as ``normal_selector`` makes them. The
    content is the first match; ``content`` is ``body`` with front matter; words are those of ``body``. A selector that matches
    nothing, or something empty, has ``error = 'content_not_found'``, one outside the grammar ``'parse: unsupported selector'``. A page is taken
    apart once, however many selectors it has.
    """
    keys = list(keys)
    rows = shredded(work, keys, "url", "wants", *carry)

    def span(w: Column) -> Column:
        steps = compiled(w["selector"], w["type"])
        return let(steps, lambda steps: F.struct(w["selector"].alias("selector"), w["type"].alias("type"), steps.isNull().alias("bad"), first_span(F.col("elements"), steps).alias("span")))

    found = rows.select(*keys, "url", *carry, "tokens", "elements", F.explode_outer(F.transform("wants", span)).alias("_w")).where(F.col("_w").isNotNull())
    found = found.select(*keys, "_w.selector", "_w.type", "url", *carry, "tokens", "elements", "_w.bad", "_w.span")
    return _records(found, [*keys, "selector", "type"], fetched_at, include_meta, tables, prune_ads, strip_class_names, fence_whitelist, carry)


def convert(
    work: DataFrame,
    selectors: Sequence[tuple[str, str]] = (),
    keys: Sequence[str] = PAGE,
    fetched_at: Column | str | None = None,
    include_meta: bool = True,
    tables: str = "text",
    prune_ads: bool = False,
    strip_class_names: bool = True,
    fence_whitelist: bool = True,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Pages to Markdown records ``(*keys, url, title, content, body, word_count, error, *carry)``.

    ``work`` holds ``(*keys, url, html)`` and, where ``selectors`` are given, ``want``: the index of the one
    whose first match is the content. Without selectors the whole ``html`` is. The rest is as in ``convert_wanted``.
    """
    keys = list(keys)
    rows = shredded(work, keys, "url", *(["want"] if selectors and "want" not in [*keys, *carry] else []), *carry)
    if selectors:
        for selector in selectors:
            parse(*selector)
        found = hits(F.col("elements"), selectors)
        hit = let(found, lambda f: F.get(F.filter(f, lambda h: F.array_contains(h["hits"], F.col("want"))), F.lit(0)))
        span = let(hit, lambda h: F.when(h.isNotNull(), F.struct(h["start_pos"].alias("start_pos"), h["end_pos"].alias("end_pos"))))
    else:
        span = F.struct(F.lit(0).alias("start_pos"), F.size("tokens").alias("end_pos"))
    rows = rows.select(*keys, "url", *carry, "tokens", "elements", F.lit(False).alias("bad"), span.alias("span"))
    return _records(rows, keys, fetched_at, include_meta, tables, prune_ads, strip_class_names, fence_whitelist, carry, not selectors)


def process(fragments: DataFrame, keys: Sequence[str] = PAGE, **options) -> DataFrame:
    """Markup fragments ``(*keys, url, html)`` to Markdown records; the title is that of the fragment."""
    return convert(fragments, (), keys, **options)
