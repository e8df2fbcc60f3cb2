"""HTML as tables: token rows, element intervals, and text or markup of an interval.

Everything here works one page at a time, inside the page's row: tokens and elements are arrays that are folded, not
rows that are sorted. ``clustered`` is for what comes after them, where elements of a page meet in a window.

Rules for markup that is not well-formed
  * void elements never open; comments, scripts and styles are single tokens;
  * what ``textarea``, ``title``, ``noscript``, ``iframe``, ``xmp`` and the like hold is text up to their end tag, be it markup or not;
  * elements pair per tag name. A paragraph ends at the next paragraph or block start, a list item, table
    cell or the like where the next one starts, and any other unclosed element where the element around it
    ends (an unclosed ``<b>`` does not leak into later paragraphs as it does in a browser);
  * inline elements pair inside their own context only;
  * where two pairs overlap, their ends are exchanged, so intervals always nest;
  * an end tag without a start tag is ignored.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import constants as K
from quire.functions.bind import let
from quire.functions.text import unescape, with_names
from quire.operators import elements as E

PAGE = ("page_id",)

# --- fixed values: lexical patterns ------------------------------------------------------------------------
# a quote opens a value right after "=" only; one that is never closed is a character like any other
_REST_OF_TAG = r"""[^>=]*+(?:=\s*+(?:"[^"]*+"|'[^']*+')?+[^>=]*+)*+>"""
_TEXT = r"[^<]*+(?:<(?!/?[a-z]|[!?])[^<]*+)*+"


def _tag(group: int) -> str:
    """A tag; ``group`` is the number of its first group."""
    return (
        r"(?:<!--.*?(?:-->|\z)"
        rf"|<({'|'.join(K.RAW_TEXT_TAGS)})(?=[\s/>]){_REST_OF_TAG}.*?(?:</\{group}\s*>|\z)"
        r"|<[!?][^>]*>"
        rf"|</?[a-z]{_REST_OF_TAG})"
    )


# of an element that holds text only, all up to its end tag is text
TEXT_ELEMENT = rf"<({'|'.join(K.TEXT_TAGS)})(?=[\s/>]){_REST_OF_TAG}[^<]*+(?:<(?!/\1[\s/>])[^<]*+)*+"
TOKEN = rf"(?is)(?:{TEXT_ELEMENT}|{_tag(2)}{_TEXT})"
TAG_ONLY = r"(?is)\A" + _tag(1)
TAG_NAME = r"\A</?([a-zA-Z][^\s/>]*)"
ATTRIBUTE = r"""[^\s"'<>/=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?"""
ATTRIBUTE_NAME = r"\A[^\s=]+"
ATTRIBUTE_VALUE = r"""(?s)\A[^\s=]+\s*=\s*["']?(.*?)["']?\z"""


# ---- tokens -------------------------------------------------------------------------------------------------


def clustered(pages: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """The one exchange: pages spread by their key before they are shredded, while they are smallest."""
    return pages.repartition(*keys)


def spread(pages: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """``pages`` as they are read, unless that leaves cores without work: a table of fewer files than cores is spread by its key."""
    files = pages.inputFiles()
    return clustered(pages, keys) if 0 < len(files) < pages.sparkSession.sparkContext.defaultParallelism else pages


def token_array(html: Column | str = "html") -> Column:
    """A document as an array of tokens: a tag with the text up to the next tag.

    Token 0 is an empty declaration that carries the text before the first tag.
    """
    html = F.col(html) if isinstance(html, str) else html
    return F.regexp_extract_all(F.concat(F.lit("<!>"), F.coalesce(html, F.lit(""))), F.lit(TOKEN), F.lit(0))


def tag_of(token: Column) -> Column:
    return F.regexp_extract(token, TAG_ONLY, 0)


def text_of(token: Column) -> Column:
    """The text behind a token's tag, as written."""
    return F.regexp_replace(token, TAG_ONLY, "")


def name_of(raw: Column) -> Column:
    return F.lower(F.regexp_extract(raw, TAG_NAME, 1))


def kind_of(raw: Column, name: Column) -> Column:
    known = K.INLINE_TAGS + K.BLOCK_TAGS + list(K.OPTIONAL_END_RANK)
    return (
        F.when(raw.startswith("<!") | raw.startswith("<?"), "decl")
        .when(raw.startswith("</"), "close")
        .when(name.isin(K.VOID_TAGS + K.RAW_TEXT_TAGS) | (raw.endswith("/>") & ~name.isin(known)), "void")
        .otherwise("open")
    )


def attribute_list(raw: Column | str = "raw") -> Column:
    """The attributes of a tag as they are written, without the tag name."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    inside = F.regexp_extract(raw, r"(?is)\A<[a-z][^\s/>]*" + "(" + _REST_OF_TAG[:-1] + ")>", 1)
    return F.regexp_extract_all(inside, F.lit(ATTRIBUTE), F.lit(0))


def _attribute_pattern(name: str) -> str:
    this = re.escape(name) + r"(?=[\s=/>])"
    return (
        rf"(?is)\A<[a-z][^\s/>]*+(?:[\s/]++(?!{this}){ATTRIBUTE})*+[\s/]++{this}"
        r"""(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?"""
    )


def attr(name: str, raw: Column | str = "raw", names: Column | None = None) -> Column:
    """Value of an attribute; ``""`` for one without a value, null where it is absent."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    pattern = _attribute_pattern(name)
    value = F.regexp_replace(F.regexp_extract(raw, pattern, 1), r"""(?s)\A(["'])(.*)\1\z""", "$2")
    return F.when(raw.rlike(pattern), unescape(value, True, names))


def attrs(wanted: Sequence[str], raw: Column | str = "raw", names: Column | None = None) -> Column:
    """The values of several attributes, as fields ``a0``, ``a1`` and so on."""
    if names is None:
        return with_names(lambda names: attrs(wanted, raw, names))
    return F.struct(*[attr(n, raw, names).alias(f"a{i}") for i, n in enumerate(wanted)])


def classes(raw: Column | str = "raw") -> Column:
    return F.split(F.coalesce(attr("class", raw), F.lit("")), r"[ \t\n\f\r]+")


def attribute_map(raw: Column | str = "raw", names: Column | None = None) -> Column:
    """All attributes as a map; the first one wins where a name is given twice."""
    if names is None:
        return with_names(lambda names: attribute_map(raw, names))

    def entry(a: Column) -> Column:
        value = F.when(F.contains(a, F.lit("=")), F.regexp_extract(a, ATTRIBUTE_VALUE, 1)).otherwise(F.lit(""))
        return F.struct(F.lower(F.regexp_extract(a, ATTRIBUTE_NAME, 0)).alias("n"), unescape(value, True, names).alias("v"))

    def first_ones(entries: Column) -> Column:
        return F.map_from_entries(F.filter(entries, lambda e, i: F.array_position(F.transform(entries, lambda x: x["n"]), e["n"]) == i + 1))

    return let(F.transform(attribute_list(raw), entry), first_ones)


def exploded(values: Column) -> Column:
    """Rows of an array that takes work to find, and one null row where it is empty: ``explode`` would have Spark find it
    again in a filter of its own."""
    return F.explode_outer(values)


def html_tokens(pages: DataFrame, keys: Sequence[str] = PAGE, with_attributes: bool = True) -> DataFrame:
    """One row per token: ``(*keys, pos, kind, tag, raw, text[, attrs, classes])``."""
    tokens = pages.select(*keys, F.posexplode(token_array()).alias("pos", "token"))
    tokens = tokens.select(*keys, "pos", tag_of(F.col("token")).alias("raw"), text_of(F.col("token")).alias("text"))
    tokens = tokens.withColumn("tag", name_of(F.col("raw")))
    tokens = tokens.select(*keys, "pos", kind_of(F.col("raw"), F.col("tag")).alias("kind"), "tag", "raw", "text")
    if with_attributes:
        tokens = tokens.withColumns({"attrs": attribute_map(), "classes": classes()})
    return tokens


# ---- elements -------------------------------------------------------------------------------------------------


def element_array(tokens: Column) -> Column:
    """All elements of a document in the order of their start tags, from its ``token_array``:
    ``array<struct<start_pos, end_pos, parent_pos, depth, tag, raw, void>>``.

    An element covers the tokens ``start_pos <= pos < end_pos``; the text behind its start tag is inside, the
    text behind its end tag is not.
    """

    def of(tags: Column) -> Column:
        def element(e: Column) -> Column:
            own = F.get(tags, e["start_pos"])
            places = [e[c].alias(c) for c in ("start_pos", "end_pos", "parent_pos", "depth")]
            return F.struct(*places, own["tag"].alias("tag"), own["raw"].alias("raw"), (own["role"] == E.VOID).alias("void"))

        return F.transform(E.spans(tags, F.size(tags)), element)

    return let(E.heads(F.transform(tokens, tag_of), name_of, kind_of), of)


def shredded(pages: DataFrame, keys: Sequence[str] = PAGE, *columns: str) -> DataFrame:
    """A row per page with its tokens and elements: ``(*keys, *columns, tokens, elements)``."""
    rows = pages.select(*keys, *columns, token_array().alias("tokens"))
    return rows.select(*keys, *columns, "tokens", element_array(F.col("tokens")).alias("elements"))


def html_nodes(
    pages: DataFrame, keys: Sequence[str] = PAGE, parents: bool = False, carry: Sequence[str] = ()
) -> DataFrame:
    """One row per element: ``(*keys, start_pos, end_pos[, parent_pos], depth, tag, raw, void, n_tokens)``.

    ``carry`` names page columns to be kept on every row.
    """
    found = let(token_array(), lambda tokens: F.struct(F.size(tokens).alias("n"), element_array(tokens).alias("elements")))
    rows = pages.select(*keys, *carry, found.alias("_f")).select(*keys, *carry, F.col("_f.n").alias("n_tokens"), exploded(F.col("_f.elements")).alias("_e"))
    rows = rows.where(F.col("_e").isNotNull())
    places = ["start_pos", "end_pos", *(["parent_pos"] if parents else []), "depth", "tag", "raw", "void"]
    return rows.select(*keys, *[F.col(f"_e.{c}").alias(c) for c in places], "n_tokens", *carry)


# ---- text and markup of an interval, inside a row that holds its page's tokens ------------------------------


def inner_html(tokens: Column, start: Column, end: Column) -> Column:
    """Markup between the start tag at ``start`` and the token that ends the element."""
    rest = F.array_join(F.slice(tokens, start + 2, F.greatest(end - start - 1, F.lit(0))), "")
    return F.concat(text_of(F.get(tokens, start)), rest)


def inner_text(tokens: Column, start: Column, end: Column, names: Column | None = None) -> Column:
    """Text of an element with its descendants, character references decoded."""
    inside = F.slice(tokens, start + 1, F.greatest(end - start, F.lit(0)))
    return unescape(F.array_join(F.transform(inside, text_of), ""), names=names)
