"""Column functions over text: trimming, file names, word counts, Markdown clean-up, front matter."""

from __future__ import annotations

from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import constants as K
from quire.functions.bind import let

# --- fixed values: patterns ------------------------------------------------------------------------------
MARKDOWN_MARKS = r"[#*_\[\]()>`~-]"
WORD = r"[\x{4e00}-\x{9fff}]|[^ \t\n\x{4e00}-\x{9fff}]+"
# ASCII word boundaries, spelled out
CLASS_NAME = r"(?<![0-9A-Za-z_])[a-z]++_[a-z][a-z0-9]*+_[a-zA-Z0-9]++(?![0-9A-Za-z_])"
ASCII_SPACE = r"[\t\n\f\r ]"
FENCE = "```" + ASCII_SPACE + r"*(?!(?i:{langs})(?![A-Za-z0-9_]))[a-zA-Z0-9_]+" + ASCII_SPACE + r"*\n"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def replace_all(c: Column | str, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(_col(c), F.lit(pattern), F.lit(replacement))


def trim_unicode(c: Column | str) -> Column:
    """Trim white space of any script; Spark's own ``trim`` knows only U+0020."""
    s = K.UNICODE_SPACE
    return replace_all(c, rf"\A[{s}]++|(?<![{s}])[{s}]++\z", "")


def count_words(c: Column | str) -> Column:
    """Words separated by blanks, tabs and line ends; every CJK ideograph is a word of its own."""
    bare = replace_all(replace_all(c, MARKDOWN_MARKS, ""), r"\n+", " ")
    return F.regexp_count(trim_unicode(bare), F.lit(WORD))


def safe_name(c: Column | str) -> Column:
    """A title as a file name: unsafe characters become ``_``, at most 100 bytes, never empty.

    A letter cut in two by the byte limit becomes U+FFFD. A title of ``.`` or ``..`` becomes ``_`` or
    ``__``, so that it cannot climb out of its folder.
    """
    bad = K.UNSAFE_FILE_CHARACTERS
    limit = K.MAX_FILE_NAME_BYTES

    def shorten(name: Column) -> Column:
        head = F.make_valid_utf8(F.substring(F.encode(name, "UTF-8"), 1, limit).cast("string"))
        return F.when(F.octet_length(name) <= limit, name).otherwise(head)

    def usable(name: Column) -> Column:
        return F.when(name == "", K.UNTITLED_FILE).when(name.isin(".", ".."), F.translate(name, ".", "_")).otherwise(name)

    return let(F.translate(_col(c), bad + "\n\r", "_" * len(bad)), lambda n: let(trim_unicode(shorten(n)), usable))


# ---- Markdown clean-up, one step per function -------------------------------------------------------------


def drop_noise_labels(c: Column | str) -> Column:
    out = _col(c)
    for label in K.NOISE_LABELS:
        out = replace_all(out, label + ASCII_SPACE + "*", "")
    return replace_all(out, K.CONTENTS_LABEL + ASCII_SPACE + r"*\n", "\n")


def drop_class_names(c: Column | str) -> Column:
    return replace_all(c, CLASS_NAME, "")


def keep_known_fences(c: Column | str) -> Column:
    """A fence whose language is not a known one becomes a bare fence."""
    return replace_all(c, FENCE.format(langs="|".join(K.FENCE_LANGUAGES)), "```\n")


def collapse_blank_lines(c: Column | str) -> Column:
    return replace_all(c, r"\n{3,}", "\n\n")


def right_trim_lines(c: Column | str) -> Column:
    return replace_all(c, r"(?<![ \t])[ \t]++(?=\n|\z)", "")


def end_with_newline(c: Column | str) -> Column:
    return F.concat(trim_unicode(c), F.lit("\n"))


def clean_markdown(
    c: Column | str, strip_class_names: bool = True, fence_whitelist: bool = True
) -> Column:
    """All clean-up steps in their order. Blank lines collapse before lines are trimmed."""
    out = drop_noise_labels(c)
    if strip_class_names:
        out = drop_class_names(out)
    if fence_whitelist:
        out = keep_known_fences(out)
    return end_with_newline(right_trim_lines(collapse_blank_lines(out)))


# ---- front matter -------------------------------------------------------------------------------------------


def format_time(c: Column | str) -> Column:
    return F.date_format(_col(c), K.TIME_FORMAT)


def one_line(c: Column | str) -> Column:
    return replace_all(c, r"[\r\n]+", " ")


def front_matter(title: Column, source: Column, fetched_at: Column, word_count: Column) -> Column:
    """The header block. Titles are kept on one line, so none can pose as another field."""
    return F.concat(
        F.lit("---\ntitle: "), one_line(title),
        F.lit("\nsource: "), source,
        F.lit("\nfetched_at: "), fetched_at,
        F.lit("\nword_count: "), word_count.cast("string"),
        F.lit("\n---\n\n"),
    )


def front_matter_source(c: Column | str) -> Column:
    """The ``source`` of a Markdown text; null where there is no closed header block naming one."""
    block = F.regexp_extract(_col(c), r"(?s)\A---\n(.*?)\n---\n", 1)
    lines = F.transform(F.split(block, "\n"), trim_unicode)
    first = F.get(F.filter(lines, lambda line: line.startswith("source:")), F.lit(0))
    value = trim_unicode(F.substr(first, F.lit(len("source:") + 1)))
    return F.nullif(replace_all(value, r"""\A["']+|["']+\z""", ""), F.lit(""))


def preview_head(c: Column | str, lines: int = K.PREVIEW_LINES) -> Column:
    return F.array_join(F.slice(F.split(_col(c), "\n"), 1, lines), "\n")


def preview_rest(c: Column | str, lines: int = K.PREVIEW_LINES) -> Column:
    left = F.greatest(F.size(F.split(_col(c), "\n")) - F.lit(lines), F.lit(0))
    return F.when(_col(c).isNotNull(), left)


# ---- character references -------------------------------------------------------------------------------------


_WINDOWS = {code: text for code in range(0x80, 0xA0) if (text := bytes([code]).decode("cp1252", "ignore"))}


def with_names(body: Callable[[Column], Column]) -> Column:
    """``body`` of the map of named references, for expressions that decode more than one value: the map is a constant made from one
    long text, and stands in the plan once."""
    text = "\1".join(f"&{name}\2{value}" for name, value in html5.items())
    return let(F.str_to_map(F.lit(text), F.lit("\1"), F.lit("\2")), body)


def unescape(c: Column | str, attribute: bool = False, names: Column | None = None) -> Column:
    """Decode character references as HTML 5 does; texts without ``&`` pass untouched.

    Old names are known without a semicolon too, in an attribute only where no letter, digit or ``=`` follows. Numbers may
    have any length; those from 128 to 159 mean Windows-1252, impossible ones become U+FFFD. ``names`` is what ``with_names`` gives.
    """
    if names is None:
        return with_names(lambda names: unescape(c, attribute, names))
    look_up = lambda name: F.try_element_at(names, name)
    old = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))
    ends = "(?![=A-Za-z0-9])" if attribute else ""
    pattern = rf"&#[0-9]++;?|&#[xX][0-9a-fA-F]++;?|&[A-Za-z][A-Za-z0-9]*+;|&(?:{old}){ends}|[^&]++|&"
    windows = F.array(*[F.lit(_WINDOWS.get(code, chr(code))) for code in range(0x80, 0xA0)])

    def char(code: Column) -> Column:
        valid = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        plain = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code).otherwise(F.lit(0xFFFD))), 8, "0")), "UTF-32")
        return F.when(code.between(0x80, 0x9F), F.get(windows, (code - 0x80).cast("int"))).otherwise(plain)

    def number(piece: Column, mark: str, digits: str, base: int) -> Column:
        significant = F.regexp_extract(piece, rf"\A&#{mark}0*({digits}*)", 1)
        short = F.when(F.length(significant) <= 7, significant).otherwise("0")
        return F.coalesce(F.conv(short, base, 10).try_cast("bigint"), F.lit(0))

    def named(piece: Column) -> Column:
        head = F.regexp_extract(piece, rf"\A&(?:{old}){ends}", 0)
        found = look_up(head)
        by_head = F.when(head == "", piece).otherwise(F.concat(found, F.substring(piece, F.length(head) + 1, F.length(piece))))
        return F.coalesce(look_up(piece), by_head)

    def decode(piece: Column) -> Column:
        return (
            F.when(~piece.startswith("&") | (piece == "&"), piece)
            .when(piece == "&amp;", "&")  # by far the most frequent ones, ahead of the long table
            .when(piece == "&lt;", "<")
            .when(piece == "&gt;", ">")
            .when(piece == "&quot;", '"')
            .when(piece == "&nbsp;", "\u00a0")
            .when(piece.rlike(r"\A&#[xX]"), let(number(piece, "[xX]", "[0-9a-fA-F]", 16), char))
            .when(piece.startswith("&#"), let(number(piece, "", "[0-9]", 10), char))
            .otherwise(named(piece))
        )

    def text(t: Column) -> Column:
        pieces = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        return F.when(F.contains(t, F.lit("&")), F.array_join(F.transform(pieces, decode), "")).otherwise(t)

    return let(_col(c), text)
