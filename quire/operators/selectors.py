"""CSS selectors and a small part of XPath over the elements of a page, inside its row.

A selector is a chain of steps; each step is a test of one element, and hangs on an element around it that passed the step
before. Elements are folded in document order. The fold keeps, for every open element, which steps it passes and which ones it or an
element around it passes, so no element is joined with its ancestors and a page is read once for all selectors.

Selectors come in two forms. A list known to the program is parsed on the driver and its tests become columns; the steps
an element passes are bits of a number (``hits``). Selectors that are data, such as one per site, are taken apart by column
expressions in their own rows (``compiled``), and each page is tested against its own (``first_span``): there may be any
number of them, and one that is outside the grammar has an error in its row.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.bind import let, then
from quire.functions.text import with_names
from quire.operators.elements import empty, pile, piled, unpiled
from quire.operators.html import PAGE, attribute_map, attrs

SELECTOR_TYPES = ("css", "xpath")
BITS = 62  # steps whose outcome is kept in one number
UNSUPPORTED = "parse: unsupported selector"


@dataclass
class Step:
    """One element test, and how it hangs on the step before: ``" "`` inside it, ``">"`` its child."""

    link: str
    tag: str | None = None
    tests: list[tuple[str, str, str | None]] = field(default_factory=list)  # (what, name, value)
    nth: int | None = None

    def attributes(self) -> list[str]:
        return [{"class": "class", "id": "id"}.get(w.removeprefix("not-"), n) for w, n, _ in self.tests if "tag" not in w]

    def predicate(self, tag: Column, values: dict[str, Column]) -> Column:
        """The test of an element with this tag and these attributes."""
        out = F.lit(True) if self.tag is None else tag == self.tag.lower()
        for what, name, value in self.tests:
            kind = what.removeprefix("not-")
            if kind == "class":
                test = values["class"].rlike(rf"(?:\A|[ \t\n\f\r]){re.escape(name)}(?:[ \t\n\f\r]|\z)")
            elif kind == "id":
                test = values["id"] == name
            elif kind == "has":
                test = values[name].isNotNull()
            elif kind == "equals":
                test = values[name] == value
            elif kind == "contains":
                test = F.contains(values[name], F.lit(value))
            else:
                test = tag == name.lower()
            test = F.coalesce(test, F.lit(False))
            out = out & (~test if what.startswith("not-") else test)
        return out


# --- fixed values: selector grammar ------------------------------------------------------------------------
_NAME = r"[A-Za-z_][\w-]*|-[A-Za-z_][\w-]*|--[\w-]+"
_ATTRIBUTE = rf"""\[\s*({_NAME})\s*(?:=\s*(?:'([^']*)'|"([^"]*)"|({_NAME}))\s*)?\]"""
_SIMPLE = rf"""\.({_NAME})|\#({_NAME})|{_ATTRIBUTE}"""
_PIECE = re.compile(rf"""({_NAME}|\*)|{_SIMPLE}|:not\(\s*([^()]*?)\s*\)""")
_XSTEP = re.compile(rf"(//|/)({_NAME}|\*)((?:\[[^\]]*\])*)")
_XTEST = re.compile(
    rf"""\[\s*(?:@({_NAME})\s*=\s*(?:'([^']*)'|"([^"]*)")"""
    rf"""|contains\(\s*@({_NAME})\s*,\s*(?:'([^']*)'|"([^"]*)")\s*\)|(\d+))\s*\]"""
)


def _simple(m: re.Match, first: int) -> tuple[str, str, str | None] | None:
    cls, ident, name, v1, v2, v3 = m.group(first, first + 1, first + 2, first + 3, first + 4, first + 5)
    if cls:
        return ("class", cls, None)
    if ident:
        return ("id", ident, None)
    if name:
        value = next((v for v in (v1, v2, v3) if v is not None), None)
        return ("has", name, None) if value is None else ("equals", name, value)
    return None


def _compound(text: str, link: str) -> Step:
    step, at = Step(link), 0
    while at < len(text):
        m = _PIECE.match(text, at)
        if m is None or (m.group(1) and at > 0):
            raise ValueError(f"unsupported selector: {text!r}")
        if m.group(1):
            step.tag = None if m.group(1) == "*" else m.group(1)
        elif m.group(8) is not None:
            inner = m.group(8)
            n = re.fullmatch(_SIMPLE, inner)
            if n:
                what, name, value = _simple(n, 1)
            elif re.fullmatch(_NAME, inner):
                what, name, value = "tag", inner, None
            else:
                raise ValueError(f"unsupported selector: {text!r}")
            step.tests.append((f"not-{what}", name, value))
        else:
            step.tests.append(_simple(m, 2))
        at = m.end()
    if at == 0:
        raise ValueError("empty selector")
    return step


def parse_css(selector: str) -> list[list[Step]]:
    """A selector list as chains of steps; raises ``ValueError`` for anything outside the grammar."""
    groups: list[list[Step]] = []
    quoted = r"""(?:"[^"]*"|'[^']*'|[^,"'])+"""
    parts = re.findall(quoted, selector)
    if not parts or sum(map(len, parts)) + len(parts) - 1 != len(selector):
        raise ValueError(f"unsupported selector: {selector!r}")
    for part in parts:
        chain, link = [], " "
        for word in re.findall(r""">|(?:\[[^\]]*\]|\([^)]*\)|[^\s>])+""", part.strip()):
            if word == ">":
                if link == ">" or not chain:
                    raise ValueError(f"unsupported selector: {selector!r}")
                link = ">"
                continue
            chain.append(_compound(word, link))
            link = " "
        if not chain or link == ">":
            raise ValueError(f"unsupported selector: {selector!r}")
        groups.append(chain)
    return groups


def parse_xpath(path: str) -> list[list[Step]]:
    """An absolute path of ``/`` and ``//`` steps with attribute tests and positions."""
    chain, at = [], 0
    text = path.strip()
    while at < len(text):
        m = _XSTEP.match(text, at)
        if m is None:
            raise ValueError(f"unsupported path: {path!r}")
        step = Step(">" if m.group(1) == "/" else " ", None if m.group(2) == "*" else m.group(2))
        inner, seen = m.group(3), 0
        while seen < len(inner):
            t = _XTEST.match(inner, seen)
            if t is None or step.nth is not None:
                raise ValueError(f"unsupported path: {path!r}")
            if t.group(1):
                step.tests.append(("equals", t.group(1), t.group(2) if t.group(2) is not None else t.group(3)))
            elif t.group(4):
                step.tests.append(("contains", t.group(4), t.group(5) if t.group(5) is not None else t.group(6)))
            else:
                step.nth = int(t.group(7))
            seen = t.end()
        chain.append(step)
        at = m.end()
    if not chain:
        raise ValueError("empty path")
    return [chain]


def parse(selector: str, kind: str = "css") -> list[list[Step]]:
    if kind not in SELECTOR_TYPES:
        raise ValueError(f"selector type must be one of {SELECTOR_TYPES}, not {kind!r}")
    return parse_css(selector) if kind == "css" else parse_xpath(selector)


# ---- selectors of a list ------------------------------------------------------------------------------------------


class _Bits:
    """Where the outcome of each step of a list of chains is kept: a word and a bit in it. A chain lies within one word."""

    def __init__(self, chains: Sequence[tuple[int, list[Step]]]):
        self.words: list[dict[str, int]] = []
        self.tests: dict[str, tuple[Step, list[int]]] = {}
        self.last: dict[int, list[tuple[int, int]]] = {}
        self.nth: list[tuple[int, int, int]] = []  # word, bit, place among siblings
        used = BITS
        for number, chain in chains:
            if len(chain) > BITS:
                raise ValueError(f"a selector of more than {BITS} steps")
            if used + len(chain) > BITS:
                self.words.append({"first": 0, "root": 0, "inside": 0, "child": 0})
                used = 0
            word = len(self.words) - 1
            for k, step in enumerate(chain):
                bit = 1 << (used + k)
                kind = ("root" if step.link == ">" else "first") if k == 0 else "child" if step.link == ">" else "inside"
                self.words[word][kind] |= bit
                _, masks = self.tests.setdefault(repr((step.tag, step.tests)), (step, []))
                masks += [0] * (word + 1 - len(masks))
                masks[word] |= bit
                if step.nth:
                    self.nth.append((word, bit, step.nth))
            used += len(chain)
            self.last.setdefault(number, []).append((word, 1 << (used - 1)))


def _long(n: int) -> Column:
    return F.lit(n).cast("bigint")


def hits(
    elements: Column,
    selectors: Sequence[tuple[str, str]],
    count_open: dict[str, Callable[[Column], Column]] | None = None,
    all_elements: bool = False,
    names: Column | None = None,
) -> Column:
    """The elements that match any of the ``(selector, type)`` pairs, with ``hits``, the indexes of those pairs.

    ``elements`` is an array of structs as ``element_array`` makes it. Each test in ``count_open`` adds a field with the
    number of elements around this one that pass it. With ``all_elements`` those without a hit come too.
    """
    bits = _Bits([(i, chain) for i, (sel, kind) in enumerate(selectors) for chain in parse(sel, kind)])
    wanted = list(dict.fromkeys(n for step, _ in bits.tests.values() for n in step.attributes()))
    counted = count_open or {}
    words = range(len(bits.words))
    entry = [f"m{w}:bigint,a{w}:bigint" for w in words] + [f"n{i}:int" for i in range(len(bits.nth))] + [f"c{i}:int" for i in range(len(counted))]
    entry_type = f"struct<{','.join(entry)}>"
    out_fields = ["i:int", *[f"m{w}:bigint" for w in words], *[f"c{i}:int" for i in range(len(counted))]]
    out_type = f"struct<{','.join(out_fields)}>"
    zeros = F.struct(*[F.lit(0).alias(f.split(":")[0]) for f in ",".join(entry).split(",")]).cast(entry_type)
    start = F.struct(F.array(zeros).alias("stack"), F.lit(0).alias("i"), pile(out_type))
    last_bits = [sum(bit for found in bits.last.values() for word, bit in found if word == w) for w in words]

    def passed(e: Column, parent: Column, values: dict[str, Column]) -> Column:
        """Bits of the steps that an element passes, places among siblings left aside."""
        fits = {key: step.predicate(e["tag"], values) for key, (step, _) in bits.tests.items()}
        out = []
        for w in words:
            test = F.lit(0).cast("bigint")
            for key, (_, masks) in bits.tests.items():
                if w < len(masks) and masks[w]:
                    test = test.bitwiseOR(F.when(fits[key], _long(masks[w])).otherwise(_long(0)))
            mask = bits.words[w]
            around = F.shiftleft(parent[f"a{w}"], 1).bitwiseAND(_long(mask["inside"])).bitwiseOR(F.shiftleft(parent[f"m{w}"], 1).bitwiseAND(_long(mask["child"])))
            around = around.bitwiseOR(_long(mask["first"])).bitwiseOR(F.when(e["depth"] == 1, _long(mask["root"])).otherwise(_long(0)))
            out.append(test.bitwiseAND(around).alias(f"m{w}"))
        return F.struct(*out)

    def entered(e: Column, parent: Column, m: Column) -> Column:
        """An element's entry in the stack, its parent's, and what it adds to the result."""
        counts = [parent[f"n{i}"] + F.when(m[f"m{w}"].bitwiseAND(_long(bit)) != 0, 1).otherwise(0) for i, (w, bit, _) in enumerate(bits.nth)]
        kept = {w: m[f"m{w}"] for w in words}
        for i, (w, bit, nth) in enumerate(bits.nth):
            kept[w] = F.when(counts[i] == nth, kept[w]).otherwise(kept[w].bitwiseAND(_long(~bit)))
        inner = [parent[f"c{i}"] + F.when(test(e), 1).otherwise(0) for i, test in enumerate(counted.values())]
        here = F.struct(
            *[x for w in words for x in (kept[w].alias(f"m{w}"), parent[f"a{w}"].bitwiseOR(kept[w]).alias(f"a{w}"))],
            *[F.lit(0).alias(f"n{i}") for i in range(len(bits.nth))], *[c.alias(f"c{i}") for i, c in enumerate(inner)],
        )
        around = F.struct(*[x for w in words for x in (parent[f"m{w}"].alias(f"m{w}"), parent[f"a{w}"].alias(f"a{w}"))],
                          *[c.alias(f"n{i}") for i, c in enumerate(counts)], *[parent[f"c{i}"].alias(f"c{i}") for i in range(len(counted))])
        return F.struct(here.alias("here"), around.alias("around"))

    def merge(s: Column, e: Column) -> Column:
        def on(s: Column, x: Column) -> Column:
            below = F.slice(s["stack"], F.lit(1), e["depth"])
            if bits.nth:
                below = F.array_append(F.slice(s["stack"], F.lit(1), e["depth"] - 1), x["around"])
            row = F.struct(s["i"].alias("i"), *[x["here"][f"m{w}"].alias(f"m{w}") for w in words], *[x["around"][f"c{i}"].alias(f"c{i}") for i in range(len(counted))])
            any_hit = _any([F.lit(all_elements), *[x["here"][f"m{w}"].bitwiseAND(_long(last_bits[w])) != 0 for w in words]])
            return then(s, F.when(any_hit, F.array(row)).otherwise(empty(out_type)), lambda s, out: F.struct(
                F.array_append(below, x["here"]).alias("stack"), (s["i"] + 1).alias("i"), piled(s, out),
            ))

        # a tag without attributes is as long as its name and two brackets
        bare = F.length(e["raw"]) <= F.length(e["tag"]) + 2
        found = F.when(~bare, attrs(wanted, e["raw"], names)) if wanted else F.lit(0)

        def of(found: Column, parent: Column) -> Column:
            values = {n: found[f"a{k}"] for k, n in enumerate(wanted)}
            return let(passed(e, parent, values), lambda m: entered(e, parent, m))

        entry = let(F.get(s["stack"], e["depth"] - 1), lambda parent: let(found, lambda found: of(found, parent)))
        return then(s, entry, on)

    def named(x: Column) -> Column:
        e = F.get(elements, x["i"])
        which = [F.when(_any([x[f"m{w}"].bitwiseAND(_long(bit)) != 0 for w, bit in found]), F.lit(i)) for i, found in bits.last.items()]
        fields = [e[c].alias(c) for c in ("start_pos", "end_pos", "parent_pos", "depth", "tag", "raw", "void")]
        return F.struct(*fields, F.filter(F.array(*which), lambda h: h.isNotNull()).alias("hits"), *[x[f"c{i}"].alias(n) for i, n in enumerate(counted)])

    return F.transform(F.aggregate(elements, start, merge, unpiled), named)


def _any(tests: Sequence[Column]) -> Column:
    out = tests[0]
    for test in tests[1:]:
        out = out | test
    return out


def select(
    nodes: DataFrame,
    selectors: Sequence[tuple[str, str]],
    keys: Sequence[str] = PAGE,
    keep: Sequence[str] = ("tag", "raw", "n_tokens"),
    count_open: dict[str, Callable[[Column], Column]] | None = None,
    all_elements: bool = False,
) -> DataFrame:
    """``hits`` over a table of elements: ``(*keys, start_pos, end_pos, hits, *keep)``, one row per element with a hit."""
    keys = list(keys)
    own = ["start_pos", "end_pos", "depth", "tag", "raw", "void"]
    other = [c for c in keep if c not in own]
    element = F.struct(*own, F.lit(None).cast("int").alias("parent_pos"))
    pages = nodes.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("start_pos", element.alias("e"), *other))).alias("_n"))
    found = hits(F.col("_n.e"), selectors, count_open, all_elements)
    rest = lambda h: F.get(F.filter("_n", lambda n: n["start_pos"] == h["start_pos"]), F.lit(0))
    if other:
        found = F.transform(found, lambda h: F.struct(h.alias("h"), *[rest(h)[c].alias(c) for c in other]))
    else:
        found = F.transform(found, lambda h: F.struct(h.alias("h")))
    rows = pages.select(*keys, F.explode_outer(found).alias("_h")).where(F.col("_h").isNotNull())
    return rows.select(
        *keys, "_h.h.start_pos", "_h.h.end_pos", "_h.h.hits", *[F.col(f"_h.{c}" if c in other else f"_h.h.{c}").alias(c) for c in keep],
        *[F.col(f"_h.h.{c}").alias(c) for c in count_open or {}],
    )


def css_select(
    nodes: DataFrame, selectors: Sequence[tuple[int, str]], keys: Sequence[str] = PAGE
) -> DataFrame:
    """All matches of ``(id, css selector)`` pairs: ``(*keys, selector_id, start_pos, end_pos, tag, raw)``."""
    ids = F.array(*[F.lit(i) for i, _ in selectors])
    found = select(nodes, [(s, "css") for _, s in selectors], keys, keep=("tag", "raw"))
    return found.select(
        *keys, F.explode("hits").alias("_h"), "start_pos", "end_pos", "tag", "raw",
    ).select(*keys, F.get(ids, F.col("_h")).alias("selector_id"), "start_pos", "end_pos", "tag", "raw")


def xpath_select(nodes: DataFrame, path: str, keys: Sequence[str] = PAGE) -> DataFrame:
    """The first element of each page that the path leads to: ``(*keys, start_pos, end_pos)``."""
    return first_match(select(nodes, [(path, "xpath")], keys, keep=()), keys)


def first_match(matches: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """The earliest match of each page."""
    return matches.groupBy(*keys).agg(F.min_by("end_pos", "start_pos").alias("end_pos"), F.min("start_pos").alias("start_pos"))


# ---- selectors that are data --------------------------------------------------------------------------------------

_TEST = "struct<what:string,name:string,value:string>"
STEP = f"struct<first:boolean,last:boolean,link:string,tag:string,tests:array<{_TEST}>,nth:int>"
_TYPED = rf"(?:{_NAME}|\*)"
_PIECES = rf"""{_TYPED}|\.(?:{_NAME})|\#(?:{_NAME})|\[[^\]]*\]|:not\([^()]*\)"""


def _test(what: Column | str, name: Column, value: Column | None = None) -> Column:
    what = F.lit(what) if isinstance(what, str) else what
    return F.struct(what.alias("what"), name.alias("name"), (F.lit(None) if value is None else value).cast("string").alias("value"))


def _simple_test(piece: Column) -> Column:
    """The test that a piece such as ``.name``, ``#name``, ``[name]`` or ``[name=value]`` is; null for any other piece."""
    part = lambda group: F.regexp_extract(piece, rf"\A{_ATTRIBUTE}\z", group)
    attribute = F.when(F.contains(piece, F.lit("=")), _test("equals", F.lower(part(1)), F.concat(part(2), part(3), part(4)))).otherwise(_test("has", F.lower(part(1))))
    return (
        F.when(piece.rlike(rf"\A\.(?:{_NAME})\z"), _test("class", F.substr(piece, F.lit(2))))
        .when(piece.rlike(rf"\A\#(?:{_NAME})\z"), _test("id", F.substr(piece, F.lit(2))))
        .when(piece.rlike(rf"\A{_ATTRIBUTE}\z"), attribute)
    )


def _css_step(word: Column) -> Column:
    """``(tag, tests, good)`` of a compound selector."""

    def of(pieces: Column) -> Column:
        def test(piece: Column) -> Column:
            inner = F.regexp_extract(piece, r"(?s)\A:not\(\s*([^()]*?)\s*\)\z", 1)
            inside = F.coalesce(_simple_test(inner), F.when(inner.rlike(rf"\A(?:{_NAME})\z"), _test("tag", F.lower(inner))))
            return F.when(piece.startswith(":"), F.when(inside.isNotNull(), _test(F.concat(F.lit("not-"), inside["what"]), inside["name"], inside["value"]))).otherwise(_simple_test(piece))

        typed = F.get(pieces, F.lit(0)).rlike(rf"\A{_TYPED}\z")
        rest = F.when(typed, F.slice(pieces, F.lit(2), F.size(pieces))).otherwise(pieces)
        tests = F.transform(rest, test)
        whole = (F.size(pieces) > 0) & (F.array_join(pieces, "") == word)
        tag = F.when(typed, F.nullif(F.lower(F.get(pieces, F.lit(0))), F.lit("*")))
        return let(tests, lambda tests: F.struct(tag.alias("tag"), tests.alias("tests"), (whole & ~F.exists(tests, lambda t: t.isNull())).alias("good")))

    return let(F.regexp_extract_all(word, F.lit(_PIECES), F.lit(0)), of)


def _steps(chain: Column) -> Column:
    """Places of a chain's steps ``(link, tag, tests, nth)``."""
    return F.transform(chain, lambda s, i: F.struct(
        (i == 0).alias("first"), (i == F.size(chain) - 1).alias("last"), s["link"].alias("link"), s["tag"].alias("tag"), s["tests"].alias("tests"), s["nth"].cast("int").alias("nth"),
    ).cast(STEP))


_RAW_STEP = f"struct<link:string,tag:string,tests:array<{_TEST}>,nth:int>"


def _compiled_css(selector: Column) -> Column:
    def chain(part: Column) -> Column:
        def of(words: Column) -> Column:
            arrow = lambda i: F.get(words, i) == ">"
            good = ~arrow(F.lit(0)) & (F.try_element_at(words, F.lit(-1)) != ">")
            good = good & ~F.exists(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1))), lambda i: F.coalesce(arrow(i) & arrow(i - 1), F.lit(False)))
            steps = F.transform(words, lambda w, i: F.struct(F.when(w != ">", _css_step(w)).alias("s"), F.when((i > 0) & arrow(i - 1), ">").otherwise(" ").alias("link")))
            steps = F.filter(steps, lambda x: x["s"].isNotNull())
            return let(steps, lambda steps: F.struct(
                F.when(F.size(words) > 0, good & ~F.exists(steps, lambda x: ~x["s"]["good"])).otherwise(False).alias("good"),
                _steps(F.transform(steps, lambda x: F.struct(x["link"].alias("link"), x["s"]["tag"].alias("tag"), x["s"]["tests"].alias("tests"), F.lit(None).cast("int").alias("nth")))).alias("steps"),
            ))

        return let(F.regexp_extract_all(F.trim(replace_blanks(part)), F.lit(r">|(?:\[[^\]]*\]|\([^)]*\)|[^\s>])+"), F.lit(0)), of)

    def of(parts: Column) -> Column:
        whole = (F.size(parts) > 0) & (F.length(F.array_join(parts, "")) + F.size(parts) - 1 == F.length(selector))
        return let(F.transform(parts, chain), lambda chains: F.when(whole & ~F.exists(chains, lambda c: ~c["good"]), F.flatten(F.transform(chains, lambda c: c["steps"]))))

    return let(F.regexp_extract_all(selector, F.lit(r"""(?:"[^"]*"|'[^']*'|[^,"'])+"""), F.lit(0)), of)


def replace_blanks(c: Column) -> Column:
    return F.regexp_replace(c, r"\A\s+|\s+\z", "")


def _compiled_xpath(path: Column) -> Column:
    step_pattern = rf"(//|/)({_NAME}|\*)((?:\[[^\]]*\])*)"
    quoted = r"""(?:'([^']*)'|"([^"]*)")"""
    equals = rf"\A\[\s*@({_NAME})\s*=\s*{quoted}\s*\]\z"
    contains = rf"\A\[\s*contains\(\s*@({_NAME})\s*,\s*{quoted}\s*\)\s*\]\z"
    place = r"\A\[\s*(\d+)\s*\]\z"

    def step(text: Column) -> Column:
        def of(tests: Column) -> Column:
            got = lambda t, pattern, kind: _test(kind, F.lower(F.regexp_extract(t, pattern, 1)), F.concat(F.regexp_extract(t, pattern, 2), F.regexp_extract(t, pattern, 3)))
            one = lambda t: F.when(t.rlike(equals), got(t, equals, "equals")).when(t.rlike(contains), got(t, contains, "contains"))
            # a place may only come last
            last = F.try_element_at(tests, F.lit(-1))
            placed = (F.size(tests) > 0) & F.coalesce(F.when(F.size(tests) > 0, last.rlike(place)), F.lit(False))
            plain = F.transform(F.slice(tests, F.lit(1), F.size(tests) - F.when(placed, 1).otherwise(0)), one)
            whole = F.array_join(tests, "") == F.regexp_extract(text, step_pattern, 3)
            name = F.regexp_extract(text, step_pattern, 2)
            return F.struct(
                F.when(text.startswith("//"), " ").otherwise(">").alias("link"), F.nullif(F.lower(name), F.lit("*")).alias("tag"), plain.alias("tests"),
                F.when(placed, F.regexp_extract(last, place, 1).try_cast("int")).alias("nth"), (whole & ~F.exists(plain, lambda t: t.isNull())).alias("good"),
            )

        return let(F.regexp_extract_all(F.regexp_extract(text, step_pattern, 3), F.lit(r"\[[^\]]*\]"), F.lit(0)), of)

    def of(texts: Column) -> Column:
        whole = (F.size(texts) > 0) & (F.array_join(texts, "") == replace_blanks(path))
        return let(F.transform(texts, step), lambda steps: F.when(whole & ~F.exists(steps, lambda s: ~s["good"]), _steps(steps)))

    return let(F.regexp_extract_all(replace_blanks(path), F.lit(step_pattern), F.lit(0)), of)


def compiled(selector: Column, kind: Column) -> Column:
    """The steps of a selector in a row, ``array<STEP>``; null for one that is outside the grammar or of another type."""
    return F.when(kind == "css", _compiled_css(selector)).when(kind == "xpath", _compiled_xpath(selector))


def _fits(e: Column, step: Column, values: Column) -> Column:
    def test(t: Column) -> Column:
        kind = F.replace(t["what"], F.lit("not-"), F.lit(""))
        value = F.try_element_at(values, F.when(kind.isin("class", "id"), kind).otherwise(t["name"]))
        got = (
            F.when(kind == "tag", e["tag"] == t["name"])
            .when(kind == "class", F.array_contains(F.split(value, r"[ \t\n\f\r]+"), t["name"]))
            .when(kind == "id", value == t["name"])
            .when(kind == "has", value.isNotNull())
            .when(kind == "equals", value == t["value"])
            .otherwise(F.contains(value, t["value"]))
        )
        return F.coalesce(got, F.lit(False)) != t["what"].startswith("not-")

    return (step["tag"].isNull() | (step["tag"] == e["tag"])) & F.forall(step["tests"], test)


def first_span(elements: Column, steps: Column, names: Column | None = None) -> Column:
    """``(start_pos, end_pos)`` of the first element that ``steps`` match, null if there is none."""
    if names is None:
        return with_names(lambda names: first_span(elements, steps, names))
    none = F.lit(None).cast("struct<start_pos:int,end_pos:int>")
    entry_type = "struct<m:array<boolean>,a:array<boolean>,n:array<int>>"

    def of(steps: Column) -> Column:
        nothing = F.transform(steps, lambda s: F.lit(False))
        root = F.struct(nothing.alias("m"), nothing.alias("a"), F.transform(steps, lambda s: F.lit(0)).alias("n")).cast(entry_type)
        start = F.struct(F.array(root).alias("stack"), none.alias("found"))

        def merge(s: Column, e: Column) -> Column:
            tried = F.exists(steps, lambda x: (F.size(x["tests"]) > 0) & (x["tag"].isNull() | (x["tag"] == e["tag"])))
            bare = F.length(e["raw"]) <= F.length(e["tag"]) + 2
            values = F.when(tried & ~bare, attribute_map(e["raw"], names))

            def passed(values: Column, up: Column) -> Column:
                def one(x: Column, k: Column) -> Column:
                    first = F.when(x["link"] == ">", e["depth"] == 1).otherwise(True)
                    hangs = F.when(x["first"], first).when(x["link"] == ">", F.get(up["m"], k - 1)).otherwise(F.get(up["a"], k - 1))
                    return hangs & _fits(e, x, values)

                return F.transform(steps, one)

            def counted(m: Column, up: Column) -> Column:
                n = F.transform(up["n"], lambda c, k: c + F.when(F.get(m, k), 1).otherwise(0))
                kept = lambda n: F.transform(m, lambda x, k: x & F.coalesce(F.get(steps, k)["nth"] == F.get(n, k), F.lit(True)))
                return let(n, lambda n: let(kept(n), lambda m: entered(m, n, up)))

            def entered(m: Column, n: Column, up: Column) -> Column:
                here = F.struct(m.alias("m"), F.zip_with(m, up["a"], lambda x, y: x | y).alias("a"), F.transform(steps, lambda s: F.lit(0)).alias("n"))
                return F.struct(here.alias("here"), F.struct(up["m"].alias("m"), up["a"].alias("a"), n.alias("n")).alias("up"))

            def pushed(s: Column, x: Column) -> Column:
                below = F.array_append(F.slice(s["stack"], F.lit(1), e["depth"] - 1), x["up"])
                hit = F.exists(F.arrays_zip(x["here"]["m"].alias("m"), steps.alias("s")), lambda y: y["m"] & y["s"]["last"])
                span = F.struct(e["start_pos"].alias("start_pos"), e["end_pos"].alias("end_pos"))
                return F.struct(F.array_append(below, x["here"].cast(entry_type)).alias("stack"), F.when(hit, span).alias("found"))

            parent = F.get(s["stack"], e["depth"] - 1)
            entry = let(values, lambda v: let(parent, lambda up: let(passed(v, up), lambda m: counted(m, up))))
            return F.when(s["found"].isNotNull(), s).otherwise(then(s, entry, pushed))

        return F.aggregate(elements, start, merge, lambda s: s["found"])

    return F.when(steps.isNotNull(), let(steps, of))
