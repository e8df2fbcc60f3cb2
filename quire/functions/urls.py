"""Column functions over URLs: host, hash, and resolution of a reference against a base (RFC 3986)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.bind import let

# --- fixed values: patterns (RFC 3986, appendix B, and its character classes) --------------------------------
PARTS = r"(?s)\A(?:([A-Za-z][A-Za-z0-9+.-]*):)?(//([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?\z"
VALID_PATH = r"\A[A-Za-z0-9\-_.~!$&'()*+,;=:@/\[\]%]*\z"
SAFE_IN_PATH = r"\A[A-Za-z0-9\-_.~$&+,/:;=@]\z"
VALID_FRAGMENT = r"\A[A-Za-z0-9\-_.~!$&'()*+,;=:@/?\[\]%]*\z"
SAFE_IN_FRAGMENT = r"\A[A-Za-z0-9\-_.~!$&()*+,/:;=?@]\z"
BAD_ESCAPE = r"%(?![0-9A-Fa-f]{2})"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _parts(c: Column) -> Column:
    names = ["scheme", "net", "authority", "path", "query", "fragment"]
    return F.struct(c.alias("url"), *[F.regexp_extract(c, PARTS, i).alias(n) for i, n in enumerate(names, 1)])


def _parseable(u: Column) -> Column:
    """Whether split parts are those of a URL."""
    address = F.regexp_replace(u["authority"], r"\A.*@", "")
    return (
        u["url"].isNotNull()
        & ~u["url"].rlike(r"[\x00-\x1f\x7f]")
        & ~u["authority"].rlike(r"[ <>\"\\^`{|}]")
        & ~address.rlike(r"\A(?:\[[^\]]*\]|[^\[:]*):.*[^0-9]")
        & ~F.concat(u["authority"], u["path"], u["fragment"]).rlike(BAD_ESCAPE)
        & ~((u["scheme"] == "") & (u["net"] == "") & u["path"].rlike(r"\A[^/]*:"))
    )


def _host(u: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(u["authority"], r"\A.*@", ""), r":[0-9]*\z", "")
    return F.when(_parseable(u), F.regexp_replace(bare, r"\A\[(.*)\]\z", "$1"))


def host(c: Column | str) -> Column:
    """Host name without user and port, case kept; empty without a host, null where unparseable."""
    return let(_parts(_col(c)), _host)


def is_http(c: Column | str) -> Column:
    return _col(c).rlike(r"\Ahttps?://")


def url_hash(c: Column | str) -> Column:
    return F.md5(_col(c))


def cache_file(c: Column | str) -> Column:
    return F.concat(url_hash(c), F.lit(".html"))


def site_file(site: Column | str) -> Column:
    return F.concat(F.lit("catalog-"), F.translate(_col(site), ".:", "--"), F.lit(".json"))


def _percent(c: Column, safe: str) -> Column:
    """Decode what is encoded, then encode each character that is not safe."""
    decoded = F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    return F.array_join(
        F.transform(
            F.regexp_extract_all(decoded, F.lit(r"(?s)."), F.lit(0)),
            lambda ch: F.when(ch.rlike(safe), ch).otherwise(
                F.replace(F.replace(F.url_encode(ch), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))
            ),
        ),
        "",
    )


def _encode(c: Column, valid: str, safe: str) -> Column:
    return let(c, lambda p: F.when(p.rlike(valid), p).otherwise(_percent(p, safe)))


def _walk(segments: Column) -> Column:
    """Segments of a path after every ``.`` and ``..`` has been followed."""
    walked = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda done, s: F.when(s == ".", done)
        .when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.array_append(done, s)),
    )
    ends_in_dots = F.element_at(segments, -1).isin(".", "..")
    return F.concat(walked, F.when(ends_in_dots, F.array(F.lit(""))).otherwise(F.array().cast("array<string>")))


def _remove_dots(path: Column) -> Column:
    def body(p: Column) -> Column:
        joined = F.array_join(let(F.split(p, "/"), _walk), "/")
        rooted = F.concat(F.lit("/"), F.regexp_replace(joined, r"\A/", ""))
        return (
            F.when(p.rlike(r"(?:\A|/)\.\.?(?:/|\z)"), rooted)
            .when((p != "") & ~p.startswith("/"), F.concat(F.lit("/"), p))
            .otherwise(p)
        )

    return let(path, body)


def _resolve(base: Column, ref: Column) -> Column:
    has_scheme = ref["scheme"] != ""
    has_authority = ref["net"] != ""
    whole = has_scheme | has_authority
    merged = (
        F.when(whole | ref["path"].startswith("/"), ref["path"])
        .when(ref["path"] == "", base["path"])
        .otherwise(F.concat(F.regexp_replace(base["path"], r"[^/]*\z", ""), ref["path"]))
    )
    inherits = ~whole & (ref["path"] == "") & (ref["query"] == "")
    own = F.regexp_replace(ref["fragment"], r"\A#\z", "")
    fragment = F.when(inherits & (own == ""), base["fragment"]).otherwise(own)
    resolved = F.concat(
        F.lower(F.when(has_scheme, ref["scheme"]).otherwise(base["scheme"])), F.lit(":"),
        F.when(whole, ref["net"]).otherwise(base["net"]),
        _encode(_remove_dots(merged), VALID_PATH, SAFE_IN_PATH),
        F.when(inherits, base["query"]).otherwise(ref["query"]),
        let(
            fragment,
            lambda f: F.when(
                F.length(f) > 1,
                F.concat(F.lit("#"), _encode(F.substr(f, F.lit(2)), VALID_FRAGMENT, SAFE_IN_FRAGMENT)),
            ).otherwise(F.lit("")),
        ),
    )
    opaque = has_scheme & ~has_authority & ~ref["path"].startswith("/")
    itself = F.concat(F.lower(ref["scheme"]), F.substr(ref["url"], F.length(ref["scheme"]) + 1))
    usable = _parseable(base) & _parseable(ref)
    return F.when(usable, F.when(opaque, itself).otherwise(resolved))


def resolve(base: Column | str, reference: Column | str) -> Column:
    """``reference`` as seen from ``base``; null where either is not a URL.

    An empty reference keeps the base's query and fragment. Paths are percent-encoded where they hold
    characters that a URL cannot.
    """
    return let(
        F.struct(_parts(_col(base)).alias("b"), _parts(_col(reference)).alias("r")),
        lambda u: _resolve(u["b"], u["r"]),
    )
