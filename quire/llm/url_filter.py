"""URL filters: rules first, link-graph propagation where no rule fits.

A rule names a host and the beginning of a path; it fits that host and all below it. Of the rules that fit, the
longest decides. Other pages are judged by their host: trust flows along links from hosts whose pages are allowed by
rule, distrust flows against links from hosts whose pages are blocked by rule, both as a personalised PageRank over
distinct host edges. A host is blocked where its distrust is over ``MARGIN`` times its trust.

Links are addresses in ``href`` that name a host; a link to the page's own host is no edge. A host's seed is the share
of its pages that rules allow (or block), so a host with very many pages weighs no more than another; edges are
counted before they are moved, and a page's text is read once for them.

Defined results: a null address, or one without ``://``, has an empty host and path, no rule, and is allowed unless that empty
host is blocked; a null html has no links; rows that repeat are judged each by itself and alike (they count as pages of their host).
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.session import settle

DAMPING, ROUNDS, MARGIN = 0.85, 10, 1.0


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def _lower(c: Column) -> Column:
    """A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column | str) -> Column:
    return F.coalesce(_lower(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column | str) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """``(rule, verdict)`` of the longest rule that fits, null if none does. The list of rules is part of the plan."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), len(r.host))):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        chosen = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def host_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``(src, dst, n)``: links between different hosts, counted."""
    hrefs = F.regexp_extract_all(html, F.lit(r"""(?i)href\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>/?#]+)"""), 1)
    found = pages.select(host_of(url).alias("src"), F.explode(hrefs).alias("to"))
    found = found.select("src", _lower(F.regexp_extract("to", r"//(.*)\z", 1)).alias("dst"))
    return found.where((F.col("dst") != "") & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def ranks(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """``(kind, host, rank)``: personalised PageRank for each ``kind``. ``edges`` are ``(kind, src, dst, share)``, ``seeds``
    ``(kind, host, seed)``. What reaches a host without edges stays there."""
    rank = seeds.withColumnRenamed("seed", "rank")
    if not edges.take(1):
        return rank.withColumn("rank", (1 - damping) * F.col("rank"))
    begin = seeds.select("kind", "host", ((1 - damping) * F.col("seed")).alias("rank"))
    for _ in range(rounds):
        moved = rank.withColumnRenamed("host", "src").join(edges, ["kind", "src"])
        moved = moved.select("kind", F.col("dst").alias("host"), (damping * F.col("rank") * F.col("share")).alias("rank"))
        rank = settle(begin.unionByName(moved).groupBy("kind", "host").agg(F.sum("rank").alias("rank")))
    return rank


def judge_urls(pages: DataFrame, rules: Sequence[Rule], margin: float = MARGIN, rounds: int = ROUNDS) -> DataFrame:
    """``(page_id, host, path, rule, verdict, trust, distrust)``."""
    read = pages.select("page_id", host_of("url").alias("host"), path_of("url").alias("path"))
    read = read.withColumn("_r", rule_for(F.col("host"), F.col("path"), rules))
    hosts = settle(
        read.groupBy("host").agg(
            F.avg((F.coalesce("_r.verdict", F.lit("")) == "allow").cast("double")).alias("trust"),
            F.avg((F.coalesce("_r.verdict", F.lit("")) == "block").cast("double")).alias("distrust"),
        )
    )
    seeds = hosts.select("host", F.explode(F.create_map(F.lit("trust"), "trust", F.lit("distrust"), "distrust")).alias("kind", "seed"))
    links = settle(host_links(pages))
    along = links.select(F.lit("trust").alias("kind"), "src", "dst", "n")
    against = links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    both = along.unionByName(against)
    out = both.groupBy("kind", "src").agg(F.sum("n").alias("_all"))
    edges = both.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("_all")).alias("share"))
    found = ranks(settle(edges), seeds.where("seed > 0"), rounds)
    scores = found.groupBy("host").agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "trust", F.col("rank"))), F.lit(0.0)).alias("trust"),
        F.coalesce(F.sum(F.when(F.col("kind") == "distrust", F.col("rank"))), F.lit(0.0)).alias("distrust"),
    )
    judged = read.join(scores, "host", "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    by_host = F.when(distrust > margin * trust, "block").otherwise("allow")
    verdict = F.coalesce("_r.verdict", by_host)
    return judged.select("page_id", "host", "path", F.col("_r.rule").alias("rule"), verdict.alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
