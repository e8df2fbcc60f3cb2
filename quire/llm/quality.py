"""Quality rules by weak supervision.

Each rule looks at one signal of a text and votes good, votes bad or abstains. How far a vote can be trusted is
not set by hand: expectation-maximisation over how often each combination of votes occurs estimates, for every
rule, how often it recognises good texts and how often bad ones, and how many texts are good. A text is kept if it
is more likely good than bad by its votes.

Votes are counted by combination before anything else is done, so the estimation works on one row of at most
``3 ** len(RULES)`` combinations, however many texts there are. Signals are computed inside a row, without a
shuffle, and settled once because they are read twice.

Defined results: a null text has no words; signals of a text without words are zero and its rules abstain; rows that repeat are
judged each by itself and alike; a table in which no rule ever votes keeps the prior.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.bind import let
from quire.llm.words import BLANKS, words
from quire.session import scratch_path


class Rule(NamedTuple):
    """Votes bad from ``bad`` on, good up to ``good``; abstains between and where the base is below ``least``."""

    name: str
    value: str
    good: float
    bad: float
    base: str = "n_words"
    least: int = 1


RULES = (
    Rule("symbols", "n_symbols", 0.02, 0.1),
    Rule("marks", "n_marks", 0.08, 0.12, "word_chars"),
    Rule("repeats", "n_repeat_words", 0.3, 0.5),
    Rule("same_lines", "n_dup_lines", 0.2, 0.5, "n_lines", 2),
    Rule("capitals", "n_capitals", 0.3, 0.6, "word_chars"),
    Rule("long_words", "word_chars", 10.0, 15.0),
    Rule("same_words", "n_same_words", 0.75, 0.85),
)

#: Start of the estimation, and so many votes of every kind as if they had been seen.
PRIOR_GOOD, GOOD_KNOWN, BAD_KNOWN, SEEN = 0.85, 0.97, 0.4, 20.0
ROUNDS = 30

SIGNALS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_same_words", "n_marks")


def _only(text: Column, outside: str) -> Column:
    return F.length(F.regexp_replace(text, outside, "")).cast("bigint")


def with_signals(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``SIGNALS``."""
    raw = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("_w", words(text)).withColumn("_n", F.size("_w"))
    # hashes of three words each; equal ones are found by sorting, their words by place
    window = F.transform(
        F.when(F.col("_n") >= 3, F.slice("_w", F.lit(1), F.greatest(F.col("_n") - 2, F.lit(0)))).otherwise(F.array().cast("array<string>")),
        lambda x, i: F.xxhash64(x, F.get("_w", i + 1), F.get("_w", i + 2)),
    )
    df = df.withColumn("_h", window)
    df = df.withColumn("_i", F.when(F.size("_h") > 0, F.sequence(F.lit(0), F.size("_h") - 1)).otherwise(F.array().cast("array<int>")))
    repeats = F.size(F.array_distinct("_h")) < F.size("_h")
    df = df.withColumn("_s", F.when(repeats, F.sort_array(F.arrays_zip("_h", "_i"))))
    twice = F.filter("_s", lambda x, j: (F.get("_s", j - 1)["_h"] == x["_h"]) | (F.get("_s", j + 1)["_h"] == x["_h"]))
    df = df.withColumn("_p", F.transform(twice, lambda x: x["_i"]))
    covered = F.size(F.array_distinct(F.flatten(F.transform("_p", lambda i: F.array(i, i + 1, i + 2)))))
    lines = F.filter(F.split(raw, "\n"), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]"))
    return df.withColumn("_l", lines).select(
        *docs.columns,
        F.col("_n").cast("bigint").alias("n_words"),
        _only(raw, BLANKS).alias("word_chars"),
        _only(raw, r"[^#*$%&|<>]+").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint").alias("n_dup_lines"),
        F.when(F.col("_s").isNotNull(), covered).otherwise(0).cast("bigint").alias("n_repeat_words"),
        F.size("_l").cast("bigint").alias("n_lines"),
        _only(raw, r"[^A-Z]+").alias("n_capitals"),
        (F.col("_n") - F.size(F.array_distinct("_w"))).cast("bigint").alias("n_same_words"),
        _only(raw, r"[ \t\n\x0B\f\r\p{L}]+").alias("n_marks"),
    )


def votes(rules: Sequence[Rule] = RULES) -> Column:
    """1, -1 or 0 for every rule."""
    out = []
    for r in rules:
        ratio = F.col(r.value) / F.col(r.base)
        vote = F.when(F.col(r.base) < r.least, 0).when(ratio >= r.bad, -1).when(ratio <= r.good, 1).otherwise(0)
        out.append(vote)
    return F.array(*out)


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def posterior(vote: Column, state: Column) -> Column:
    """The probability that a text with these votes is good."""
    says = F.transform(
        vote,
        lambda v, j: F.when(v == 1, F.ln(F.get(state["good"], j) / (1 - F.get(state["bad"], j))))
        .when(v == -1, F.ln((1 - F.get(state["good"], j)) / F.get(state["bad"], j)))
        .otherwise(0.0),
    )
    return 1 / (1 + F.exp(-(F.ln(state["share"] / (1 - state["share"])) + _total(says))))


def estimate(judged: DataFrame, rules: Sequence[Rule] = RULES, rounds: int = ROUNDS) -> DataFrame:
    """One row ``share, good, bad``: the share of good texts, and how often each rule recognises good and bad ones."""
    seen = judged.groupBy("votes").agg(F.count(F.lit(1)).cast("double").alias("n"))
    # at most 3 ** len(rules) combinations, in a fixed order so that sums agree
    table = seen.agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("seen"))
    start = F.struct(
        F.lit(PRIOR_GOOD).alias("share"),
        F.array_repeat(F.lit(GOOD_KNOWN), len(rules)).alias("good"),
        F.array_repeat(F.lit(BAD_KNOWN), len(rules)).alias("bad"),
    )

    def rate(weighed: Column, j: Column, vote: int, good: bool, start_at: float) -> Column:
        mass = lambda x: x["n"] * (x["p"] if good else 1 - x["p"])
        of = lambda keep: _total(F.transform(weighed, lambda x: F.when(keep(F.get(x["votes"], j)), mass(x)).otherwise(0.0)))
        return (of(lambda v: v == vote) + SEEN * start_at) / (of(lambda v: v != 0) + SEEN)

    def step(state: Column, _: Column) -> Column:
        weighed = F.transform("seen", lambda x: F.struct(x["votes"].alias("votes"), x["n"].alias("n"), posterior(x["votes"], state).alias("p")))
        every = F.sequence(F.lit(0), F.lit(len(rules) - 1))
        return let(
            weighed,
            lambda w: F.struct(
                ((_total(F.transform(w, lambda x: x["n"] * x["p"])) + SEEN * PRIOR_GOOD) / (_total(F.transform(w, lambda x: x["n"])) + SEEN)).alias("share"),
                F.transform(every, lambda j: rate(w, j, 1, True, GOOD_KNOWN)).alias("good"),
                F.transform(every, lambda j: rate(w, j, -1, False, BAD_KNOWN)).alias("bad"),
            ),
        )

    return table.select(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step).alias("s")).select("s.*")


def judge(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), rules: Sequence[Rule] = RULES) -> DataFrame:
    """``keep`` columns with ``SIGNALS``, ``votes``, ``p_good``, ``base_failed`` and ``kept``."""
    spark = docs.sparkSession
    path = scratch_path(spark, "quality")
    signals = with_signals(docs.select(*dict.fromkeys([*keep, text])).withColumnsRenamed({c: f"{c}_of_doc" for c in keep if c in SIGNALS}), text)
    renamed = [f"{c}_of_doc" if c in SIGNALS else c for c in keep]
    signals.withColumn("votes", votes(rules)).select(*renamed, *SIGNALS, "votes").write.parquet(path)
    judged = spark.read.parquet(path)
    share, good, bad = estimate(judged, rules).first()  # 2 * len(rules) + 1 numbers
    state = {"share": F.lit(share), "good": F.array(*map(F.lit, good)), "bad": F.array(*map(F.lit, bad))}
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = judged.withColumn("p_good", posterior(F.col("votes"), state)).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5))
