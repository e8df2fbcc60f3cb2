"""Documents to training data: quality rules, near-dedup, mixing, tokens.

Each stage works on all rows that the one before it kept. Stages that join a decision back to the rows write
them with a row number first, so that rows that repeat stay apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, mixing, quality, simhash
from quire.llm.queries import RANKS
from quire.session import scratch_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _numbered(spark: SparkSession, docs: DataFrame) -> DataFrame:
    path = scratch_path(spark, "numbered")
    docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()).write.parquet(path)
    return spark.read.parquet(path)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return quality.judge(docs, keep=COLUMNS).where("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (fingerprints of three-word shingles, 3 bits), the one with the smallest id."""
    rows = _numbered(spark, docs)
    return rows.join(simhash.one_of_each(rows, width=3, most=3), "row", "left_semi").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each copy that it takes; a copy cut at the end of its source's share ends with the last word taken."""
    rows = _numbered(spark, docs)
    mixed = mixing.mix(rows, keep=["row"]).where("taken > 0").select("row", "taken", "size")
    blank = r"[ \t\n\x0B\f\r]"
    pieces = F.split("text", rf"(?<=[^ \t\n\x0B\f\r])(?={blank})")  # each ends with a word, the last may be blank
    text = F.when(F.col("taken") == F.col("size"), F.col("text")).otherwise(F.array_join(F.slice(pieces, F.lit(1), F.col("taken").cast("int")), ""))
    out = rows.join(mixed, "row").withColumn("text", text)
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, ids, intact)``: token ids, and whether they decode to the text's bytes."""
    whole = docs.select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest"))
    coded = bpe.encode(whole, RANKS, keep=["doc_id", "digest"]).withColumn("n_tokens", F.size("ids").cast("bigint"))
    back = bpe.decode(coded, RANKS, keep=["doc_id", "digest", "n_tokens", "ids"])
    return back.select("doc_id", "n_tokens", "ids", (F.sha2("decoded", 256) == F.col("digest")).alias("intact"))


STAGES = [("quality rules", quality_rules), ("near dedup", near_dedup), ("mix sources", mix_sources), ("tokens", tokens)]

#: Fingerprints and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"stage-{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
