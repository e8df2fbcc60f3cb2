"""The registered queries of the text operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, chat, mixing, packing, quality, repair, sharding, simhash, token_files, topk, url_filter, variants, warc

SHARD_BYTES = 4 << 20
RULES = (
    url_filter.Rule("allow", "org", "/"), url_filter.Rule("block", "example.org", "/es/"), url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"), url_filter.Rule("block", "com", "/de/"),
)
RANKS = bpe.Vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "ranks")
JSON = bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def coded_and_decoded(docs: DataFrame, vocabulary: bpe.Vocabulary = RANKS, *keep: str) -> DataFrame:
    """``doc_id``, ``keep``, ``n_tokens``, ``n_split``, digests of the ids and of the bytes they decode to."""
    coded = bpe.encode(docs, vocabulary, keep=["doc_id", *keep])
    coded = coded.withColumns(
        {
            "n_tokens": F.size("ids").cast("bigint"),
            "ids_sha256": F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256),
        }
    )
    back = bpe.decode(coded, vocabulary, keep=["doc_id", *keep, "n_tokens", "ids_sha256", "n_split"])
    return back.withColumn("decoded_sha256", F.sha2("decoded", 256)).select("doc_id", *keep, "n_tokens", "ids_sha256", "decoded_sha256", "n_split")


def op1_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return coded_and_decoded(_table(spark, sf, "documents"))


def op2_shards(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.shards(_table(spark, sf, "documents"), SHARD_BYTES)


def op3_quality(spark: SparkSession, sf: str) -> DataFrame:
    judged = quality.judge(_table(spark, sf, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.taken_words(mixing.mix(_table(spark, sf, "documents")))


def op5_urls(spark: SparkSession, sf: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op6_chat(spark: SparkSession, sf: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    talks = _table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    read = chat.read_back(chat.format_chats(talks))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join("learnt", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length(learnt).cast("bigint").alias("loss_chars"),
        F.sha2(learnt.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        "valid",
    )


def op7_token_files(spark: SparkSession, sf: str) -> DataFrame:
    manifest = token_files.write_token_files(_table(spark, sf, "documents"), JSON)
    read = token_files.read_token_files(manifest, ids=False)
    return read.select(F.col("key").alias("doc_id"), "start", "n_tokens", F.col("crc32").alias("ids_crc32"))


def op8_warc(spark: SparkSession, sf: str) -> DataFrame:
    read = warc.read_warc(warc.write_warc(_table(spark, sf, "pages")), payloads=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_topk(spark: SparkSession, sf: str) -> DataFrame:
    return topk.top_k(_table(spark, sf, "embeddings"))


def op10_simhash(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_packing(spark: SparkSession, sf: str) -> DataFrame:
    packed = packing.pack(_table(spark, sf, "documents"), JSON, end_id=2, ids=False)
    return packed.select("doc_id", "piece", "start", F.col("length").cast("bigint").alias("length"), "ids_crc32", "sequence_id", "offset")


def op12_spelling(spark: SparkSession, sf: str) -> DataFrame:
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    # words of seven letters come of runs of seven letters or more
    runs = F.regexp_extract_all(F.translate("text", capitals, capitals.lower()), F.lit(r"[a-z\x{C0}-\x{FF}]{7,}"), F.lit(0))
    rows = _table(spark, sf, "documents").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode_outer(runs).alias("run"))
    rows = rows.withColumn("h", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary"))).withColumn("at", (F.col("h") % F.length("run")).cast("int"))
    cut = F.concat(F.left("run", F.col("at")), F.substr("run", F.col("at") + 2))
    words = rows.select(F.when(F.col("h") % 31 == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= 7)
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    return variants.variants(counted).select("word", "form", "root", "n", "n_near", "form_n")


def damaged(talks: DataFrame) -> DataFrame:
    """Conversations with planted faults: by a checksum, rows are dropped, emptied, cut short, repeated or given to the user."""
    text, role = (F.coalesce(F.col(c), F.lit(" ")) for c in ("text", "role"))
    key = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c != ":" else F.lit(c) for c in ("conv_id", ":", "turn")])
    fault = F.crc32(key.cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(fault == 4, "user").otherwise(role)
    copies = F.array_repeat(F.lit(0), F.when(fault == 3, 2).otherwise(1))
    return talks.where(fault != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def op13_repair(spark: SparkSession, sf: str) -> DataFrame:
    talks = _table(spark, sf, "conversations")
    every = talks.groupBy(F.col("conv_id").alias("id")).agg(F.lit(1).alias("one")).drop("one")
    found = repair.summary(repair.repair(damaged(talks)))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return every.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("id").alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_bpe, op2_shards, op3_quality, op4_mixing, op5_urls, op6_chat, op7_token_files, op8_warc, op9_topk, op10_simhash, op11_packing, op12_spelling, op13_repair)
}
