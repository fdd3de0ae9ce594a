"""The ``opN_<name>`` queries: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moatlens.llm import (attention_lm, chat, fill_in_middle, hard_negatives, license_scan, mixing, ngram_join, oracles, pieces, posting_lists,
                          quality_mil, sharding, substring_dedup)
from moatlens.llm import quality_rules as qr
from moatlens.llm.common import read, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies; read on the driver and broadcast."""
    import public_tokenizers
    return public_tokenizers.path(name)


def query(fn):
    QUERIES[fn.__name__] = fn
    if (sql := getattr(oracles, fn.__name__.upper(), None)) is not None:
        ORACLES[fn.__name__] = sql
    return fn


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rule and adaptive verdict of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    scored = written(qr.features(docs).drop("text"), "quality-features")
    limits = written(qr.thresholds(scored), "quality-limits")
    out = qr.judge(scored, limits)
    return out.select("doc_id", F.col("qr_n_words").alias("n_words"), F.col("qr_word_chars").alias("word_chars"),
                      F.col("qr_n_symbols").alias("n_symbols"), F.col("qr_n_dup_lines").alias("n_dup_lines"),
                      F.col("qr_n_repeat_words").alias("n_repeat_words"),
                      F.col("qr_base_failed").alias("base_failed"), F.col("qr_kept").alias("kept"))


@query
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices found in every document, a row per match."""
    return license_scan.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted with loss mask, digests read back from the output."""
    odd = "<|im_end|><|im_start|>assistant ok"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = chat.formatted(chat.thread(turns))
    out = out.select("conv_id", "formatted", "segments", chat.parsed(F.col("formatted")).alias("turns"))
    nl = F.lit("\n")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], nl, t["text"], nl)), "")
    out = out.select("conv_id", "formatted", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                     chat.loss_text(F.col("segments")).alias("loss"))
    return out.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"),
                      F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


@query
def op4_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 nearest vectors of every vector whose id is divisible by 20."""
    return posting_lists.nearest(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@query
def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under 85 % shingle similarity."""
    return ngram_join.jaccard_components(read(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram base and attention model log probabilities of every document."""
    return attention_lm.scores(read(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("piece_bpe_32k.model"))


@query
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_mil.fit(docs, read(spark, sf_dir, "labels"))
    out = quality_mil.scored(docs, model)
    return out.select("doc_id", quality_mil.held_out(F.col("doc_id")).alias("held_out"), "score",
                      F.when(F.col("score") >= quality_mil.THRESHOLD, 1).otherwise(0).alias("predicted"), "n_passages", "attention")


@query
def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded with the public 32k vocabulary and decoded again."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.digests(docs, vocabulary("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")


@query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words every document gives to the mix."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = mixing.mix(docs)
    return out.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
                      F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


@query
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left in every document without windows of 50 words that an earlier document holds."""
    return substring_dedup.removals(read(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every vector whose id is divisible by 100, ten for each of its five positives."""
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = (F.col("label").cast("decimal(20,0)") + 1) % 10
    label = F.when(F.col("vec_id") % 7 == 0, moved.cast("long")).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", label))


@query
def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document among eight shards, and its shard among nine."""
    docs = sharding.assigned(read(spark, sf_dir, "documents").select("doc_id", "text"))
    out = sharding.slots(docs, ["doc_id"])
    return out.select("doc_id", F.col("shard_size").alias("size"), F.col("shard_crc32").alias("text_crc32"), F.lit("key").alias("law"),
                      "shard", F.col("shard_slot").alias("slot"), F.col("shard_grown").alias("grown_shard"))


@query
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut between lines and reordered, and the text rebuilt from that."""
    out = fill_in_middle.transformed(read(spark, sf_dir, "documents").select("doc_id", "text"))
    text = fill_in_middle.restored(F.col("fim_output"), F.col("fim_form"))
    return out.select("doc_id", F.col("fim_lines").alias("n"), F.col("fim_form").alias("form"), F.col("fim_prefix_chars").alias("prefix_chars"),
                      F.col("fim_middle_chars").alias("middle_chars"), F.sha2("fim_output", 256).alias("output_sha256"),
                      F.sha2(text, 256).alias("restored_sha256"))
