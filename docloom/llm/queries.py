"""The registered queries of the numbered operators: thin digests over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import (
    decontam, langid, lexical_rank, multiset_hash, oracles, phrases, pii, quality_cnn, rules, simhash, substrings, tokens, toxicity,
)
from docloom.llm.common import fold, labelled_sample, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


# Labelled rows that a classifier learns from, and the longest text among them.
TOXIC_ROWS, LEARNED_BYTES = 3_600, 1 << 18


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.ToxicityModel:
    """Learned from at most TOXIC_ROWS labelled documents outside the held-out fold."""
    return toxicity.fit_in_task(labelled_sample(docs, labels, "toxic", fold("doc_id", 3) != 1, TOXIC_ROWS, LEARNED_BYTES, "doc_id", "text"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUALITY_ROWS = 3_000


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = labelled_sample(docs, labels, "quality", fold("doc_id", 5) != 0, QUALITY_ROWS, LEARNED_BYTES, "doc_id", "text")
    model = quality_cnn.fit([(r["text"], r["label"]) for r in rows.collect()])
    return quality_cnn.score(docs, model).select(
        "doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, fold("doc_id", 4) != 2)
    return langid.predict(docs, model).select(
        "doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


# A deployment passes its own secret; this one makes the registered query repeatable.
SURROGATE_KEY = "public-test-key"


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), SURROGATE_KEY, count_col="n_entities").select("doc_id", "text", "n_entities")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = tokens.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset", "bucket")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tokens.length_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    # Both sides of the table's join read the histogram, a row per length; texts are read once.
    return tokens.length_table(written(counts, "length-counts"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return rules.screen(table(spark, sf_dir, "documents"), good, stratum=F.col("lang")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("item", "item_id")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset_hash.compare_with_next(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        multiset_hash.text_of(F.col("own")).alias("fingerprint"), multiset_hash.text_of(F.col("edited_own")).alias("edited_fingerprint"),
        "near_edited", "near_next")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_rank.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_toxicity": op2_toxicity,
    "op6_quality": op6_quality,
    "op7_language_id": op7_language_id,
    "op8_quality_rules": op8_quality_rules,
    "op9_decontamination": op9_decontamination,
    "op3_pii": op3_pii,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op4_packing": op4_packing,
    "op5_token_counts": op5_token_counts,
    "op11_collocations": op11_collocations,
    "op12_fingerprints": op12_fingerprints,
    "op13_lexical_search": op13_lexical_search,
}
ORACLES: dict[str, str] = dict(oracles.ORACLES)
