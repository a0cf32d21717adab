"""The registered queries of the text operators. Their SQL, for those that SQL can express, is in oracles."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import clustering, fim, fingerprints, html, mixing, near, packing, quality, secrets, sharding, substrings, tokens, urls
from tessera.llm.common import table
from tessera.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.tiktoken")
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_signals(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", html.extract_main_text(F.col("html")).alias("text"))
    return pages.withColumn("n_chars", F.char_length("text").cast("long"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_substrings(table(spark, sf_dir, "documents"), digest=True)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", secrets.scan(F.col("text")).alias("found"))
    of_kind = lambda *kinds: F.filter("found", lambda s: s["kind"].isin(*kinds))
    return found.select(
        "doc_id",
        *[F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(secrets.digest(of_kind("assign", "access", "hex")), 256).alias("base_sha256"),
        secrets.digest(F.col("found")).alias("spans"),
    )


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), WORD_TOKENIZER)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"), URL_RULES).drop("score")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.section_tokens(table(spark, sf_dir, "documents"), BYTE_TOKENIZER, public_tokenizers.PATTERN)


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = fingerprints.with_fingerprint(docs, "text", "print")
    pairs = fingerprints.with_next(own, "doc_id", ["text", "print"])
    edited = pairs.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), fingerprints.edited_by_next(F.col("text"), F.col("text_next")).alias("edited"), "print", "print_next")
    both = fingerprints.with_fingerprint(edited, "edited", "edited_print")
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.as_string(F.col("print")).alias("fingerprint"),
        fingerprints.as_string(F.col("edited_print")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        fingerprints.likeness(F.col("print"), F.col("print_next")).alias("near_next"),
    )


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select(
        "doc_id",
        "n",
        "form",
        F.col("prefix_units").alias("prefix_chars"),
        F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.clusters(table(spark, sf_dir, "embeddings"))


def op13_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.placements(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_main_text, op3_substring_dedup, op4_secret_scan, op5_best_fit_packing, op6_url_filter, op7_token_counts, op8_order_minhash, op9_ngram_jaccard_join, op10_mix_sources, op11_fill_in_middle, op12_centroid_clustering, op13_hash_tree_shards)}
