"""Registered queries of the operators, with their production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from evalweave.llm import (
    bpe_codec,
    contamination,
    katz,
    lexical_search,
    line_dedup,
    line_quality,
    near_duplicates,
    packing,
    phrase_mining,
    quality_rules,
    secret_scan,
    token_counts,
    toxicity,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    return contamination.search(docs, items).drop("text_hash")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = line_dedup.duplicate_lines(docs).withColumn("key", F.struct("doc_id", "text_hash"))
    text = F.coalesce("text", F.lit(""))
    own = docs.select("doc_id", F.struct("doc_id", F.xxhash64(text).alias("text_hash")).alias("key"))
    dropped = F.coalesce("dropped", F.array().cast("array<int>"))
    return own.join(found.select("key", "dropped"), "key", "left").select(
        "doc_id", F.size(dropped).cast("long").alias("n_dropped"), dropped.alias("dropped")
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), model)


def op4_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    field = line_quality.fit(docs, _table(spark, sf_dir, "labels"))
    return line_quality.score(docs, field)


def op5_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(_table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return near_duplicates.join(docs).drop("text_hash", "group_hash")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return secret_scan.digest(secret_scan.scan(docs, secret_scan.fit(docs)))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    return lexical_search.search(docs, items, k=10)


def op12_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return bpe_codec.digests(_table(spark, sf_dir, "documents"), tokenizer)


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_mining.mine(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_contamination": op1_contamination,
    "op2_line_dedup": op2_line_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_line_quality": op4_line_quality,
    "op5_katz_backoff": op5_katz_backoff,
    "op6_quality_rules": op6_quality_rules,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_packing": op8_packing,
    "op9_secret_scan": op9_secret_scan,
    "op10_toxicity": op10_toxicity,
    "op11_lexical_search": op11_lexical_search,
    "op12_bpe_codec": op12_bpe_codec,
    "op13_phrase_mining": op13_phrase_mining,
}
ORACLES = {
    "op1_contamination": contamination.oracle_sql(),
    "op6_quality_rules": quality_rules.oracle_sql(),
    "op11_lexical_search": lexical_search.oracle_sql(k=10),
    "op13_phrase_mining": phrase_mining.oracle_sql(),
}
