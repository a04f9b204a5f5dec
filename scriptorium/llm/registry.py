"""The registered queries of this subpackage: thin, over whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from scriptorium.llm import oracles
from scriptorium.llm.best_fit import pack
from scriptorium.llm.byte_cnn import learn_quality, score_quality
from scriptorium.llm.common import fold, table
from scriptorium.llm.conversation_repair import damaged, repaired_conversations
from scriptorium.llm.decontamination import find_leaks
from scriptorium.llm.extendible_sharding import shard
from scriptorium.llm.gru_language_model import language_model_scores
from scriptorium.llm.hilbert_neighbours import nearest
from scriptorium.llm.language_profiles import identify_language, learn_prototypes
from scriptorium.llm.license_index import scan_licenses
from scriptorium.llm.line_cleaning import clean_lines
from scriptorium.llm.near_duplicates import Similarity, near_duplicates
from scriptorium.llm.spelling_trie import spelling_variants
from scriptorium.llm.token_transducer import annotate_token_counts


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = annotate_token_counts(docs, text="text", tokenizer=public_tokenizers.path("byte_bpe_50k.json"), limit=512)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents").select("doc_id", "text"), fold("doc_id", 5, 0)
    model = learn_quality(docs, table(spark, sf_dir, "labels"), id="doc_id", text="text", label="quality", where=~held_out)
    return score_quality(docs.withColumn("held_out", held_out), model, text="text", threshold=0.3).select("doc_id", "held_out", "score", "predicted")


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold("doc_id", 5, 1)
    docs = table(spark, sf_dir, "documents").select("doc_id", held_out.alias("held_out"), "text")
    return language_model_scores(docs, id="doc_id", text="text", where=~held_out)


def op4_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_leaks(docs, table(spark, sf_dir, "benchmark"), text="text", item_id="item_id", item_text="text", least=0.8)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold("doc_id", 4, 2)
    prototypes = learn_prototypes(docs, text="text", lang="lang", where=~held_out)
    found = identify_language(docs.select("doc_id", "text", held_out.alias("held_out")), prototypes, text="text")
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op6_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, id="doc_id", text="text", sim=Similarity(percent=85))


def op7_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("size"))
    return shard(docs, keys=["doc_id"], size=F.col("size"), limit=16 << 20).drop("size")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(docs, text="text", tokenizer=public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan_licenses(docs, text="text").drop("text", "places")


def op10_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, id="vec_id", vector="embedding", is_query=F.col("vec_id") % 100 == 0, k=10)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"), id="doc_id", text="text", spoil=199)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return repaired_conversations(damaged(turns), turns)


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return clean_lines(docs, text="text").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_quality_classifier, op3_language_model, op4_benchmark_leaks, op5_language_id, op6_minhash_near_duplicates, op7_extendible_shards, op8_best_fit_packing, op9_license_scan, op10_hilbert_neighbours, op11_spelling_variants, op12_conversation_repair, op13_quality_rules)}
QUERIES["pipeline"] = corpus_pipeline.run
ORACLES = {"op6_minhash_near_duplicates": oracles.NEAR_DUPLICATES, "op11_spelling_variants": oracles.SPELLING, "op12_conversation_repair": oracles.REPAIR, "op13_quality_rules": oracles.QUALITY}
