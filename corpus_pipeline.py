"""The corpus pipeline: language, quality, near-duplicates, benchmark leaks, packing.

Every stage takes (spark, docs, sf_dir) and all that its predecessor kept, and returns the documents that stay, with
their columns; the last returns the packed pieces.  ``run`` writes each stage's result to the shared folder and reads it
again, so that a lost executor costs a stage's task and not the pipeline.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.best_fit import pack
from scriptorium.llm.byte_cnn import learn_quality, score_quality
from scriptorium.llm.common import fold, table, written
from scriptorium.llm.decontamination import drop_leaks
from scriptorium.llm.language_profiles import UNDETERMINED, identify_language, learn_prototypes
from scriptorium.llm.near_duplicates import Similarity, near_duplicates

#: Columns of ``documents``; what else a table brings along is passed through.
ID, TEXT, LANG = "doc_id", "text", "lang"
#: A document under this probability of label 1 is rejected.
LEAST_QUALITY = 0.3
#: Share in hundredths of two documents' five-word shingles from which they are near-duplicates.
NEAR_DUPLICATE_PERCENT = 80
#: Weighted shingle similarity from which a window is a benchmark item.
LEAK_SIMILARITY = 0.8
SEQUENCE_TOKENS = 2048


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without any letter, and those whose cosine with every learned language is not positive."""
    prototypes = learn_prototypes(docs, text=TEXT, lang=LANG, where=F.lit(True))
    found = identify_language(docs.withColumn("_row", F.struct(*docs.columns)).select("_row", TEXT), prototypes, text=TEXT)
    return found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") > 0)).select("_row.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the classifier, fitted on the labelled rows of the training folds, takes for label 0."""
    model = learn_quality(docs, table(spark, sf_dir, "labels"), id=ID, text=TEXT, label="quality", where=~fold(ID, 5, 0))
    found = score_quality(docs.withColumn("_row", F.struct(*docs.columns)).select("_row", TEXT), model, text=TEXT, threshold=LEAST_QUALITY)
    return found.where("predicted = 1").select("_row.*")


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one of the smallest id.  Of rows that repeat an id, which are one document,
    the first by text stays; rows without an id are no group."""
    groups = near_duplicates(docs, id=ID, text=TEXT, sim=Similarity(percent=NEAR_DUPLICATE_PERCENT))
    gone = written(groups.where(~F.col("kept")).select(ID).distinct(), "duplicates")
    stay = docs.join(gone, ID, "left_anti").select(*docs.columns)
    repeated = written(docs.where(F.col(ID).isNotNull()).groupBy(ID).count().where("count > 1").select(ID), "repeated")
    if repeated.isEmpty():
        return stay
    once = stay.join(repeated, ID, "left_anti").select(*docs.columns)
    box = stay.join(repeated, ID, "left_semi").select(F.struct(*docs.columns).alias("row"), F.col(ID).alias("key"), F.coalesce(TEXT, F.lit("")).alias("by"))
    return once.union(box.groupBy("key").agg(F.min_by("row", "by").alias("row")).select("row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in which a benchmark item is found."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"), text=TEXT, item_id="item_id", item_text="text", least=LEAK_SIMILARITY)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document that is left, in sequences for training."""
    return pack(docs, text=TEXT, tokenizer=public_tokenizers.path("word_bpe_49k.json"), limit=SEQUENCE_TOKENS)


STAGES = [
    ("language_id", language_id),
    ("quality", quality),
    ("near_duplicates", near_duplicate_groups),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Hypervectors, a network and tokenizers are beyond SQL; the tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
