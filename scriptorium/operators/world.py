"""Entities, relations and dimensions: reference checks, summaries, routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def split_edges(edges: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges whose two ends exist, and the others with the ends that are missing."""
    ids = entities.select("entity_id").distinct()
    ends = edges.join(ids.select(F.col("entity_id").alias("source_id"), F.lit(True).alias("has_source")), "source_id", "left")
    ends = ends.join(ids.select(F.col("entity_id").alias("target_id"), F.lit(True).alias("has_target")), "target_id", "left")
    whole = F.col("has_source").isNotNull() & F.col("has_target").isNotNull()
    missing = F.concat_ws(",", F.when(F.col("has_source").isNull(), "source"), F.when(F.col("has_target").isNull(), "target"))
    return ends.where(whole).select(*edges.columns), ends.where(~whole).select(*edges.columns, missing.alias("missing"))


def relation_summaries(edges: DataFrame) -> DataFrame:
    """(entity_id, relations, degree): both directions, a loop once."""
    forward = edges.select(F.col("source_id").alias("entity_id"), F.concat(F.lit("> "), "target_id").alias("line"))
    back = edges.where("source_id <> target_id").select(F.col("target_id").alias("entity_id"), F.concat(F.lit("< "), "source_id").alias("line"))
    lines = forward.union(back)
    nth = F.row_number().over(Window.partitionBy("entity_id").orderBy("line"))
    shown = lines.withColumn("nth", nth).where("nth <= 5").groupBy("entity_id").agg(F.array_join(F.array_sort(F.collect_list("line")), "; ").alias("relations"))
    return shown.join(lines.groupBy("entity_id").agg(F.count("*").alias("degree")), "entity_id")


def resolve_names(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Names of ends become ids; a name that is unknown stays null."""
    names = entities.groupBy("name").agg(F.min("entity_id").alias("id"))
    for end in ("source", "target"):
        edges = edges.join(names.select(F.col("name").alias(f"{end}_name"), F.col("id").alias(f"{end}_id")), f"{end}_name", "left")
    return edges


def route_dimensions(works: DataFrame, profiles: DataFrame) -> DataFrame:
    """(material_id, dimension, applicable, confidence): by genre, or by a keyword of the name; the surest rule wins."""
    met = works.join(profiles, (works.genre == profiles.genre_rule) | F.contains(F.lower("name"), F.col("keyword")))
    return met.groupBy("material_id", "dimension").agg(F.max("weight").alias("confidence")).withColumn("applicable", F.col("confidence") >= 0.5)


def reconcile(current: DataFrame, legacy: DataFrame, renamed: dict[str, str]) -> DataFrame:
    """Old and new records in one shape: renamed columns, missing ones as null."""
    for old, new in renamed.items():
        legacy = legacy.withColumnRenamed(old, new)
    return current.unionByName(legacy, allowMissingColumns=True)
