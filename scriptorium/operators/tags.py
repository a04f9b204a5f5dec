"""The tag dictionary: synonyms, domains, candidates, approval, export."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def resolve_synonyms(used: DataFrame, tags: DataFrame) -> DataFrame:
    """Adds ``canonical`` (the synonym's target, or the tag itself) and ``known`` to (dimension, tag) rows."""
    known = tags.select("dimension", "tag", "synonym_of", F.lit(True).alias("found"))
    return used.join(known, ["dimension", "tag"], "left").withColumn("canonical", F.coalesce("synonym_of", "tag")).withColumn("known", F.coalesce("found", F.lit(False))).drop("found", "synonym_of")


def applicable_tags(genre_domains: DataFrame, tags: DataFrame) -> DataFrame:
    """(genre, dimension, tag): tags of the domains of a genre's map, and the common ones."""
    domains = genre_domains.select("genre", F.explode("domains").alias("dimension", "list")).select("genre", "dimension", F.explode("list").alias("domain"))
    own = domains.join(tags, ["dimension", "domain"]).select("genre", "dimension", "tag")
    common = domains.select("genre", "dimension").distinct().join(tags.where("is_common"), "dimension").select("genre", "dimension", "tag")
    return own.union(common).distinct()


def suggested_genres(asked: DataFrame, genre_domains: DataFrame, tags: DataFrame) -> DataFrame:
    """(dimension, tag, genre): genres whose map lists the domain of the tag's canonical form."""
    canonical = resolve_synonyms(asked, tags).join(tags.select("dimension", F.col("tag").alias("canonical"), "domain"), ["dimension", "canonical"])
    return canonical.join(genre_domains, F.array_contains(F.try_element_at("domains", F.col("dimension")), F.col("domain"))).select("dimension", "tag", "genre")


def count_candidates(seen: DataFrame, tags: DataFrame) -> DataFrame:
    """(dimension, tag, occurrence_count, last_seen) of used tags that the dictionary lacks."""
    return seen.join(tags, ["dimension", "tag"], "left_anti").groupBy("dimension", "tag").agg(F.count("*").alias("occurrence_count"), F.max("seen_at").alias("last_seen"))


def auto_approved(candidates: DataFrame, dimensions: list[str], least: int = 3) -> DataFrame:
    """Candidates of open dimensions that are frequent enough, with their domain: the first that is not common."""
    domain = F.coalesce(F.try_element_at(F.filter("genre_domains", lambda d: d != "common"), F.lit(1)), F.col("suggested_domain"), F.lit("common"))
    return candidates.where(F.col("dimension").isin(*dimensions) & (F.col("occurrence_count") >= least)).withColumn("domain", domain)


def export_view(tags: DataFrame) -> DataFrame:
    """(dimension, view): domains with their tags as JSON, in order."""
    by_domain = tags.groupBy("dimension", "domain").agg(F.array_sort(F.collect_list("tag")).alias("tags"))
    pairs = F.array_sort(F.collect_list(F.struct("domain", "tags")))
    return by_domain.groupBy("dimension").agg(F.to_json(F.map_from_entries(pairs)).alias("view"))


def top_of(rows: DataFrame, order: list, k: int) -> DataFrame:
    return rows.orderBy(*order).limit(k)


def running_rank(rows: DataFrame, by: str, order: list) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
