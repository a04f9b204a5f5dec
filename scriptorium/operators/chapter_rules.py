"""Checks of chapter records, tags against their dictionary, seeds of entities, pacing that is missing, and the gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.operators.quality import SEVERITIES, violations
from scriptorium.operators.statistics import ROLES, SPECIAL_TYPES, banded_pairs, previous_in_number

# Closed sets of a chapter record, and lengths of its texts.
HOOKS = ("悬念钩子", "反转钩子", "情感钩子", "信息钩子", "危机钩子", "无钩子")
PACINGS = ("快", "慢", "中", "喘息", "加速")
CHANGES = ("上升", "持平", "下降")
SUMMARY_LEAST, SUMMARY_ANALYSED, SUMMARY_SPECIAL, SUMMARY_LONG, SUMMARY_MOST = 50, 40, 20, 200, 500
EMOTION_LEAST, PROGRESS_LEAST = 5, 10
# Words of a chapter's functions that tell its pacing where tension does not.
FAST_WORDS, SLOW_WORDS = ("战斗", "冲突", "追逃", "危机"), ("日常", "过渡", "铺垫", "休整")


def expected_change(tension: Column, previous: Column) -> Column:
    return F.when(tension > previous, CHANGES[0]).when(tension < previous, CHANGES[2]).when(tension == previous, CHANGES[1])


def chapter_issues(chapters: DataFrame) -> DataFrame:
    """(material_id, chapter, severity, code) of records (material_id, chapter, type, summary, tension_level, characters,
    functions, hook_type, pacing, tension_change, emotion_transition, plot_progress, key_plot_point).

    Special chapters have a lower limit of length, and need neither characters nor a tension.  A missing summary is empty;
    other missing fields break no rule of values.  The change of tension is held against the chapter of the number before.
    """
    c, special = F.col, F.coalesce(F.col("type"), F.lit("normal")).isin(*SPECIAL_TYPES)
    n, given = F.length(F.coalesce("summary", F.lit(""))), lambda name: F.length(name) > 0
    rows = chapters.withColumn("_previous", previous_in_number(chapters, "tension_level"))
    rules = {
        "error:summary_short": n < F.when(special, SUMMARY_SPECIAL).otherwise(SUMMARY_LEAST),
        "error:summary_beyond_contract": n > SUMMARY_MOST,
        "warning:summary_long": n > SUMMARY_LONG,
        "warning:no_functions": F.coalesce(F.size("functions"), F.lit(0)) < 1,
        "error:analysis_summary_short": n < F.when(special, SUMMARY_SPECIAL).otherwise(SUMMARY_ANALYSED),
        "error:tension_range": ~special & ~c("tension_level").between(1, 5),
        "error:no_characters": ~special & (F.coalesce(F.size("characters"), F.lit(0)) < 1),
        "error:hook_type": given("hook_type") & ~c("hook_type").isin(*HOOKS),
        "error:pacing": given("pacing") & ~c("pacing").isin(*PACINGS),
        "error:key_plot_point": given("key_plot_point") & ~c("key_plot_point").isin(*ROLES),
        "error:tension_change": given("tension_change") & ~c("tension_change").isin(*CHANGES),
        "error:tension_change_differs": given("tension_change") & (c("tension_change") != expected_change(c("tension_level"), c("_previous"))),
        "error:emotion_transition_short": given("emotion_transition") & (F.length("emotion_transition") < EMOTION_LEAST),
        "error:plot_progress_short": given("plot_progress") & (F.length("plot_progress") < PROGRESS_LEAST),
    }
    found = violations(rows, ["material_id", "chapter"], rules)
    return found.select("material_id", "chapter", F.split_part("rule", F.lit(":"), F.lit(1)).alias("severity"), F.split_part("rule", F.lit(":"), F.lit(2)).alias("code"))


def unknown_tags(uses: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``uses`` (scope, dimension, tag, ...) whose tag the ``dictionary`` (dimension, tag) lacks, with their ``severity``: an
    error on a work, a warning on a chapter.  Each use counts by itself; a null tag is no use."""
    known = dictionary.select("dimension", "tag").distinct()
    missing = uses.where(F.col("tag").isNotNull()).join(known, ["dimension", "tag"], "left_anti").select(*uses.columns)
    return missing.withColumn("severity", F.when(F.col("scope") == "work", "error").otherwise("warning"))


def imported(rows: DataFrame, id_map: DataFrame, key: str, uses: DataFrame, dictionary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows under new ids by ``id_map`` (old_id, new_id), and the tags of imported works that the dictionary lacks, by new ids:
    they do not stop the import.  ``uses`` has ``key``, scope, dimension and tag."""
    ids = id_map.select(F.col("old_id").alias(key), "new_id")
    moved = lambda df: df.join(ids, key).withColumn(key, F.col("new_id")).select(*df.columns)
    return moved(rows), unknown_tags(moved(uses), dictionary)


def seed_entities(counts: DataFrame, existing: DataFrame, least: int = 5, primary: int = 10) -> DataFrame:
    """(material_id, type, name, n, importance, confidence) of names seen ``least`` times that are no entities yet."""
    new = counts.where(F.col("n") >= least).join(existing.select("material_id", "type", "name").distinct(), ["material_id", "type", "name"], "left_anti")
    return new.select("material_id", "type", "name", "n", F.when(F.col("n") >= primary, "primary").otherwise("secondary").alias("importance"), F.lit(0.45).alias("confidence"))


def recovered_pacing(rows: DataFrame) -> DataFrame:
    """Fills ``pacing`` where it is null, from ``tension_level`` and ``functions`` (array), and tells so in
    ``fallback_fields`` and ``fallback_reason``; both are null where nothing was filled."""
    told = F.array_join("functions", " ")
    has = lambda words: F.coalesce(told.rlike("|".join(words)), F.lit(False))
    near = lambda *levels: F.coalesce(F.col("tension_level").isin(*levels), F.lit(False))
    filled = F.when(near(4, 5) | has(FAST_WORDS), "快").when(near(1, 2) | has(SLOW_WORDS), "慢").otherwise("中")
    missing = F.col("pacing").isNull()
    marks = {"fallback_fields": F.when(missing, F.array(F.lit("pacing"))), "fallback_reason": F.when(missing, "tension_level, functions"), "pacing": F.coalesce("pacing", filled)}
    return rows.withColumns(marks)


def near_duplicate_warnings(chapters: DataFrame, *, width: int = 10, least: float = 0.7, most: int = 20) -> DataFrame:
    """The first ``most`` pairs of every work whose summaries resemble each other within ``width`` places; special chapters
    and those without a summary stay out."""
    plain = chapters.where(F.coalesce(F.col("type"), F.lit("normal")).isin("normal", "extra") & (F.length("summary") > 0))
    pairs = banded_pairs(plain, F.col("summary"), width, least)
    nth = F.row_number().over(Window.partitionBy("material_id").orderBy("second", "first"))
    return pairs.withColumn("nth", nth).where(F.col("nth") <= most)


def audit_summaries(issues: DataFrame, budget_state: str = "budget_exhausted") -> DataFrame:
    """(material_id, a count for each severity, not_reviewed, status) of reviewed issues: a run with a blocker failed, one with
    an error is degraded."""
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES]
    status = F.when(F.col("blocker") > 0, "failed").when(F.col("error") > 0, "degraded").otherwise("success")
    return issues.groupBy("material_id").agg(*counts, F.count_if(F.col("review_state") == budget_state).alias("not_reviewed")).withColumn("status", status)


# Stages whose failure blocks a release, and stages whose degraded state holds it.
CORE_STAGES = ("analyze", "refine", "sync")
HOLD_STAGES = ("worldbuilding", "characters", "insights")


def gate(works: DataFrame, stages: DataFrame, audits: DataFrame) -> DataFrame:
    """(material_id, decision, release_status, override, reasons) of every work.

    ``works`` (material_id, mode, allow_degraded), ``stages`` (material_id, stage, status), ``audits`` (material_id, blocker,
    error).  A failed core stage, a blocker or error of the audit, and a profile that is missing or failed where the mode
    asks for one, block; degraded stages hold, unless the work allows them, which is an override."""
    named = lambda suffix, keep: F.array_sort(F.collect_set(F.when(keep, F.concat("stage", F.lit(suffix)))))
    status, stage = F.col("status"), F.col("stage")
    profile = stage == "profile"
    told = stages.groupBy("material_id").agg(
        named("_failed", (status == "failed") & stage.isin(*CORE_STAGES)).alias("failed"), named("_degraded", (status == "degraded") & stage.isin(*HOLD_STAGES)).alias("held"),
        F.count_if(profile).alias("profiles"), F.count_if(profile & (status == "failed")).alias("bad_profiles"),
    )
    both = works.join(told, "material_id", "left").join(audits.select("material_id", "blocker", "error"), "material_id", "left")
    none, wants = F.array().cast("array<string>"), F.col("mode").isin("standard", "deep")
    more = {"audit_blocker": F.col("blocker") > 0, "audit_error": F.col("error") > 0, "profile_missing": wants & (F.coalesce("profiles", F.lit(0)) == 0), "profile_failed": wants & (F.col("bad_profiles") > 0)}
    reasons = F.concat(F.coalesce("failed", none), F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in more.items()])))
    both = both.select("material_id", F.coalesce("allow_degraded", F.lit(False)).alias("allowed"), reasons.alias("bad"), F.coalesce("held", none).alias("held"))
    blocked, held = F.size("bad") > 0, F.size("held") > 0
    decision = F.when(blocked, "block").when(held & ~F.col("allowed"), "hold").otherwise("allow")
    release = F.when(blocked, "failed").when(held, "degraded").otherwise("success")
    return both.select("material_id", decision.alias("decision"), release.alias("release_status"), (~blocked & held & F.col("allowed")).alias("override"), F.array_join(F.when(blocked, F.col("bad")).otherwise(F.col("held")), ",").alias("reasons"))


def pending(units: DataFrame, done: DataFrame, invalid: DataFrame, key: str) -> DataFrame:
    """Units that are not done, or done but invalid."""
    valid = done.select(key).distinct().join(invalid.select(key).distinct(), key, "left_anti")
    return units.join(valid, key, "left_anti").select(*units.columns)


def structured_ranking(rows: DataFrame, kind: str, group: str, k: int) -> DataFrame:
    """The first ``k`` rows of every ``group`` in the order of their document type, with the ``rank``: what is shown without a
    query.  Ties go to ``id``."""
    orders = {
        "chapter": [F.desc_nulls_last("tension_level"), F.asc("chapter")],
        "character": [F.desc_nulls_last("appearance_count")],
        "outline": [F.desc_nulls_last("chapter_count")],
        "world": [F.asc_nulls_last("importance"), F.asc("name")],
        "detail": [F.asc("act"), F.asc("sequence")],
    }
    nth = F.row_number().over(Window.partitionBy(group).orderBy(*orders[kind], F.asc("id")))
    return rows.withColumn("rank", nth).where(F.col("rank") <= k)
