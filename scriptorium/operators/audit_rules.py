"""Audit rules over the tables of a work: coverage, character profiles, world building.  Each is a ``quality.Rule``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: a description that only states how often a character appears.
STATISTICAL = r"^出场\s+\d+\s+章，为主要角色之一。?$"
LEADS = ("protagonist", "antagonist")


def issue(rows: DataFrame, severity: Column | str, artifact: Column, message: Column) -> DataFrame:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return rows.select("material_id", severity.alias("severity"), artifact.alias("artifact"), message.alias("message"))


def chapter_coverage(t: dict[str, DataFrame]) -> DataFrame:
    """Works whose index has chapters without an analysis: a blocker with their number."""
    left = t["chapters"].join(t["analysed"], ["material_id", "chapter"], "left_anti").groupBy("material_id").agg(F.count("*").alias("n"))
    return issue(left, "blocker", F.lit("chapters"), F.concat(F.lit("missing "), F.col("n").cast("string")))


def character_profile(t: dict[str, DataFrame]) -> DataFrame:
    """Profiles by their level: brief ones need something to go by; fallbacks are errors for leads; partial ones and
    enriched ones with schema issues are to be repaired; leads and full ones need all fields and a finished biography."""
    p = t["profiles"]
    level, lead = F.coalesce("profile_level", F.lit("")), F.coalesce(F.col("role").isin(*LEADS), F.lit(False))
    empty = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    bare = empty("name") & empty("role") & empty("description")
    full = lead | (level == "full")
    lacking = empty("arc_summary") | empty("psychology") | empty("relationships") | ((level == "full") & ~F.coalesce("biography_complete", F.lit(False)))
    counted = F.coalesce(F.trim("description").rlike(STATISTICAL), F.lit(False))
    code = (
        F.when(level == "brief", F.when(bare, "fallback:warning"))
        .when(level == "fallback", F.when(lead, "fallback:error").otherwise("fallback:warning"))
        .when(level == "partial", "partial:warning")
        .when(level == "enriched", F.when(F.size("schema_issues") > 0, "partial:info"))
        .when((full | (F.col("role") == "supporting")) & (lacking | counted), F.when(full, "fallback:error").otherwise("fallback:warning"))
    )
    found = p.withColumn("code", code).where("code is not null")
    return issue(found, F.split("code", ":")[1], F.col("profile").cast("string"), F.split("code", ":")[0])


def biography_targets_done(t: dict[str, DataFrame]) -> DataFrame:
    """Works with targets that have no finished full profile: an error with both counts."""
    done = t["profiles"].where("profile_level = 'full' and biography_complete").select("material_id", "name").distinct().withColumn("done", F.lit(1))
    one = t["targets"].join(done, ["material_id", "name"], "left").groupBy("material_id").agg(F.count("*").alias("n"), F.count("done").alias("d"))
    return issue(one.where("d < n"), "error", F.lit("targets"), F.concat_ws("/", F.col("d").cast("string"), F.col("n").cast("string")))


def world_legacy(t: dict[str, DataFrame]) -> DataFrame:
    """Worlds of the old layout: an error where extraction failed and all counts are zero, a warning where counts stand
    without any statistics of evidence."""
    counts, evidence = ("levels", "regions", "factions", "lore"), ("dimensions", "entities", "relations", "evidence")
    old = t["worlds"].where("layout <> 'layered'")
    nothing = old.where(~F.col("succeeded") & (sum((F.coalesce(c, F.lit(0)) for c in counts), F.lit(0)) == 0))
    bare = old.where(F.coalesce(*counts).isNotNull() & F.coalesce(*evidence).isNull())
    return issue(nothing, "error", F.lit("world"), F.lit("empty")).union(issue(bare, "warning", F.lit("world"), F.lit("without evidence")))


def world_layered(t: dict[str, DataFrame]) -> DataFrame:
    """Worlds of the new layout: empty ones, applicable dimensions without support, primary entities without evidence,
    relations whose ends are unknown.  A world that is empty as a whole has no further issue."""
    w = t["worlds"].where("layout = 'layered'").select("material_id", "succeeded", "driving")
    entities = t["entities"].join(w, "material_id", "left_semi")
    dims = t["dimensions"].where("applicable").groupBy("material_id").agg(F.count("*").alias("wanted"), F.count_if(F.col("status") == "missing").alias("lost"))
    n = entities.groupBy("material_id").agg(F.count("*").alias("n"))
    bare = w.join(dims, "material_id").join(n, "material_id", "left").where("n is null and not driving")
    empty = bare.where("not succeeded and lost = wanted")
    rest = bare.where("succeeded or lost < wanted")
    unproven = entities.where("importance = 'primary' and evidence = 0")
    ids = entities.select("material_id", "id").distinct()
    ends = t["relations"].join(w, "material_id", "left_semi").select("material_id", "relation", F.explode(F.array_distinct(F.array("source", "target"))).alias("id"))
    unknown = ends.join(ids, ["material_id", "id"], "left_anti").select("material_id", "relation").distinct()
    found = issue(empty, "error", F.lit("world"), F.lit("empty")).union(issue(rest, "warning", F.lit("dimensions"), F.lit("without support")))
    found = found.union(issue(unproven, "warning", F.col("id").cast("string"), F.lit("without evidence")))
    return found.union(issue(unknown.join(empty, "material_id", "left_anti"), "error", F.col("relation").cast("string"), F.lit("unknown end")))


RULES = {"coverage": chapter_coverage, "profile": character_profile, "targets": biography_targets_done, "legacy": world_legacy, "layered": world_layered}
