"""Contracts, audit rules and gates: every rule gives rows of one issue schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Order of severities and of run states, worst first.
SEVERITIES = ("blocker", "error", "warning", "info")
STATES = ("failed", "interrupted", "degraded", "running", "pending", "success")

Rule = Callable[[dict[str, DataFrame]], DataFrame]


def violations(rows: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """(keys, rule): a row for every rule that a row breaks; a rule over nulls is not broken."""
    broken = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items()]))
    return rows.select(*keys, F.explode(broken).alias("rule"))


def rank_of(column: Column, order: tuple[str, ...]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for i, s in enumerate(order) for x in (s, i)]), column)


def worst(column: Column, order: tuple[str, ...]) -> Column:
    """The worst value of a group: an aggregate."""
    return F.array(*[F.lit(s) for s in order])[F.min(rank_of(column, order))]


def audit(tables: dict[str, DataFrame], rules: dict[str, Rule]) -> DataFrame:
    """All rules' issues, once each by (material_id, code, artifact, message)."""
    found = [rule(tables).select("material_id", F.lit(code).alias("code"), "severity", "artifact", "message") for code, rule in rules.items()]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.dropDuplicates(["material_id", "code", "artifact", "message"])


def ordered(issues: DataFrame) -> DataFrame:
    """The place of every issue within its work: worst first, then code and artifact."""
    order = Window.partitionBy("material_id").orderBy(rank_of(F.col("severity"), SEVERITIES), "code", "artifact", "message")
    return issues.withColumn("place", F.row_number().over(order))


def severity_counts(issues: DataFrame) -> DataFrame:
    """(material_id, one column for each severity, status)."""
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES]
    return issues.groupBy("material_id").agg(*counts, worst(F.col("severity"), SEVERITIES).alias("status"))


def apply_reviews(issues: DataFrame, decisions: DataFrame, budget: int) -> DataFrame:
    """Reviewed issues: a dismissed one becomes info, beyond the budget of a work they are marked unreviewed."""
    order = Window.partitionBy("material_id").orderBy(rank_of(F.col("severity"), SEVERITIES), "code", "artifact", "message")
    ranked = issues.withColumn("n", F.row_number().over(order)).join(decisions, ["material_id", "code"], "left")
    state = F.when(F.col("n") > budget, "budget_exhausted").otherwise(F.coalesce("decision", F.lit("unreviewed")))
    severity = F.when((F.col("n") <= budget) & (F.col("decision") == "dismissed"), "info").otherwise(F.col("severity"))
    return ranked.withColumn("review_state", state).withColumn("severity", severity).drop("n", "decision")


def missing_required(works: DataFrame, present: DataFrame, required: list[str]) -> DataFrame:
    """(material_id, artifact): the required artifacts that a work lacks."""
    wanted = works.select("material_id", F.explode(F.array(*[F.lit(r) for r in required])).alias("artifact"))
    return wanted.join(present, ["material_id", "artifact"], "left_anti")


def release_gate(stages: DataFrame) -> DataFrame:
    """(material_id, decision, reasons): block on failure, hold on anything unfinished, else allow."""
    of = lambda *states: F.array_sort(F.collect_set(F.when(F.col("status").isin(*states), F.concat_ws(":", "stage", "status"))))
    one = stages.groupBy("material_id").agg(of("failed", "interrupted").alias("bad"), of("degraded", "running", "pending").alias("open"))
    decision = F.when(F.size("bad") > 0, "block").when(F.size("open") > 0, "hold").otherwise("allow")
    return one.select("material_id", decision.alias("decision"), F.array_join(F.concat("bad", "open"), ",").alias("reasons"))


# Levels of a profile, from the best.
PROFILE_LEVELS = ("full", "enriched", "partial", "fallback")


def profile_level(level: Column, complete: Column, schema_issues: Column) -> Column:
    """The level as given where it is known; else full for a complete biography, partial for one with issues, or fallback."""
    return F.when(level.isin(*PROFILE_LEVELS), level).when(complete, "full").when(F.size(schema_issues) > 0, "partial").otherwise("fallback")


def profile_quality(works: DataFrame, profiles: DataFrame, targets: DataFrame) -> DataFrame:
    """(material_id, one count for each level, targets, completed, brief, failed) of every work.

    ``works`` (material_id, target_count, failed_count), ``profiles`` (material_id, name, level, complete, schema_issues),
    ``targets`` (material_id, name).  A count that is null or negative falls back to the number of named targets, or to 0.
    Full profiles with a complete biography are completed; where targets are named only theirs, and never more than
    there are targets.  The join is on work and name, so that no list of targets is gathered.
    """
    named = targets.where(F.col("name").isNotNull()).groupBy("material_id").agg(F.count("*").alias("named"))
    marked = profiles.join(targets.select("material_id", "name").distinct().withColumn("target", F.lit(True)), ["material_id", "name"], "left")
    level = profile_level(F.col("level"), F.col("complete"), F.col("schema_issues"))
    done = (F.col("level") == "full") & F.col("complete")
    counts = marked.groupBy("material_id").agg(*[F.count_if(level == x).alias(x) for x in PROFILE_LEVELS], F.count_if(F.col("level") == "brief").alias("brief"), F.count_if(done).alias("done"), F.count_if(done & F.col("target")).alias("hit"))
    both = works.join(named, "material_id", "left").join(counts, "material_id", "left").na.fill(0, ["named", "brief", "done", "hit", *PROFILE_LEVELS])
    asked = F.when(F.col("target_count") >= 0, F.col("target_count")).otherwise(F.col("named"))
    completed = F.when(F.col("named") > 0, F.col("hit")).otherwise(F.col("done"))
    failed = F.when(F.col("failed_count") >= 0, F.col("failed_count")).otherwise(0)
    return both.select("material_id", *PROFILE_LEVELS, asked.alias("targets"), F.when(asked > 0, F.least(asked, completed)).otherwise(completed).alias("completed"), "brief", failed.alias("failed"))
