"""Registered queries: contracts, audits, gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium import fixtures as fx
from scriptorium.operators import quality as ql
from scriptorium.registry import query


def rules_sql(table: str, keys: str, rules: dict[str, str]) -> str:
    return " union all ".join(f"select {keys}, '{name}' as rule from {table} where {bad}" for name, bad in rules.items())


@query(rules_sql("customer", "c_custkey", {"bad_id": "c_name not similar to 'Customer#[0-9]{9}'", "poor": "c_acctbal < 0", "segment": "c_mktsegment not in ('BUILDING', 'MACHINERY', 'HOUSEHOLD')", "number": "c_nationkey <= 0"}))
def work_contract(spark, sf):
    """DQ1."""
    rules = {"bad_id": ~F.col("c_name").rlike("^Customer#[0-9]{9}$"), "poor": F.col("c_acctbal") < 0, "segment": ~F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "HOUSEHOLD"), "number": F.col("c_nationkey") <= 0}
    return ql.violations(fx.read(spark, sf, "customer"), ["c_custkey"], rules)


CHAPTER_RULES = {"summary_short": "length(text) < 50", "summary_long": "length(text) > 500", "count": "n_chars <> length(text)", "language": "lang not in ('en', 'de')"}


@query(rules_sql("documents", "doc_id", CHAPTER_RULES))
def chapter_contract(spark, sf):
    """DQ2, DQ6, DQ8."""
    n = F.length("text")
    rules = {"summary_short": n < 50, "summary_long": n > 500, "count": F.col("n_chars") != n, "language": ~F.col("lang").isin("en", "de")}
    return ql.violations(fx.read(spark, sf, "documents"), ["doc_id"], rules)


@query(f"select distinct doc_id from ({rules_sql('documents', 'doc_id', CHAPTER_RULES)})")
def invalid_chapters(spark, sf):
    """DQ3, SE2."""
    return chapter_contract(spark, sf).select("doc_id").distinct()


@query("select conv_id, case when count(*) < 4 then 'missing:turns' when sum((role = 'user')::int) = 0 then 'missing:user' else 'ok' end as state, count(*) as n from conversations group by 1")
def required_fields(spark, sf):
    """Required turns of a conversation."""
    c = fx.read(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.count_if(F.col("role") == "user").alias("u"))
    return c.select("conv_id", F.when(F.col("n") < 4, "missing:turns").when(F.col("u") == 0, "missing:user").otherwise("ok").alias("state"), "n")


REQUIRED = ["1-URGENT", "2-HIGH", "3-MEDIUM"]
MISSING = "mr as (select c_custkey as material_id, a.artifact from customer, (values ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM')) a(artifact) where not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = a.artifact))"


def missing(spark, sf):
    works = fx.read(spark, sf, "customer").select(F.col("c_custkey").alias("material_id"))
    present = fx.read(spark, sf, "orders").select(F.col("o_custkey").alias("material_id"), F.col("o_orderpriority").alias("artifact")).distinct()
    return ql.missing_required(works, present, REQUIRED)


@query(f"with {MISSING} select * from mr")
def required_artifacts(spark, sf):
    """JO18, AU1, AU6."""
    return missing(spark, sf)


ISSUES = f"""{MISSING}, iss as (select distinct material_id, code, severity, artifact, message from (
 select material_id, 'core' as code, 'blocker' as severity, artifact, 'missing' as message from mr where artifact = '1-URGENT'
 union all select o_custkey, 'coverage', 'error', 'chapters', 'open chapters' from orders where o_orderstatus = 'O' and o_totalprice > 200000
 union all select c_custkey, 'profile', 'warning', 'profiles', 'negative balance' from customer where c_acctbal < 0
 union all select c_custkey, 'notes', 'info', 'work', c_mktsegment from customer where c_mktsegment = 'BUILDING'))"""


def issues(spark, sf):
    tables = {"missing": missing(spark, sf), "orders": fx.read(spark, sf, "orders"), "customer": fx.read(spark, sf, "customer")}

    def issue(rows, id, severity, artifact, message):
        return rows.select(F.col(id).alias("material_id"), F.lit(severity).alias("severity"), artifact.alias("artifact"), message.alias("message"))

    rules = {
        "core": lambda t: issue(t["missing"].where("artifact = '1-URGENT'"), "material_id", "blocker", F.col("artifact"), F.lit("missing")),
        "coverage": lambda t: issue(t["orders"].where("o_orderstatus = 'O' and o_totalprice > 200000"), "o_custkey", "error", F.lit("chapters"), F.lit("open chapters")),
        "profile": lambda t: issue(t["customer"].where("c_acctbal < 0"), "c_custkey", "warning", F.lit("profiles"), F.lit("negative balance")),
        "notes": lambda t: issue(t["customer"].where("c_mktsegment = 'BUILDING'"), "c_custkey", "info", F.lit("work"), F.col("c_mktsegment")),
    }
    return ql.audit(tables, rules)


RANK = "case severity when 'blocker' then 0 when 'error' then 1 when 'warning' then 2 else 3 end"


@query(f"with {ISSUES} select *, cast(row_number() over (partition by material_id order by {RANK}, code, artifact, message) as int) as place from iss")
def audit_issues(spark, sf):
    """AU8, TK7, UD4: the rule registry."""
    return ql.ordered(issues(spark, sf))


@query(f"with {ISSUES} select material_id, sum((severity = 'blocker')::int) as blocker, sum((severity = 'error')::int) as error, sum((severity = 'warning')::int) as warning, sum((severity = 'info')::int) as info, arg_min(severity, {RANK}) as status from iss group by 1")
def severity_counts(spark, sf):
    """AG13."""
    return ql.severity_counts(issues(spark, sf))


@query(f"with {ISSUES}, r as (select *, row_number() over (partition by material_id order by {RANK}, code, artifact, message) as n, case when material_id % 3 = 0 then 'dismissed' when material_id % 3 = 1 then 'confirmed' end as d from iss) select material_id, code, artifact, message, case when n > 2 then 'budget_exhausted' else coalesce(d, 'unreviewed') end as review_state, case when n <= 2 and d = 'dismissed' then 'info' else severity end as severity from r")
def review_decisions(spark, sf):
    """AU9."""
    own = issues(spark, sf)
    decision = F.when(F.col("material_id") % 3 == 0, "dismissed").when(F.col("material_id") % 3 == 1, "confirmed")
    return ql.apply_reviews(own, own.select("material_id", "code", decision.alias("decision")).distinct(), 2)


STATE = "case o_orderstatus when 'F' then 'success' when 'O' then case when o_totalprice > 250000 then 'running' else 'success' end else case when o_totalprice > 200000 then 'failed' else 'success' end end"


def stages(spark, sf):
    price, status = F.col("o_totalprice"), F.col("o_orderstatus")
    state = F.when((status == "O") & (price > 250_000), "running").when((status == "P") & (price > 200_000), "failed").otherwise("success")
    return fx.read(spark, sf, "orders").select(F.col("o_custkey").alias("material_id"), F.col("o_orderpriority").alias("stage"), state.alias("status"))


@query(f"with s as (select o_custkey as material_id, o_orderpriority || ':' || ({STATE}) as x, {STATE} as st from orders), g as (select material_id, string_agg(distinct case when st = 'failed' then x end, ',' order by case when st = 'failed' then x end) as bad, string_agg(distinct case when st = 'running' then x end, ',' order by case when st = 'running' then x end) as opn from s group by 1) select material_id, case when bad is not null then 'block' when opn is not null then 'hold' else 'allow' end as decision, concat_ws(',', bad, opn) as reasons from g")
def release_gate(spark, sf):
    """AG26."""
    return ql.release_gate(stages(spark, sf))


@query(f"with s as (select o_custkey as material_id, {STATE} as st from orders) select material_id, arg_min(st, case st when 'failed' then 0 when 'running' then 3 else 5 end) as status from s group by 1")
def status_rollup(spark, sf):
    """AG25."""
    return stages(spark, sf).groupBy("material_id").agg(ql.worst(F.col("status"), ql.STATES).alias("status"))


@query(f"with s as (select o_custkey as material_id, o_orderpriority as stage, {STATE} as st from orders) select material_id, count(distinct stage) as present, min(case when st <> 'success' then stage end) as next_stage from s group by 1")
def work_progress(spark, sf):
    """AG39, ST8: stages present, and the first that did not succeed in the public order."""
    return stages(spark, sf).groupBy("material_id").agg(F.countDistinct("stage").alias("present"), F.min(F.when(F.col("status") != "success", F.col("stage"))).alias("next_stage"))


@query("select count(*) as total, sum((quality is not null)::int) as processed, sum((quality is null)::int) as remaining, sum((coalesce(toxic, 0) = 1)::int) as failed, round(100 * sum((quality is not null)::int) / count(*), 4) as percent from documents left join labels using (doc_id)")
def classification_progress(spark, sf):
    """AG37."""
    d = fx.read(spark, sf, "documents").select("doc_id").join(fx.read(spark, sf, "labels"), "doc_id", "left")
    done = F.col("quality").isNotNull()
    return d.agg(F.count("*").alias("total"), F.count_if(done).alias("processed"), F.count_if(~done).alias("remaining"), F.count_if(F.col("toxic") == 1).alias("failed"), F.round(100 * F.count_if(done) / F.count("*"), 4).alias("percent"))


@query("select source, case when sum((quality is not null)::int) = 0 then 1 else round(sum(quality) / sum((quality is not null)::int), 6) end as rate, (case when sum((quality is not null)::int) = 0 then 1 else sum(quality) / sum((quality is not null)::int) end) >= 0.8 as accepted from documents left join labels using (doc_id) group by 1")
def repair_acceptance(spark, sf):
    """AG40: one where nothing was attempted."""
    d = fx.read(spark, sf, "documents").select("doc_id", "source").join(fx.read(spark, sf, "labels"), "doc_id", "left")
    rate = F.when(F.count("quality") == 0, 1.0).otherwise(F.sum("quality") / F.count("quality"))
    return d.groupBy("source").agg(F.round(rate, 6).alias("rate"), (rate >= 0.8).alias("accepted"))


@query("select source, count(*) as expected, count(quality) as present, sum((toxic = 1)::int) as failed, coalesce(string_agg(case when quality is null and n <= 50 then cast(doc_id as varchar) end, ',' order by doc_id), '') as missing from (select *, row_number() over (partition by source, quality is null order by doc_id) as n from documents left join labels using (doc_id)) group by 1")
def insight_coverage(spark, sf):
    """AG28, AU7: the first fifty missing are shown, a report's limit."""
    d = fx.read(spark, sf, "documents").select("doc_id", "source").join(fx.read(spark, sf, "labels"), "doc_id", "left")
    gone = F.slice(F.sort_array(F.collect_set(F.when(F.col("quality").isNull(), F.col("doc_id")))), 1, 50)
    return d.groupBy("source").agg(F.count("*").alias("expected"), F.count("quality").alias("present"), F.sum(F.when(F.col("quality").isNotNull(), (F.col("toxic") == 1).cast("int"))).alias("failed"), F.array_join(gone, ",").alias("missing"))


@query("select lang, round(avg((length(text) >= 100)::int), 6) as field_rate, round(avg((contains(text, 'the') and contains(text, 'and'))::int), 6) as keyword_rate, round(case when count(quality) = 0 then 1 else sum(quality) / count(quality) end, 6) as valid_rate from documents left join labels using (doc_id) group by 1")
def insight_scores(spark, sf):
    """AG35, AG19: rates, one where nothing counts."""
    d = fx.read(spark, sf, "documents").join(fx.read(spark, sf, "labels"), "doc_id", "left")
    words = F.forall(F.array(F.lit("the"), F.lit("and")), lambda w: F.contains("text", w))
    rate = lambda c: F.round(F.avg(c.cast("int")), 6)
    valid = F.when(F.count("quality") == 0, 1.0).otherwise(F.sum("quality") / F.count("quality"))
    return d.groupBy("lang").agg(rate(F.length("text") >= 100).alias("field_rate"), rate(words).alias("keyword_rate"), F.round(valid, 6).alias("valid_rate"))


PROFILES = "pr as (select o_custkey as material_id, o_orderkey as name, case o_orderkey % 6 when 0 then 'full' when 1 then 'brief' when 2 then 'enriched' when 3 then 'other' end as level, o_orderkey % 4 <> 1 as complete, o_orderkey % 5 = 0 as issues from orders), tg as (select o_custkey as material_id, o_orderkey as name from orders where o_orderkey % 2 = 0 and o_custkey % 3 > 0)"


@query(f"""with {PROFILES}, lv as (select pr.*, tg.name is not null as target, level = 'full' and complete as done, case when level in ('full', 'enriched', 'partial', 'fallback') then level when complete then 'full' when issues then 'partial' else 'fallback' end as quality from pr left join tg using (material_id, name)),
 ct as (select material_id, count(*) filter (quality = 'full') as "full", count(*) filter (quality = 'enriched') as enriched, count(*) filter (quality = 'partial') as partial, count(*) filter (quality = 'fallback') as fallback, count(*) filter (level = 'brief') as brief, count(*) filter (done) as done, count(*) filter (done and target) as hit from lv group by 1),
 nm as (select material_id, count(*) as named from tg group by 1),
 al as (select c_custkey as material_id, coalesce("full", 0) as "full", coalesce(enriched, 0) as enriched, coalesce(partial, 0) as partial, coalesce(fallback, 0) as fallback, coalesce(brief, 0) as brief, coalesce(case when named > 0 then hit else done end, 0) as got, case when c_custkey % 5 > 0 then c_custkey % 5 - 1 else coalesce(named, 0) end as targets, greatest(c_custkey % 7 - 2, 0) as failed from customer left join ct on ct.material_id = c_custkey left join nm on nm.material_id = c_custkey)
 select material_id, "full", enriched, partial, fallback, targets, case when targets > 0 then least(targets, got) else got end as completed, brief, failed from al""")
def profile_quality(spark, sf):
    """AG19: profiles by level, and targets, completed, brief and failed biographies of every work."""
    k, c = F.col("o_orderkey"), fx.read(spark, sf, "customer")
    level = F.when(k % 6 == 0, "full").when(k % 6 == 1, "brief").when(k % 6 == 2, "enriched").when(k % 6 == 3, "other")
    issues = F.when(k % 5 == 0, F.array(F.lit("name"))).otherwise(F.array().cast("array<string>"))
    profiles = fx.read(spark, sf, "orders").select(F.col("o_custkey").alias("material_id"), k.alias("name"), level.alias("level"), (k % 4 != 1).alias("complete"), issues.alias("schema_issues"))
    works = c.select(F.col("c_custkey").alias("material_id"), (F.col("c_custkey") % 5 - 1).alias("target_count"), (F.col("c_custkey") % 7 - 2).alias("failed_count"))
    return ql.profile_quality(works, profiles, profiles.where("name % 2 = 0 and material_id % 3 > 0").select("material_id", "name"))
