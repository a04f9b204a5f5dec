"""Registered queries: contracts of nested records and the audit rules, on records made of the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scriptorium import fixtures as fx
from scriptorium.operators import audit_rules as ar
from scriptorium.operators import contracts as ct
from scriptorium.operators import quality as ql
from scriptorium.registry import query


def union_sql(source: str, keys: str, rules: dict[str, str]) -> str:
    return " union all ".join(f"select {keys}, '{rule}' as rule from {source} where {bad}" for rule, bad in rules.items())


@query(union_sql("(select c_custkey as k, c_custkey as material_id, case when c_custkey % 17 = 0 then 'x' when c_custkey % 2 = 0 then '2.0.1' else '3.0.0' end as v from customer)", "material_id", {
    "version": "v = 'x'", "types": "k % 5 = 0", "total": "k % 3 <> 0 and k % 7 = 0", "stages": "k % 11 <> 0 and k % 6 = 0", "no_total": "v = '2.0.1' and k % 3 = 0", "no_hint": "v = '2.0.1' and k % 4 = 0",
    "no_stages": "v = '2.0.1' and k % 11 = 0", "sample_fields": "v = '3.0.0' and k % 13 in (0, 1)",
}))
def navigation_contract(spark, sf):
    """DQ4: navigation records of two versions."""
    k = F.col("c_custkey")
    stages = lambda n: F.map_from_entries(F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(i, F.lit("s"))))
    sample = F.create_map(*[F.lit(x) for f in ct.SAMPLE_FIELDS for x in (f, "v")])
    records = fx.read(spark, sf, "customer").select(
        k.alias("material_id"), F.when(k % 17 == 0, "x").when(k % 2 == 0, "2.0.1").otherwise("3.0.0").alias("schema_version"), F.array("c_mktsegment", F.when(k % 5 == 0, " ").otherwise("other")).alias("novel_type"),
        F.when(k % 3 != 0, k % 7).alias("total_chapters"), F.when(k % 4 != 0, F.array("c_name")).alias("core_characters_hint"), F.when(k % 11 != 0, stages(F.when(k % 6 == 0, 4).otherwise(5))).alias("stage_summaries"),
        F.when(k % 13 != 0, F.map_filter(sample, lambda f, _: ~((k % 13 == 1) & (f == "limitations")))).alias("sample_coverage"),
    )
    return ct.navigation_violations(records)


INSIGHT = "(select *, doc_id as insight_id, case when lang = 'en' then 50 else 100 end as lo, case when lang = 'en' then 500 end as hi, least(length(text), case when doc_id % 3 = 0 then 130 else 100 end) as el from documents)"


@query(union_sql(INSIGHT, "insight_id", {
    "missing:theme": "text is null or trim(text) = ''", "short:theme": "trim(text) <> '' and length(text) < lo", "long:theme": "length(text) > hi", "short:hook": "lang = 'en' and length(source) < 5", "version": "doc_id % 19 = 0",
    "no_evidence": "doc_id % 23 = 0", "evidence_part": "doc_id % 23 <> 0 and (doc_id % 29 = 0 or trim(substr(text, 1, 130)) = '')", "evidence_long": "doc_id % 23 <> 0 and el > 120", "confidence": "doc_id % 12 = 11",
}))
def insight_contract(spark, sf):
    """DQ9: insights against the required fields of their profile."""
    d, i = fx.read(spark, sf, "documents"), F.col("doc_id")
    langs = d.select(F.col("lang").alias("profile")).where("profile is not null").distinct()
    field = lambda name, least, most: f"named_struct('f', '{name}', 'a', {least}, 'b', cast({most} as int))"
    required = f"inline(if(profile = 'en', array({field('theme', 50, 500)}, {field('hook', 5, 'null')}), array({field('theme', 100, 'null')}))) as (field, min_length, max_length)"
    evidence = F.array(F.struct(F.when(i % 29 == 0, "").otherwise("theme").alias("field"), F.lit("s").alias("source"), F.substring("text", F.lit(1), F.when(i % 3 == 0, 130).otherwise(100)).alias("text")))
    insights = d.select(
        i.alias("insight_id"), F.col("lang").alias("profile"), F.when(i % 19 == 0, "0.9").otherwise("1.0").alias("schema_version"), F.create_map(F.lit("theme"), "text", F.lit("hook"), "source").alias("values"),
        F.when(i % 23 == 0, F.slice(evidence, 1, 0)).otherwise(evidence).alias("evidence"), ((i % 12) / 10).alias("confidence"),
    )
    return ct.insight_violations(insights, langs.selectExpr("profile", required))


OUTLINE = "(select o_custkey as material_id, k as act, n, k + o_orderkey % 3 as e, k + 1 - (case when o_orderkey % 5 = 0 then 2 else 0 end) as s2, k + o_orderkey % 4 as b, 6 - cast(substr(o_orderpriority, 1, 1) as int) + (case when o_orderkey % 6 = 0 then 3 else 0 end) as t from (select *, cast(row_number() over (partition by o_custkey order by o_orderkey) as int) as k, count(*) over (partition by o_custkey) as n from orders))"


@query(
    f"select material_id, act, null as sequence, 'act_range' as rule from {OUTLINE} where e > n union all select material_id, act, 1, 'sequence_range' from {OUTLINE} where act > n union all select material_id, act, 2, 'sequence_range' from {OUTLINE} where not (1 <= s2 and s2 <= e and e <= n) union all select material_id, act, 1, 'beat_chapter' from {OUTLINE} where b <> act union all select material_id, act, 1, 'beat_tension' from {OUTLINE} where t not between 1 and 5"
)
def range_contract(spark, sf):
    """DQ10: ranges of acts, sequences and beats."""
    w = Window.partitionBy("o_custkey")
    k, o = F.col("k"), F.col("o_orderkey")
    rows = fx.read(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", F.row_number().over(w.orderBy("o_orderkey")).alias("k"), F.count("*").over(w).alias("n"))
    end = (k + o % 3).cast("int")
    beat = F.struct((k + o % 4).cast("int").alias("chapter"), (6 - F.substring("o_orderpriority", 1, 1).cast("int") + F.when(o % 6 == 0, 3).otherwise(0)).alias("tension"))
    sequence = lambda n, a, b, beats: F.struct(F.lit(n).alias("sequence_number"), a.cast("int").alias("chapter_start"), b.cast("int").alias("chapter_end"), beats.alias("beats"))
    second = k + 1 - F.when(o % 5 == 0, 2).otherwise(0)
    act = F.struct(k.alias("act_number"), k.alias("chapter_start"), end.alias("chapter_end"), F.array(sequence(1, k, k, F.array(beat)), sequence(2, second, end, F.slice(F.array(beat), 1, 0))).alias("sequences"))
    outlines = rows.groupBy(F.col("o_custkey").alias("material_id"), F.col("n").alias("chapter_count")).agg(F.collect_list(act).alias("acts"))
    return ct.range_violations(outlines)


@query("select event_id, case when event_id % 10 in (0, 1, 2) then null else cast(json_extract_string(props, '$.k') as bigint) end as k, case when event_id % 10 in (0, 1, 2) then 'invalid' else 'ok' end as state from events")
def record_contract(spark, sf):
    """DQ11: typed records from JSON that may be no object, of another type, or broken off."""
    e = F.col("event_id") % 10
    payload = F.when(e == 0, "[1, 2]").when(e == 1, '{"k": "x"}').when(e == 2, '{"k": ').otherwise(F.col("props"))
    rows = fx.read(spark, sf, "events").select("event_id", ct.typed(payload, "k long").alias("r"))
    return rows.select("event_id", F.when(F.col("r.bad").isNull(), F.col("r.k")).alias("k"), F.when(F.col("r.bad").isNull(), "ok").otherwise("invalid").alias("state"))


PEOPLE = "(select o_custkey as material_id, o_orderpriority as name, o_custkey + cast(substr(o_orderpriority, 1, 1) as int) as h from orders group by all)"


@query(
    f"select material_id, name, case when h % 5 = 0 then 'missing' when h % 11 = 0 or h % 7 = 0 or h % 9 = 0 then 'invalid' else 'valid' end as state, case when h % 5 = 0 then null when h % 11 = 0 then 'type' when h % 7 = 0 then 'role' when h % 9 = 0 then 'habits' end as issue from {PEOPLE} union all select material_id, 'stranger ' || name, 'invalid', 'name' from {PEOPLE} where h % 13 = 0"
)
def biography_records(spark, sf):
    """DQ12: biography records of the candidates: valid, invalid with the issue, missing; unknown names are rejected."""
    h = F.col("h")
    people = fx.read(spark, sf, "orders").select(F.col("o_custkey").alias("material_id"), F.col("o_orderpriority").alias("name")).distinct()
    people = people.withColumn("h", F.col("material_id") + F.substring("name", 1, 1).cast("int"))
    confidence = F.when(h % 11 == 0, '"high"').otherwise("0.5")
    one = F.concat(F.lit('{"name": "'), F.col("name"), F.lit('", "role": "'), F.when(h % 7 == 0, " ").otherwise("lead"), F.lit('", "confidence": '), confidence, F.when(h % 9 == 0, "").otherwise(', "habits": []'), F.lit("}"))
    known = people.where(h % 5 != 0).select("material_id", one.alias("one"))
    strangers = people.where(h % 13 == 0).select("material_id", F.concat(F.lit('{"name": "stranger '), "name", F.lit('", "role": "r", "confidence": 1, "habits": []}')))
    payloads = known.union(strangers).groupBy("material_id").agg(F.concat(F.lit("["), F.array_join(F.collect_list("one"), ","), F.lit("]")).alias("payload"))
    return ct.biography_split(payloads, people.select("material_id", "name"))


@query(union_sql("(select o_custkey as material_id, count(*) as n, sum((o_orderstatus = 'P')::int) as p from orders group by 1)", "material_id", {"quality": "n % 4 = 0", "confidence": "n % 13 > 10", "evidence": "p = 0 and n % 2 = 1 and n % 3 = 0"}))
def summary_contract(spark, sf):
    """DQ13: work summaries."""
    n = F.col("n")
    one = fx.read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("material_id")).agg(F.count("*").alias("n"), F.collect_list(F.when(F.col("o_orderstatus") == "P", F.col("o_orderkey"))).alias("chapters"))
    people, entities = F.when(n % 2 == 0, F.array(F.lit("a"))), F.when(n % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("e")))
    summaries = one.select("material_id", F.when(n % 4 == 0, "partial").when(n % 2 == 0, "limited").otherwise("full").alias("quality_level"), ((n % 13) / 10).alias("confidence"), F.struct("chapters", people.alias("characters"), entities.alias("entities")).alias("evidence"))
    return ct.summary_violations(summaries)


LEVEL = "case o_orderkey % 6 when 0 then 'brief' when 1 then 'fallback' when 2 then 'partial' when 3 then 'enriched' when 4 then 'full' else '' end"
ROLE = "case when substr(o_orderpriority, 1, 1) = '1' then 'protagonist' when substr(o_orderpriority, 1, 1) = '2' then 'antagonist' when substr(o_orderpriority, 1, 1) = '3' then 'supporting' else 'minor' end"
AUDIT_SQL = f"""with p as (select o_custkey as material_id, o_orderkey as k, {LEVEL} as lv, {ROLE} as role, o_totalprice from orders),
 pf as (select *, lv = 'brief' and k % 9 = 0 as bare, role in ('protagonist', 'antagonist') as lead, k % 5 = 0 or (lv = 'full' and k % 3 <> 0) or k % 7 = 0 as lacking from p),
 pc as (select *, case when lv = 'brief' then case when bare then 'fallback:warning' end when lv = 'fallback' then case when lead then 'fallback:error' else 'fallback:warning' end when lv = 'partial' then 'partial:warning'
  when lv = 'enriched' then case when k % 4 = 0 then 'partial:info' end when (lead or lv = 'full' or role = 'supporting') and lacking then case when lead or lv = 'full' then 'fallback:error' else 'fallback:warning' end end as code from pf),
 tg as (select material_id, count(*) as n, sum((lv = 'full' and k % 3 = 0)::int) as d from p where o_totalprice > 200000 group by 1),
 w as (select c_custkey as material_id, c_custkey as k, c_custkey % 3 = 0 as layered, c_custkey % 2 = 0 as ok from customer),
 en as (select w.*, (select count(*) from p where p.material_id = w.material_id) as n from w where layered),
 dm as (select *, k % 4 as wanted, case when k % 8 < 4 then k % 4 else 0 end as lost from en where k % 4 > 0 and k % 5 <> 0 and n = 0)
 select material_id, 'coverage' as code, 'blocker' as severity, 'chapters' as artifact, 'missing ' || count(*) as message from p where k % 10 = 0 group by 1
 union all select material_id, 'profile', split_part(code, ':', 2), k::varchar, split_part(code, ':', 1) from pc where code is not null
 union all select material_id, 'targets', 'error', 'targets', d || '/' || n from tg where d < n
 union all select material_id, 'legacy', 'error', 'world', 'empty' from w where not layered and not ok and k % 5 = 0
 union all select material_id, 'legacy', 'warning', 'world', 'without evidence' from w where not layered and k % 7 = 0
 union all select material_id, 'layered', 'error', 'world', 'empty' from dm where not ok and lost = wanted
 union all select material_id, 'layered', 'warning', 'dimensions', 'without support' from dm where ok or lost < wanted
 union all select o_custkey, 'layered', 'warning', o_orderkey::varchar, 'without evidence' from orders where o_custkey % 3 = 0 and o_orderstatus = 'F' and o_orderkey % 3 = 0
 union all select o_custkey, 'layered', 'error', o_orderkey::varchar, 'unknown end' from orders where o_custkey % 3 = 0 and o_orderkey % 2 = 1"""


@query(AUDIT_SQL)
def audit_rules(spark, sf):
    """AU2-AU5: coverage, profiles and their targets, worlds of the old and the new layout."""
    orders, customers = fx.read(spark, sf, "orders"), fx.read(spark, sf, "customer")
    o, k = F.col("o_orderkey"), F.col("material_id")
    own = orders.withColumn("material_id", F.col("o_custkey"))
    digit = F.substring("o_orderpriority", 1, 1)
    level = F.element_at(F.array(*[F.lit(x) for x in ("brief", "fallback", "partial", "enriched", "full")], F.lit(None)), (o % 6 + 1).cast("int"))
    bare = (o % 6 == 0) & (o % 9 == 0)
    profiles = own.select(
        "material_id", o.alias("profile"), F.when(~bare, o.cast("string")).alias("name"), F.when(~bare, F.when(digit == "1", "protagonist").when(digit == "2", "antagonist").when(digit == "3", "supporting").otherwise("minor")).alias("role"),
        level.alias("profile_level"), F.when(o % 4 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("schema_issues"), F.when(o % 5 != 0, "a").alias("arc_summary"), F.lit("p").alias("psychology"),
        F.lit("r").alias("relationships"), (o % 3 == 0).alias("biography_complete"), F.when(~bare, F.when(o % 7 == 0, "出场 12 章，为主要角色之一。").otherwise("d")).alias("description"),
    )
    count = lambda name, n: F.when(~F.lit(name == "evidence") | (k % 7 != 0), n).alias(name)
    worlds = customers.select(F.col("c_custkey").alias("material_id")).select(
        "material_id", F.when(k % 3 == 0, "layered").otherwise("legacy").alias("layout"), (k % 2 == 0).alias("succeeded"), (k % 5 == 0).alias("driving"), *[(k % 5).alias(c) for c in ("levels", "regions", "factions", "lore")],
        *[F.lit(None).cast("long").alias(c) for c in ("dimensions", "entities", "relations")], count("evidence", F.lit(1)),
    )
    status = F.when(k % 8 < 4, "missing").otherwise("ready")
    tables = {
        "chapters": own.select("material_id", o.alias("chapter")), "analysed": own.where(o % 10 != 0).select("material_id", o.alias("chapter")), "profiles": profiles, "worlds": worlds,
        "targets": own.where("o_totalprice > 200000").select("material_id", o.cast("string").alias("name")),
        "dimensions": worlds.where(k % 4 > 0).select("material_id", F.explode(F.sequence(F.lit(1), (k % 4).cast("int"))).alias("dimension"), F.lit(True).alias("applicable"), status.alias("status")),
        "entities": own.select("material_id", o.alias("id"), F.when(F.col("o_orderstatus") == "F", "primary").otherwise("minor").alias("importance"), (o % 3).alias("evidence")),
        "relations": own.select("material_id", o.alias("relation"), o.alias("source"), (o + (o % 2) * 1_000_000_000).alias("target")),
    }
    return ql.audit(tables, ar.RULES)
