"""Registered queries: chapter records, tags, seeds, gates and rankings without a query, by their full rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium import fixtures as fx
from scriptorium.operators import chapter_rules as cr
from scriptorium.operators import quality as ql
from scriptorium.operators import statistics as st
from scriptorium.operators.statistics import ROLES
from scriptorium.plans.quality import ISSUES, RANK, issues
from scriptorium.registry import query
from scriptorium.sources import tables as tb
from scriptorium.sources.shared import new_path

#: Lengths of summaries, and values of closed sets with one that is none of them and a null, dealt by the chapter's key.
LENGTHS = (10, 30, 45, 60, 201, 501, 80)
HOOKS, PACINGS, CHANGES, POINTS = (*cr.HOOKS, "其他", None), (*cr.PACINGS, "飞快", None), (*cr.CHANGES, "乱", None), (*ROLES, "other", None)


def dealt(values: tuple, key: str = "chapter_key"):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(key) % len(values) + 1).cast("int"))


def dealt_sql(values: tuple, key: str = "chapter_key") -> str:
    listed = ", ".join("null" if v is None else repr(v) for v in values)
    return f"(array[{listed}])[{key} % {len(values)} + 1]"


def chapter_records(spark, sf) -> DataFrame:
    """Orders as records of chapters."""
    k = F.col("chapter_key")
    return fx.order_chapters(spark, sf).select(
        "material_id", "chapter", "chapter_key", "type", F.repeat(F.lit("字"), dealt(LENGTHS)).alias("summary"), F.when(k % 17 == 0, 7).when(k % 19 != 0, F.col("tension_level")).alias("tension_level"),
        F.when(k % 23 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("a"))).alias("characters"), F.when(k % 29 != 0, F.array("function")).alias("functions"), dealt(HOOKS).alias("hook_type"), dealt(PACINGS).alias("pacing"),
        dealt(CHANGES).alias("tension_change"), F.repeat(F.lit("e"), (k % 11).cast("int")).alias("emotion_transition"), F.repeat(F.lit("p"), (k % 16).cast("int")).alias("plot_progress"), dealt(POINTS).alias("key_plot_point"),
    )


RECORDS = f"""{fx.ORDER_CHAPTERS}, rec0 as (select material_id, chapter, chapter_key, type, {dealt_sql(LENGTHS)} as n, case when chapter_key % 17 = 0 then 7 when chapter_key % 19 <> 0 then tension_level end as t, {dealt_sql(HOOKS)} as hook, {dealt_sql(PACINGS)} as pacing,
 {dealt_sql(CHANGES)} as change, chapter_key % 11 as e, chapter_key % 16 as p, {dealt_sql(POINTS)} as point, type = 'afterword' as special from oc), rec as (select *, lag(t) over (partition by material_id order by chapter) as before from rec0)"""
BROKEN = {
    "error:summary_short": "n < case when special then 20 else 50 end", "error:summary_beyond_contract": "n > 500", "warning:summary_long": "n > 200", "warning:no_functions": "chapter_key % 29 = 0", "error:analysis_summary_short": "n < case when special then 20 else 40 end",
    "error:tension_range": "not special and t not between 1 and 5", "error:no_characters": "not special and chapter_key % 23 = 0", "error:hook_type": "hook = '其他'", "error:pacing": "pacing = '飞快'", "error:key_plot_point": "point = 'other'", "error:tension_change": "change = '乱'",
    "error:tension_change_differs": "change <> case when t > before then '上升' when t < before then '下降' when t = before then '持平' end", "error:emotion_transition_short": "e between 1 and 4", "error:plot_progress_short": "p between 1 and 9",
}


@query(f"with {RECORDS} " + " union all ".join(f"select material_id, chapter, '{rule.split(':')[0]}' as severity, '{rule.split(':')[1]}' as code from rec where {bad}" for rule, bad in BROKEN.items()))
def chapter_record_issues(spark, sf):
    """DQ2, DQ6, DQ8, WN4: all rules of chapter records, with the limits of special chapters, labels and closed sets."""
    return cr.chapter_issues(chapter_records(spark, sf))


TAG_USES = "u as (select p_partkey, case when p_partkey % 2 = 0 then 'work' else 'chapter' end as scope, p_type as dimension, case when p_partkey % 9 = 0 then 'no ' || p_name when p_partkey % 31 <> 0 then p_name end as tag from part)"


def tag_uses(spark, sf) -> DataFrame:
    k = F.col("p_partkey")
    tag = F.when(k % 9 == 0, F.concat(F.lit("no "), "p_name")).when(k % 31 != 0, F.col("p_name"))
    return fx.read(spark, sf, "part").select("p_partkey", F.when(k % 2 == 0, "work").otherwise("chapter").alias("scope"), F.col("p_type").alias("dimension"), tag.alias("tag"))


@query(f"with {fx.TAGS}, {TAG_USES} select p_partkey, scope, dimension, tag, case when scope = 'work' then 'error' else 'warning' end as severity from u where tag is not null and not exists (select 1 from tg where tg.dimension = u.dimension and tg.tag = u.tag)")
def tag_whitelist(spark, sf):
    """DQ5: tags that the dictionary lacks, errors on works and warnings on chapters."""
    return cr.unknown_tags(tag_uses(spark, sf), fx.tags(spark, sf))


@query(f"with {fx.TAGS}, {TAG_USES} select p_partkey + 500000 as id, 'row' as state, p_name as value from part where p_partkey % 3 = 1 union all select p_partkey + 500000, case when scope = 'work' then 'error' else 'warning' end, tag from u where p_partkey % 3 = 1 and tag is not null and not exists (select 1 from tg where tg.dimension = u.dimension and tg.tag = u.tag)")
def checked_import(spark, sf):
    """SK6: rows under new ids, and the tags among them that the dictionary lacks."""
    k = F.col("p_partkey")
    ids = fx.read(spark, sf, "part").where(k % 3 == 1).select(k.alias("old_id"), (k + 500_000).alias("new_id"))
    rows, unknown = cr.imported(fx.read(spark, sf, "part").select("p_partkey", "p_name"), ids, "p_partkey", tag_uses(spark, sf), fx.tags(spark, sf))
    return rows.select(k.alias("id"), F.lit("row").alias("state"), F.col("p_name").alias("value")).union(unknown.select(k, "severity", "tag"))


MINED = "w as (select source, doc_id, lower(unnest(regexp_extract_all(text, '[\\p{L}]+'))) as w from documents), o as (select source as material_id, doc_id, case when w like '%tion' then 'organization' when w like '%ing' then 'location' end as type, case when w like '%tion' then left(w, length(w) - 4) when w like '%ing' then left(w, length(w) - 3) end as name from w), m as (select * from o where length(name) >= 4)"


@query(f"with {MINED}, x as (select distinct material_id, type, name from m where doc_id % 50 = 0) select material_id, type, name, count(*) as n, case when count(*) >= 10 then 'primary' else 'secondary' end as importance, 0.45::double as confidence from m where not exists (select 1 from x where x.material_id = m.material_id and x.type = m.type and x.name = m.name) group by 1, 2, 3 having count(*) >= 5")
def seeded_entities(spark, sf):
    """AG6, AG7: entities from mined names, primary from ten occurrences, without those that are known: the names in every
    fiftieth document."""
    words = fx.read(spark, sf, "documents").select(F.col("source").alias("material_id"), "doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), 0)).alias("w"))
    kind = F.when(F.col("w").endswith("tion"), "organization").when(F.col("w").endswith("ing"), "location")
    name = F.when(kind == "organization", F.expr("left(w, length(w) - 4)")).otherwise(F.expr("left(w, length(w) - 3)"))
    mined = words.select("material_id", "doc_id", kind.alias("type"), name.alias("name")).where("type is not null and length(name) >= 4")
    known = mined.where("doc_id % 50 = 0").select("material_id", "type", "name").distinct()
    return cr.seed_entities(mined.groupBy("material_id", "type", "name").agg(F.count("*").alias("n")), known)


WORDS = ("战斗", "日常", "推进", None)


@query(f"with {fx.ORDER_CHAPTERS}, r as (select chapter_key, case when chapter_key % 3 = 0 then '喘息' end as pacing, case when chapter_key % 5 <> 0 then tension_level end as t, {dealt_sql(WORDS)} as w from oc) select chapter_key, coalesce(pacing, case when t >= 4 or w = '战斗' then '快' when t <= 2 or w = '日常' then '慢' else '中' end) as pacing, case when pacing is null then 'pacing' end as fields, case when pacing is null then 'tension_level, functions' end as reason from r")
def pacing_recovery(spark, sf):
    """FN15: missing pacing filled from tension and functions, and marked."""
    k = F.col("chapter_key")
    rows = fx.order_chapters(spark, sf).select("chapter_key", F.when(k % 3 == 0, "喘息").alias("pacing"), F.when(k % 5 != 0, F.col("tension_level")).alias("tension_level"), F.when(dealt(WORDS).isNotNull(), F.array(dealt(WORDS))).alias("functions"))
    return cr.recovered_pacing(rows).select("chapter_key", "pacing", F.array_join("fallback_fields", ",").alias("fields"), F.col("fallback_reason").alias("reason"))


@query(f"""with {fx.TURNS}, r as (select material_id, chapter, row_number() over (partition by material_id order by chapter) as place, list_distinct(regexp_extract_all(summary, '(?s).')) as c from tn where type <> 'system' and length(summary) > 0),
 s as (select a.material_id, a.chapter as first, b.chapter as second, round(len(list_intersect(a.c, b.c)) / len(list_distinct(list_concat(a.c, b.c))), 6) as similarity from r a join r b on a.material_id = b.material_id and b.place - a.place between 1 and 10),
 n as (select *, row_number() over (partition by material_id order by second, first) as nth from s where similarity > 0.7) select material_id, first, second, similarity, cast(nth as int) as nth from n where nth <= 4""")
def near_duplicate_limited(spark, sf):
    """DQ7: the first four warnings of a work; turns of the system are special chapters."""
    kind = F.when(F.col("type") == "system", "author_note").otherwise("normal")
    return cr.near_duplicate_warnings(fx.turns(spark, sf).withColumn("type", kind), most=4).select("material_id", "first", "second", "similarity", "nth")


@query(f"with {ISSUES}, r as (select *, row_number() over (partition by material_id order by {RANK}, code, artifact, message) as n, case when material_id % 3 = 0 then 'dismissed' end as d from iss), v as (select material_id, n > 2 as over, case when n <= 2 and d = 'dismissed' then 'info' else severity end as s from r), c as (select material_id, sum((s = 'blocker')::int) as blocker, sum((s = 'error')::int) as error, sum((s = 'warning')::int) as warning, sum((s = 'info')::int) as info, sum(over::int) as not_reviewed from v group by 1) select *, case when blocker > 0 then 'failed' when error > 0 then 'degraded' else 'success' end as status from c")
def audit_summaries(spark, sf):
    """AG13, AU9: issues by severity after review, those that the budget left out, and the state of the run."""
    own = issues(spark, sf)
    decision = F.when(F.col("material_id") % 3 == 0, "dismissed")
    return cr.audit_summaries(ql.apply_reviews(own, own.select("material_id", "code", decision.alias("decision")).distinct(), 2))


STAGES, STATUSES, MODES = (*cr.CORE_STAGES, *cr.HOLD_STAGES, "tags", "profile"), ("success", "success", "success", "degraded", "success", "success", "failed"), ("quick", "standard", "deep")
GATE = f"""st as (select distinct o_custkey as material_id, {dealt_sql(STAGES, 'o_orderkey')} as stage, {dealt_sql(STATUSES, '(o_orderkey // 7)')} as status from orders),
 w as (select c_custkey as material_id, {dealt_sql(MODES, 'c_custkey')} as mode, c_custkey % 2 = 0 as allowed, c_custkey % 41 = 0 as blocker, c_custkey % 37 = 0 as error from customer),
 f as (select material_id, string_agg(distinct stage || '_failed', ',' order by stage || '_failed') filter (status = 'failed' and stage in {cr.CORE_STAGES}) as failed, string_agg(distinct stage || '_degraded', ',' order by stage || '_degraded') filter (status = 'degraded' and stage in {cr.HOLD_STAGES}) as held, sum((stage = 'profile')::int) as np, sum((stage = 'profile' and status = 'failed')::int) as bp from st group by 1),
 r as (select w.*, concat_ws(',', failed, case when blocker then 'audit_blocker' end, case when error then 'audit_error' end, case when mode <> 'quick' and coalesce(np, 0) = 0 then 'profile_missing' end, case when mode <> 'quick' and bp > 0 then 'profile_failed' end) as bad, coalesce(held, '') as held from w left join f using (material_id))
 select material_id, case when bad <> '' then 'block' when held <> '' and not allowed then 'hold' else 'allow' end as decision, case when bad <> '' then 'failed' when held <> '' then 'degraded' else 'success' end as release_status, bad = '' and held <> '' and allowed as override, case when bad <> '' then bad else held end as reasons from r"""


@query(f"with {GATE}")
def release_decisions(spark, sf):
    """AG26: block, hold or allow with all reasons, and the override of degraded stages."""
    c = F.col("c_custkey")
    customers = fx.read(spark, sf, "customer")
    works = customers.select(c.alias("material_id"), dealt(MODES, "c_custkey").alias("mode"), (c % 2 == 0).alias("allow_degraded"))
    audits = customers.select(c.alias("material_id"), (c % 41 == 0).cast("int").alias("blocker"), (c % 37 == 0).cast("int").alias("error"))
    orders = fx.read(spark, sf, "orders").withColumn("o_turn", F.floor(F.col("o_orderkey") / 7).cast("long"))
    return cr.gate(works, orders.select(F.col("o_custkey").alias("material_id"), dealt(STAGES, "o_orderkey").alias("stage"), dealt(STATUSES, "o_turn").alias("status")), audits)


ENTRIES = ("outline", "characters", "worldbuilding", "tags")
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED")


@query(f"select c_custkey as material_id, a.name as artifact, 'error' as severity from customer, (values {', '.join(f'({e!r}, {p!r})' for e, p in zip(ENTRIES, PRIORITIES))}) a(name, priority) where c_acctbal > 0 and not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = a.priority)")
def finalised_artifacts(spark, sf):
    """AU6: finalised works that lack one of their four entry artifacts."""
    works = fx.read(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("material_id"))
    entry = F.create_map(*[F.lit(x) for pair in zip(PRIORITIES, ENTRIES) for x in pair])
    present = fx.read(spark, sf, "orders").select(F.col("o_custkey").alias("material_id"), F.try_element_at(entry, F.col("o_orderpriority")).alias("artifact")).distinct()
    return ql.missing_required(works, present, list(ENTRIES)).withColumn("severity", F.lit("error"))


@query("select c_custkey as material_id from customer c where c_custkey % 3 <> 0 or c_acctbal < 0")
def pending_works(spark, sf):
    """JO17: works that are not done, or done but invalid."""
    works = fx.read(spark, sf, "customer").select(F.col("c_custkey").alias("material_id"), "c_acctbal")
    done = works.where("material_id % 3 = 0")
    return cr.pending(works, done, done.where("c_acctbal < 0"), "material_id").select("material_id")


@query(f"""with {fx.APPEARANCES}, r as (
 select 'chapter' as kind, material_id::varchar as grp, chapter_key::varchar as id, row_number() over (partition by material_id order by case when chapter_key % 4 <> 0 then tension_level end desc nulls last, chapter, chapter_key::varchar) as rank from oc
 union all select 'character', material_id::varchar, name, row_number() over (partition by material_id order by count(*) desc, name) from ap group by material_id, name
 union all select 'outline', c_mktsegment, c_custkey::varchar, row_number() over (partition by c_mktsegment order by n desc nulls last, c_custkey::varchar) from customer left join (select o_custkey, count(*) as n from orders group by 1) on o_custkey = c_custkey
 union all select 'world', s_nationkey::varchar, s_suppkey::varchar, row_number() over (partition by s_nationkey order by case when s_suppkey % 3 > 0 then s_suppkey % 3 end nulls last, s_name, s_suppkey::varchar) from supplier
 union all select 'detail', l_orderkey::varchar, l_linenumber::varchar, row_number() over (partition by l_orderkey order by l_linenumber % 3, l_linenumber, l_linenumber::varchar) from lineitem) select kind, grp, id, cast(rank as int) as rank from r where rank <= 3""")
def structured_rankings(spark, sf):
    """TK4: what is shown without a query, in the order of each of five document types."""
    text = lambda name: F.col(name).cast("string")
    oc = fx.order_chapters(spark, sf)
    characters = fx.appearance_counts(spark, sf)
    n = fx.read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("chapter_count"))
    tables = {
        "chapter": oc.select(text("material_id").alias("grp"), text("chapter_key").alias("id"), F.when(F.col("chapter_key") % 4 != 0, F.col("tension_level")).alias("tension_level"), "chapter"),
        "character": characters.select(text("material_id").alias("grp"), F.col("name").alias("id"), F.col("n").alias("appearance_count")),
        "outline": fx.read(spark, sf, "customer").join(n, "c_custkey", "left").select(F.col("c_mktsegment").alias("grp"), text("c_custkey").alias("id"), "chapter_count"),
        "world": fx.read(spark, sf, "supplier").select(text("s_nationkey").alias("grp"), text("s_suppkey").alias("id"), F.nullif(F.col("s_suppkey") % 3, F.lit(0)).alias("importance"), F.col("s_name").alias("name")),
        "detail": fx.read(spark, sf, "lineitem").select(text("l_orderkey").alias("grp"), text("l_linenumber").alias("id"), (F.col("l_linenumber") % 3).alias("act"), F.col("l_linenumber").alias("sequence")),
    }
    sizes = {"chapter": "orders", "character": "lineitem", "detail": "lineitem"}  # the others have few groups, which Spark limits first
    out = None
    for kind, rows in tables.items():
        rows = st.spread(rows, "grp", fx.read(spark, sf, sizes[kind]).count()) if kind in sizes else rows
        own = cr.structured_ranking(rows, kind, "grp", 3).select(F.lit(kind).alias("kind"), "grp", "id", "rank")
        out = own if out is None else out.union(own)
    return out


@query("select c_nationkey, array_agg(c_custkey order by c_custkey)[1] as first, count(*) as n, string_agg(c_name, '|' order by c_custkey) as names from customer group by 1")
def multiline_catalogue(spark, sf):
    """SC5: catalogue files of one array each, over many lines, read with a fixed schema."""
    path = new_path(spark, "catalogue")
    c = fx.read(spark, sf, "customer").select("c_nationkey", "c_custkey", F.to_json(F.struct("c_custkey", "c_name")).alias("value"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "value"))), lambda x: x["value"]), ",\n  ")
    files = c.groupBy("c_nationkey").agg(F.concat(F.lit("[\n  "), body, F.lit("\n]")).alias("value"))
    files.write.partitionBy("c_nationkey").option("maxRecordsPerFile", 1).text(path)
    rows = tb.read_catalogue(spark, path, "c_nationkey int, c_custkey long, c_name string")
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))), lambda x: x["c_name"]), "|")
    return rows.groupBy("c_nationkey").agg(F.min("c_custkey").alias("first"), F.count("*").alias("n"), names.alias("names"))


@query(f"""with {fx.ORDER_CHAPTERS}, a as (select material_id, string_agg(chapter || ':' || function, ',' order by chapter) as chapters from oc where chapter <= 80 group by 1),
 l as (select o_custkey as material_id, l_suppkey, p_brand from orders join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey),
 b as (select material_id, string_agg(p_brand || ':' || n, ',' order by n desc, p_brand) as characters from (select *, row_number() over (partition by material_id order by n desc, p_brand) as r from (select material_id, p_brand, count(*) as n from l group by 1, 2)) where r <= 50 group by 1),
 e as (select material_id, string_agg(l_suppkey || ':' || n, ',' order by n desc, l_suppkey) as entities from (select *, row_number() over (partition by material_id order by n desc, l_suppkey) as r from (select material_id, l_suppkey, count(*) as n from l group by 1, 2)) where r <= 80 group by 1)
 select c_custkey as material_id, coalesce(chapters, '') as chapters, coalesce(characters, '') as characters, coalesce(entities, '') as entities from customer left join a on a.material_id = c_custkey left join b on b.material_id = c_custkey left join e on e.material_id = c_custkey""")
def work_contexts(spark, sf):
    """AG32: a record for each work: its first chapters, most frequent characters and most frequent entities, as arrays."""
    joined = lambda column: F.array_join(F.transform(column, lambda x: F.concat_ws(":", x["name"].cast("string"), x["told"].cast("string"))), ",")
    first = lambda rows, order, k, name: rows.withColumn("r", F.row_number().over(Window.partitionBy("material_id").orderBy(*order))).where(F.col("r") <= k).groupBy("material_id").agg(F.array_sort(F.collect_list(F.struct("r", "name", "told"))).alias(name))
    lines = fx.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey", F.col("l_partkey").alias("p_partkey"))
    own = lines.join(fx.read(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("material_id")), "o_orderkey").join(fx.read(spark, sf, "part").select("p_partkey", "p_brand"), "p_partkey")
    counted = lambda name: own.groupBy("material_id", F.col(name).alias("name")).agg(F.count("*").alias("told"))
    chapters = first(fx.order_chapters(spark, sf).select("material_id", F.col("chapter").alias("name"), F.col("function").alias("told")), [F.asc("name")], 80, "chapters")
    most = [F.desc("told"), F.asc("name")]
    works = fx.read(spark, sf, "customer").select(F.col("c_custkey").alias("material_id"))
    for side in (chapters, first(counted("p_brand"), most, 50, "characters"), first(counted("l_suppkey"), most, 80, "entities")):
        works = works.join(side, "material_id", "left")
    return works.select("material_id", *[F.coalesce(joined(F.col(c)), F.lit("")).alias(c) for c in ("chapters", "characters", "entities")])
