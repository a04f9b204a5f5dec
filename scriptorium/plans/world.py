"""Registered queries: entities, relations, records."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium import fixtures as fx
from scriptorium.functions import text as tx
from scriptorium.operators import world as wd
from scriptorium.registry import query

ENTITIES = "en as (select 's' || s_suppkey as entity_id, s_name as name, 'supplier' as type from supplier union all select 'n' || n_nationkey, n_name, 'nation' from nation where n_nationkey % 4 <> 3)"
EDGES = "ed as (select 's' || s_suppkey as source_id, 'n' || s_nationkey as target_id from supplier union all select 'n' || n_nationkey, 'r' || n_regionkey from nation)"


def entities(spark, sf):
    s, n = fx.read(spark, sf, "supplier"), fx.read(spark, sf, "nation").where("n_nationkey % 4 <> 3")
    own = s.select(F.concat(F.lit("s"), "s_suppkey").alias("entity_id"), F.col("s_name").alias("name"), F.lit("supplier").alias("type"))
    return own.union(n.select(F.concat(F.lit("n"), "n_nationkey"), "n_name", F.lit("nation")))


def edges(spark, sf):
    s, n = fx.read(spark, sf, "supplier"), fx.read(spark, sf, "nation")
    own = s.select(F.concat(F.lit("s"), "s_suppkey").alias("source_id"), F.concat(F.lit("n"), "s_nationkey").alias("target_id"))
    return own.union(n.select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey")))


@query(f"with {ENTITIES}, {EDGES} select source_id, target_id from ed where source_id in (select entity_id from en) and target_id in (select entity_id from en)")
def surviving_edges(spark, sf):
    """JO11."""
    return wd.split_edges(edges(spark, sf), entities(spark, sf))[0]


@query(f"with {ENTITIES}, {EDGES}, m as (select *, concat_ws(',', case when source_id not in (select entity_id from en) then 'source' end, case when target_id not in (select entity_id from en) then 'target' end) as missing from ed) select * from m where missing <> ''")
def rejected_edges(spark, sf):
    """JO10, AU5: edges with an unknown end."""
    return wd.split_edges(edges(spark, sf), entities(spark, sf))[1]


@query(f"with {EDGES}, b as (select source_id as entity_id, '> ' || target_id as line from ed union all select target_id, '< ' || source_id from ed where source_id <> target_id), r as (select *, row_number() over (partition by entity_id order by line) as n, count(*) over (partition by entity_id) as degree from b) select entity_id, string_agg(line, '; ' order by line) as relations, max(degree) as degree from r where n <= 5 group by 1")
def relation_summaries(spark, sf):
    """AG22."""
    return wd.relation_summaries(edges(spark, sf))


@query(f"with {ENTITIES}, {EDGES} select type, count(*) as entities, sum((select count(*) from ed where source_id = entity_id)) as edges from en group by 1")
def world_counts(spark, sf):
    """AG20."""
    n = edges(spark, sf).groupBy(F.col("source_id").alias("entity_id")).agg(F.count("*").alias("n"))
    return entities(spark, sf).join(n, "entity_id", "left").groupBy("type").agg(F.count("*").alias("entities"), F.sum(F.coalesce("n", F.lit(0))).alias("edges"))


@query("select n_name as source_name, r_name as target_name, min(s.n_nationkey) as source_id, min(case when r_name = 'ASIA' then null else r_regionkey end) as target_id from nation s join region on n_regionkey = r_regionkey group by 1, 2")
def endpoint_resolution(spark, sf):
    """JO10: names of ends to ids, unknown ones null."""
    n, r = fx.read(spark, sf, "nation"), fx.read(spark, sf, "region")
    e = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("source_name"), F.col("r_name").alias("target_name"))
    known = n.select(F.col("n_nationkey").alias("entity_id"), F.col("n_name").alias("name")).union(r.where("r_name <> 'ASIA'").select("r_regionkey", "r_name"))
    return wd.resolve_names(e, known)


@query("select s_suppkey, 'supplier_' || regexp_replace(regexp_replace(lower(s_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') as slug from supplier")
def entity_slugs(spark, sf):
    """FN16."""
    return fx.read(spark, sf, "supplier").select("s_suppkey", tx.slug(F.lit("supplier"), F.col("s_name")).alias("slug"))


@query("select p_type as act, string_agg(x, ',' order by x) as beats from (select distinct p_type, p_name as x from part) group by 1")
def nested_beats(spark, sf):
    """JO6: a sequence with its ordered beats."""
    return fx.read(spark, sf, "part").select(F.col("p_type").alias("act"), "p_name").distinct().groupBy("act").agg(F.array_join(F.array_sort(F.collect_list("p_name")), ",").alias("beats"))


@query("select c_custkey as material_id, 'trade' as dimension, max(w) as confidence, max(w) >= 0.5 as applicable from (select c_custkey, 0.9 as w from customer where c_mktsegment = 'BUILDING' union all select c_custkey, 0.4 from customer where contains(lower(c_name), '#00000001')) group by 1")
def dimension_routing(spark, sf):
    """FN19."""
    works = fx.read(spark, sf, "customer").select(F.col("c_custkey").alias("material_id"), F.col("c_mktsegment").alias("genre"), F.col("c_name").alias("name"))
    rules = spark.createDataFrame([("BUILDING", None, "trade", 0.9), (None, "#00000001", "trade", 0.4)], "genre_rule string, keyword string, dimension string, weight double")
    return wd.route_dimensions(works, rules).select("material_id", "dimension", "confidence", "applicable")


@query("select doc_id as id, source as work, lang, null as quality from documents where doc_id % 2 = 0 union all select d.doc_id, null, null, quality from labels d where doc_id % 2 = 1")
def legacy_reconcile(spark, sf):
    """FN26: two shapes of a record in one."""
    new = fx.read(spark, sf, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.col("source").alias("work"), "lang")
    old = fx.read(spark, sf, "labels").where("doc_id % 2 = 1").select("doc_id", "quality")
    return wd.reconcile(new, old, {"doc_id": "id"})


@query("select s_suppkey, concat_ws(' | ', s_name, case when s_acctbal > 0 then 'rich' end, n_name) as text from supplier join nation on s_nationkey = n_nationkey")
def embedding_texts(spark, sf):
    """FN11, FN20: text builders that skip what is missing."""
    s = fx.read(spark, sf, "supplier").join(fx.read(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select("s_suppkey", F.concat_ws(" | ", "s_name", F.when(F.col("s_acctbal") > 0, "rich"), "n_name").alias("text"))


@query("select s_suppkey, round(least(case when s_acctbal < 0 then 0.4 else 1 end, greatest(0, s_acctbal / 10000)), 6) as confidence from supplier")
def confidence_caps(spark, sf):
    """FN22."""
    cap = F.when(F.col("s_acctbal") < 0, 0.4).otherwise(1.0)
    return fx.read(spark, sf, "supplier").select("s_suppkey", F.round(F.least(cap, F.greatest(F.lit(0.0), F.col("s_acctbal") / 10000)), 6).alias("confidence"))


@query("select s_suppkey, round_even((s_nationkey + s_suppkey % 10 + 5) / 3, 1) as score, (s_suppkey % 10) / 10 < 0.6 as low from supplier")
def quality_scores(spark, sf):
    """FN23: a mean of three, half to even, and the low-confidence flag."""
    return fx.read(spark, sf, "supplier").select("s_suppkey", F.bround((F.col("s_nationkey") + F.col("s_suppkey") % 10 + 5) / 3, 1).alias("score"), ((F.col("s_suppkey") % 10) / 10 < 0.6).alias("low"))


@query("select o_orderkey, case o_orderstatus when 'O' then '中' when 'F' then '快转缓' else o_orderstatus end as pacing, case when o_orderpriority = '1-URGENT' then '快' when o_orderpriority = '5-LOW' then '慢' else '中' end as recovered from orders")
def pacing_normalisation(spark, sf):
    """FN14, FN15: variants to canonical values, unknown kept; a missing value recovered from tension."""
    # Variants of pacing.
    variants = {"O": "中", "F": "快转缓"}
    table = F.create_map(*[F.lit(x) for pair in variants.items() for x in pair])
    tension = 6 - F.substring("o_orderpriority", 1, 1).cast("int")
    recovered = F.when(tension >= 5, "快").when(tension <= 1, "慢").otherwise("中")
    return fx.read(spark, sf, "orders").select("o_orderkey", F.coalesce(F.try_element_at(table, F.col("o_orderstatus")), F.col("o_orderstatus")).alias("pacing"), recovered.alias("recovered"))


@query("select c_custkey, lower(regexp_replace(c_name, '^[0-9]+[_\\-、.\\s]+', '')) in (select lower(regexp_replace(s, '^[0-9]+[_\\-、.\\s]+', '')) from (select c_custkey || '. ' || c_name as s from customer where c_custkey % 10 = 0)) as duplicate from customer")
def duplicate_works(spark, sf):
    """JO16: the same name once leading numbers are stripped."""
    key = lambda c: F.lower(F.regexp_replace(c, r"^[0-9]+[_\-、.\s]+", ""))
    c = fx.read(spark, sf, "customer").select("c_custkey", "c_name")
    files = c.where("c_custkey % 10 = 0").select(key(F.concat(F.col("c_custkey").cast("string"), F.lit(". "), "c_name")).alias("k"), F.lit(True).alias("hit")).distinct()
    return c.withColumn("k", key(F.col("c_name"))).join(files, "k", "left").select("c_custkey", F.coalesce("hit", F.lit(False)).alias("duplicate"))


@query("select vec_id, coalesce(a.label, b.label) as label from embeddings left join (select vec_id, label from embeddings where vec_id % 2 = 0) a using (vec_id) left join (select vec_id, label from embeddings where vec_id % 3 = 0) b using (vec_id)")
def vector_attach(spark, sf):
    """JO9: the first key layout that has the vector."""
    v = fx.read(spark, sf, "embeddings").select("vec_id", "label")
    a, b = v.where("vec_id % 2 = 0").toDF("vec_id", "a"), v.where("vec_id % 3 = 0").toDF("vec_id", "b")
    return v.select("vec_id").join(a, "vec_id", "left").join(b, "vec_id", "left").select("vec_id", F.coalesce("a", "b").alias("label"))


@query("""with b as (select s_suppkey as k, s_name as name, n_name as nation, s_suppkey % 5 as m from supplier join nation on s_nationkey = n_nationkey)
 select 'premise:' || k as key, concat_ws(' | ', case when m > 0 then '前提: ' || name end, case when m <> 1 then '主题: ' || nation || ', ' || name end, case when m = 2 then '基调: ' || nation end) as text from b
 union all select 'character:' || k, case when m = 4 then name else concat_ws(' | ', '弧线: ' || nation, case when m = 1 then 'obsession: ' || name end, case when m = 1 then 'motivation: ' || nation end, case when m = 2 then '功能: ' || name end) end from b
 union all select 'entity:' || k, concat_ws(' | ', '名称: ' || name, case when m = 0 then '描述: ' || nation end, case k % 4 when 0 then 'levels: 1, 2, 3, 4, 5 | rules: ' || name when 1 then 'leader: ' || nation when 2 then 'importance: ' || nation else 'levels: 1, 2, 3, 4, 5, 6, 7, 8 | rules: ' || name || ' | leader: ' || nation || ' | importance: ' || nation end, case when m > 2 then '证据: a; b; c; d; e' end) from b
 union all select 'beat:' || k, case m when 0 then name when 1 then nation when 2 then null else name || ' | ' || nation end from b""")
def embedding_builders(spark, sf):
    """FN20: texts of works, characters, world entities by type, and beats."""
    b = fx.read(spark, sf, "supplier").join(fx.read(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    k, m, name, nation, no = F.col("s_suppkey"), F.col("s_suppkey") % 5, F.col("s_name"), F.col("n_name"), F.lit(None).cast("string")
    only = lambda when, value: F.when(when, value)
    premise = tx.premise_text(only(m > 0, name), only(m != 1, F.array(nation, name)), only(m == 2, F.array(nation)))
    mind = F.when(m == 1, F.create_map(F.lit("motivation"), nation, F.lit("obsession"), name, F.lit("age"), name))
    character = tx.character_text(name, only(m != 4, nation), no, mind, only(m == 2, name))
    kind = F.when(k % 4 == 0, "power_systems").when(k % 4 == 1, "factions").when(k % 4 == 2, "regions").otherwise("items")
    levels = F.array(*[F.lit(str(i)) for i in range(1, 10)])
    properties = F.create_map(F.lit("levels"), levels, F.lit("rules"), F.array(name), F.lit("leader"), F.array(nation), F.lit("importance"), F.array(nation))
    evidence = F.when(m > 2, F.array(*[F.lit(x) for x in ("a", "", "b", "c", "d", "e", "f")]))
    entity = tx.entity_text(kind, name, only(m == 0, nation), properties, evidence)
    beat = tx.beat_text(only(m != 1, only(m != 2, name)), F.when(m == 1, nation).when(m > 2, nation).otherwise(""))
    texts = F.map_from_arrays(F.array(*[F.lit(x) for x in ("premise", "character", "entity", "beat")]), F.array(premise, character, entity, beat))
    return b.select(k, F.explode(texts).alias("kind", "text")).select(F.concat_ws(":", "kind", k.cast("string")).alias("key"), "text")
