"""Registered queries: the tag dictionary."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium import fixtures as fx
from scriptorium.operators import tags as tg
from scriptorium.registry import query

TG = fx.TAGS
GD = "gd as (select n_name as genre, r_name as dimension0, 'Brand#' || (n_nationkey % 25 + 1) as domain from nation join region on n_regionkey = r_regionkey)"


def genre_domains(spark, sf):
    """(genre, domains map): each nation lists a brand for every part type."""
    kinds = F.array(*[F.lit(x) for x in ("ECONOMY", "STANDARD", "PROMO")])
    own = F.concat(F.lit("Brand#"), (F.col("n_nationkey") % 25 + 1).cast("string"))
    return fx.read(spark, sf, "nation").select(F.col("n_name").alias("genre"), F.map_from_arrays(kinds, F.transform(kinds, lambda k: F.array(own, F.lit("Brand#2")))).alias("domains"))


GENRES = "gd as (select n_name as genre, d.dimension, b.domain from nation, (values ('ECONOMY'), ('STANDARD'), ('PROMO')) d(dimension), lateral (select 'Brand#' || (n_nationkey % 25 + 1) as domain union select 'Brand#2') b)"


def used(spark, sf):
    """(dimension, tag, seen_at): parts that were ordered, a third of them under names out of the dictionary."""
    lines = fx.read(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_orderkey", F.col("l_shipdate").alias("seen_at"))
    name = F.when(F.col("l_orderkey") % 3 == 0, F.concat("p_name", F.lit(" new"))).otherwise(F.col("p_name"))
    return lines.join(fx.read(spark, sf, "part"), "p_partkey").select(F.col("p_type").alias("dimension"), name.alias("tag"), "seen_at")


USED = "us as (select p_type as dimension, case when l_orderkey % 3 = 0 then p_name || ' new' else p_name end as tag, l_shipdate as seen_at from lineitem join part on p_partkey = l_partkey)"


@query(f"with {TG}, {USED} select us.dimension, coalesce(synonym_of, us.tag) as canonical, tg.tag is not null as known, count(*) as n from us left join tg on us.dimension = tg.dimension and us.tag = tg.tag group by 1, 2, 3")
def synonym_resolution(spark, sf):
    """JO13, DQ5: canonical tags and those out of the dictionary."""
    return tg.resolve_synonyms(used(spark, sf), fx.tags(spark, sf)).groupBy("dimension", "canonical", "known").agg(F.count("*").alias("n"))


@query(f"with {TG}, {GENRES}, a as (select genre, dimension, tag from gd join tg using (dimension, domain) union select genre, gd.dimension, tag from gd join tg on gd.dimension = tg.dimension and is_common) select genre, dimension, count(*) as n, min(tag) as first from a group by 1, 2")
def applicable_tags(spark, sf):
    """JO14, SE4."""
    return tg.applicable_tags(genre_domains(spark, sf), fx.tags(spark, sf)).groupBy("genre", "dimension").agg(F.count("*").alias("n"), F.min("tag").alias("first"))


@query(f"with {TG}, {GENRES}, a as (select t.dimension, t.tag, coalesce(t.synonym_of, t.tag) as canonical from tg t where t.dimension in ('ECONOMY', 'PROMO')) select a.dimension, a.tag, genre from a join tg c on c.dimension = a.dimension and c.tag = a.canonical join gd on gd.dimension = a.dimension and gd.domain = c.domain")
def suggested_genres(spark, sf):
    """JO15, FI3: genres whose map lists the tag's domain."""
    tags = fx.tags(spark, sf)
    return tg.suggested_genres(tags.where("dimension in ('ECONOMY', 'PROMO')").select("dimension", "tag"), genre_domains(spark, sf), tags)


@query(f"with {TG} select dimension, domain, count(*) as tags, sum((synonym_of is not null)::int) as synonyms from tg group by rollup (dimension, domain)")
def tag_counts(spark, sf):
    """AG8: counts by dimension and domain with subtotals."""
    return fx.tags(spark, sf).rollup("dimension", "domain").agg(F.count("*").alias("tags"), F.count_if(F.col("synonym_of").isNotNull()).alias("synonyms"))


@query(f"with {TG}, {USED}, d as (select distinct dimension, tag from us) select dimension, count(*) as used, sum((not exists (select 1 from tg where tg.dimension = d.dimension and tg.tag = d.tag))::int) as unknown from d group by 1")
def used_tags(spark, sf):
    """AG9."""
    return tg.resolve_synonyms(used(spark, sf).select("dimension", "tag").distinct(), fx.tags(spark, sf)).groupBy("dimension").agg(F.count("*").alias("used"), F.count_if(~F.col("known")).alias("unknown"))


CANDIDATES = f"{TG}, {USED}, ca as (select dimension, tag, count(*) as occurrence_count, max(seen_at) as last_seen from us where not exists (select 1 from tg where tg.dimension = us.dimension and tg.tag = us.tag) group by 1, 2)"


def candidates(spark, sf):
    return tg.count_candidates(used(spark, sf), fx.tags(spark, sf))


@query(f"with {CANDIDATES} select dimension, tag, occurrence_count, strftime(last_seen, '%Y-%m-%d') as last_seen from ca")
def tag_candidates(spark, sf):
    """AG10: counters of unknown tags."""
    return candidates(spark, sf).withColumn("last_seen", F.date_format("last_seen", "yyyy-MM-dd"))


@query(f"with {CANDIDATES} select dimension, tag, occurrence_count, case when occurrence_count % 2 = 0 then 'Brand#2' when occurrence_count % 3 = 0 then 'Brand#3' else 'common' end as domain from ca where dimension in ('ECONOMY', 'PROMO') and occurrence_count >= 3")
def tag_auto_approval(spark, sf):
    """AG11."""
    n = F.col("occurrence_count")
    rows = candidates(spark, sf).withColumn("genre_domains", F.when(n % 2 == 0, F.array(F.lit("common"), F.lit("Brand#2"))).otherwise(F.array(F.lit("common")))).withColumn("suggested_domain", F.when(n % 3 == 0, "Brand#3"))
    return tg.auto_approved(rows, ["ECONOMY", "PROMO"]).select("dimension", "tag", "occurrence_count", "domain")


@query(f"with {CANDIDATES} select dimension, tag, occurrence_count from ca where occurrence_count >= 3 order by occurrence_count desc, dimension, tag limit 20")
def tag_review_queue(spark, sf):
    """AG12: a top-k report."""
    return tg.top_of(candidates(spark, sf).where("occurrence_count >= 3"), [F.desc("occurrence_count"), "dimension", "tag"], 20).select("dimension", "tag", "occurrence_count")


@query(f"with {TG}, d as (select dimension, domain, '\"' || domain || '\":[\"' || string_agg(tag, '\",\"' order by tag) || '\"]' as part from tg group by 1, 2) select dimension, '{{' || string_agg(part, ',' order by domain) || '}}' as view from d group by 1")
def tag_export_view(spark, sf):
    """SK7."""
    return tg.export_view(fx.tags(spark, sf))


@query(f"with {TG} select tag, min(case when tag like '%ring%' then 'jewel' when tag like '%small%' then 'size' else 'other' end) as class from tg group by 1")
def keyword_classes(spark, sf):
    """FN17: the first keyword that a tag contains names its class."""
    kind = F.when(F.contains("tag", F.lit("ring")), "jewel").when(F.contains("tag", F.lit("small")), "size").otherwise("other")
    return fx.tags(spark, sf).select("tag", kind.alias("class")).distinct()


@query("select n_name, r_name as genre, coalesce(case r_name when 'ASIA' then 'east' when 'EUROPE' then 'west' end, 'general') as profile from nation join region on n_regionkey = r_regionkey")
def genre_profiles(spark, sf):
    """FN18: map lookups with a default."""
    rows = fx.read(spark, sf, "nation").join(fx.read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    profile = F.create_map(F.lit("ASIA"), F.lit("east"), F.lit("EUROPE"), F.lit("west"))
    return rows.select("n_name", F.col("r_name").alias("genre"), F.coalesce(F.try_element_at(profile, F.col("r_name")), F.lit("general")).alias("profile"))


@query("select distinct c_mktsegment as genre, n_name from customer join nation on c_nationkey = n_nationkey where c_mktsegment in ('BUILDING', 'MACHINERY')")
def array_containment(spark, sf):
    """FI1, FI2: works whose array holds a value."""
    works = fx.read(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.collect_set("c_mktsegment").alias("genres"))
    asked = fx.read(spark, sf, "nation").join(works, "n_nationkey")
    hit = lambda g: asked.where(F.array_contains("genres", g)).select(F.lit(g).alias("genre"), "n_name")
    return hit("BUILDING").union(hit("MACHINERY"))


@query("select o_orderkey, c_name from orders join customer on o_custkey = c_custkey where 6 - cast(substr(o_orderpriority, 1, 1) as int) between 4 and 5 and c_mktsegment = 'BUILDING' and c_name ilike '%00000001%'")
def structured_filters(spark, sf):
    """FI4, FI5, FI6, JO1: ranges, equality and case-insensitive parts, pushed to the scans."""
    works = fx.read(spark, sf, "customer").where((F.col("c_mktsegment") == "BUILDING") & F.col("c_name").ilike("%00000001%")).select("c_custkey", "c_name")
    chapters = fx.read(spark, sf, "orders").where((6 - F.substring("o_orderpriority", 1, 1).cast("int")).between(4, 5)).select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return chapters.join(works, "c_custkey").select("o_orderkey", "c_name")


@query("select p_partkey from part where p_type in ('ECONOMY', 'STANDARD')")
def type_alias_filter(spark, sf):
    """FI7: an alias stands for several types, joined as a small table."""
    alias = spark.createDataFrame([("plain", "ECONOMY"), ("plain", "STANDARD"), ("fine", "PROMO")], "alias string, p_type string")
    return fx.read(spark, sf, "part").join(alias.where("alias = 'plain'"), "p_type", "left_semi").select("p_partkey")


@query("select doc_id, case when contains(text, 'Apache') and contains(lang, 'en') then 'common.text,genre.lang' when contains(text, 'Apache') then 'common.text' when contains(lang, 'en') then 'genre.lang' end as fields from documents where contains(text, 'Apache') or contains(lang, 'en')")
def map_field_match(spark, sf):
    """FI9: which map fields hold one of the words, case-sensitive."""
    hit = lambda m, prefix: F.transform(F.map_keys(F.map_filter(m, lambda k, v: F.contains(v, F.lit("Apache")) | (v == "en"))), lambda k: F.concat(F.lit(prefix), k))
    fields = F.concat(hit(F.create_map(F.lit("text"), F.col("text")), "common."), hit(F.create_map(F.lit("lang"), F.col("lang")), "genre."))
    return fx.read(spark, sf, "documents").select("doc_id", F.array_join(fields, ",").alias("fields")).where("fields <> ''")
