"""Registered queries: statistics of chapters, appearances and works."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scriptorium import fixtures as fx
from scriptorium.functions import text as tx
from scriptorium.operators import statistics as st
from scriptorium.registry import query

OC, AP, TC, TN = fx.ORDER_CHAPTERS, fx.APPEARANCES, fx.TEXT_CHAPTERS, fx.TURNS
REG = "type not in ('afterword', 'author_note')"


@query(f"with {AP} select material_id, name, count(*) as n, min(chapter) as first, max(chapter) as last from ap where {REG} group by 1, 2")
def appearance_counts(spark, sf):
    """AG1, FI10."""
    return st.appearance_counts(fx.appearances(spark, sf))


@query(f"with {AP} select c_custkey, name as p_brand, count(*) filter ({REG}) as appearances, min(chapter) filter ({REG}) as first, max(chapter) filter ({REG}) as last from customer left join ap on material_id = c_custkey group by 1, 2")
def profile_merge(spark, sf):
    """AG2, JO3: profiles of all that appear in any chapter of every work, with counts over regular chapters; a work
    without any has a row without a name."""
    seen = fx.appearances(spark, sf)
    people = seen.select(F.col("material_id").alias("c_custkey"), F.col("name").alias("p_brand")).distinct()
    counts = st.appearance_counts(seen).toDF("c_custkey", "p_brand", "n", "first", "last")
    works = fx.read(spark, sf, "customer").select("c_custkey").join(people, "c_custkey", "left")
    return works.join(counts, ["c_custkey", "p_brand"], "left").select("c_custkey", "p_brand", F.coalesce("n", F.lit(0)).alias("appearances"), "first", "last")


@query(f"with {OC} select material_id, round_even(avg(tension_level), 2) as mean_tension, sum((function = '2-HIGH')::int) as hooks, coalesce(string_agg(case when tension_level >= 4 then cast(chapter as varchar) end, ',' order by chapter), '') as high, concat_ws(',', sum((tension_level = 1)::int), sum((tension_level = 2)::int), sum((tension_level = 3)::int), sum((tension_level = 4)::int), sum((tension_level = 5)::int)) as histogram from oc group by 1")
def outline_statistics(spark, sf):
    """AG3, AG5."""
    return st.outline_statistics(fx.order_chapters(spark, sf), "2-HIGH")


@query(f"with {OC}, n as (select material_id, function as tag, count(*) as n, min(chapter) as first from oc group by 1, 2), r as (select *, row_number() over (partition by material_id order by n desc, first, tag) as rank from n) select material_id, tag, n, first, cast(rank as int) as rank from r where rank <= 3")
def top_tags(spark, sf):
    """AG4, WN15."""
    return st.top_tags(fx.order_chapters(spark, sf).withColumnRenamed("function", "tag"), 3)


@query("with w as (select source, lower(unnest(regexp_extract_all(text, '[\\p{L}]+'))) as w from documents), o as (select source as material_id, case when w like '%tion' then left(w, length(w) - 4) when w like '%ing' then left(w, length(w) - 3) end as stem from w) select material_id, stem, count(*) as n from o where length(stem) >= 4 group by 1, 2 having count(*) >= 5")
def suffix_mining(spark, sf):
    """AG6, AG7: names by suffix patterns, the first that matches, with a floor on their count."""
    words = fx.read(spark, sf, "documents").select(F.col("source").alias("material_id"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), 0)).alias("w"))
    stem = F.regexp_extract("w", "^(.*?)(?:tion|ing)$", 1)
    return words.select("material_id", F.when(F.col("w").endswith("tion"), F.regexp_extract("w", "^(.*)tion$", 1)).when(F.col("w").endswith("ing"), stem).alias("stem")).where("length(stem) >= 4").groupBy("material_id", "stem").agg(F.count("*").alias("n")).where("n >= 5")


@query("select source as material_id, count(*) as chapter_count, cast(sum(length(regexp_replace(text, '\\s', '', 'g'))) as bigint) as characters from documents group by 1")
def work_totals(spark, sf):
    """AG21, FN10."""
    return fx.read(spark, sf, "documents").groupBy(F.col("source").alias("material_id")).agg(F.count("*").alias("chapter_count"), F.sum(tx.non_blank_length(F.col("text"))).alias("characters"))


@query(f"with {OC} select material_id, count(*) as total, sum((status <> 'O')::int) as analysed, sum((status = 'O')::int) as missing, coalesce(string_agg(case when status = 'O' then cast(chapter as varchar) end, ',' order by chapter), '') as missing_chapters from oc group by 1")
def coverage(spark, sf):
    """AG27, JO2: chapters analysed and missing."""
    done = fx.order_chapters(spark, sf)
    gone = F.col("status") == "O"
    return done.groupBy("material_id").agg(F.count("*").alias("total"), F.count_if(~gone).alias("analysed"), F.count_if(gone).alias("missing"), F.array_join(F.sort_array(F.collect_list(F.when(gone, F.col("chapter")))), ",").alias("missing_chapters"))


@query("select doc_id, source as material_id from documents where doc_id not in (select doc_id from labels)")
def missing_chapters(spark, sf):
    """JO2, JO17: pending work by anti-join."""
    return fx.read(spark, sf, "documents").select("doc_id", F.col("source").alias("material_id")).join(fx.read(spark, sf, "labels"), "doc_id", "left_anti")


@query("select d.doc_id, coalesce(case when toxic = 1 then 'toxic' when quality = 0 then 'low' end, 'normal') as type from documents d left join labels using (doc_id)")
def attach_type(spark, sf):
    """SC2, JO3: the index's type, normal by default."""
    kind = F.coalesce(F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low"), F.lit("normal"))
    return fx.read(spark, sf, "documents").select("doc_id").join(fx.read(spark, sf, "labels"), "doc_id", "left").select("doc_id", kind.alias("type"))


@query(f"with {TN} select a.material_id, a.chapter, substr(p.summary, 1, 30) as previous, substr(n.summary, 1, 30) as next from tn a left join tn p on p.material_id = a.material_id and p.chapter = a.chapter - 1 left join tn n on n.material_id = a.material_id and n.chapter = a.chapter + 1")
def neighbour_context(spark, sf):
    """JO4, WN3: neighbours by number, with one window."""
    t = fx.turns(spark, sf).withColumn("short", F.substring("summary", 1, 30))
    return t.select("material_id", "chapter", st.previous_in_number(t, "short").alias("previous"), st.next_in_number(t, "short").alias("next"))


@query(f"with {OC}, l as (select *, lag(tension_level) over (partition by material_id order by chapter) as before from oc) select material_id, chapter, case when tension_level > before then '上升' when tension_level < before then '下降' when tension_level = before then '持平' end as expected, case when before is not null and (case when tension_level > before then '上升' when tension_level < before then '下降' else '持平' end) <> (case status when 'O' then '上升' when 'F' then '下降' else '持平' end) then 1 else 0 end as mismatch from l")
def tension_consistency(spark, sf):
    """WN4: the claimed change of tension against the chapter before."""
    c = fx.order_chapters(spark, sf)
    c = c.withColumn("before", st.previous_in_number(c, "tension_level"))
    expected = F.when(F.col("tension_level") > F.col("before"), "上升").when(F.col("tension_level") < F.col("before"), "下降").when(F.col("tension_level") == F.col("before"), "持平")
    claimed = F.when(F.col("status") == "O", "上升").when(F.col("status") == "F", "下降").otherwise("持平")
    return c.select("material_id", "chapter", expected.alias("expected"), F.coalesce((expected != claimed).cast("int"), F.lit(0)).alias("mismatch"))


@query(f"""with {OC}, p as (select *, chapter / count(*) over (partition by material_id) as pos, function = '2-HIGH' as turning, function = '1-URGENT' as climax from oc),
 r as (select material_id, chapter, case when pos <= 0.10 and tension_level >= 3 then 'inciting_incident' when pos <= 0.25 and tension_level >= 4 and turning then 'first_turning_point' when pos between 0.40 and 0.60 and tension_level >= 4 then 'midpoint'
 when pos between 0.60 and 0.80 and tension_level >= 4 and turning then 'second_turning_point' when pos >= 0.80 and (tension_level = 5 or climax) then 'climax' when pos >= 0.90 and tension_level <= 2 then 'resolution' end as role from p) select * from r where role is not null""")
def structural_roles(spark, sf):
    """WN10, FN28."""
    c = fx.order_chapters(spark, sf)
    position = F.col("chapter") / F.count("*").over(Window.partitionBy("material_id"))
    role = st.structural_role(F.col("pos"), F.col("tension_level"), F.col("function") == "2-HIGH", F.col("function") == "1-URGENT")
    return c.withColumn("pos", position).select("material_id", "chapter", role.alias("role")).where("role is not null")


@query("with n as (select doc_id, source, row_number() over (partition by source order by doc_id) - 1 as place, count(*) over (partition by source) as size from documents), s as (select distinct source, cast(floor(i * (size - 1) / 6) as bigint) as place from n, range(7) t(i) where size > 7) select source, doc_id from n where size <= 7 or (source, place) in (select source, place from s)")
def even_sampling(spark, sf):
    """WN5, WN7."""
    return st.even_sample(fx.read(spark, sf, "documents"), "source", ["doc_id"], 7).select("source", "doc_id")


@query("select doc_id, source, cast((row_number() over (partition by source order by doc_id) - 1) // 8 as bigint) as batch from documents")
def sample_batches(spark, sf):
    """WN6: batches of a fixed size."""
    n = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return fx.read(spark, sf, "documents").select("doc_id", "source", F.floor((n - 1) / 8).alias("batch"))


@query("with r as (select doc_id, source, cast(sum(cast(ceil(length(text) / 1.5) as bigint)) over (partition by source order by doc_id) as bigint) as spent from documents) select * from r where spent <= 4000")
def budgeted_pool(spark, sf):
    """WN13: chapters until the token budget is spent."""
    return st.within_budget(fx.read(spark, sf, "documents").select("doc_id", "source", F.length("text").alias("n")), "source", ["doc_id"], F.ceil(F.col("n") / 1.5), 4000).select("doc_id", "source", "spent")


@query("with p as (select source as material_id, doc_id, len(regexp_split_to_array(text, '\\n')) as n from documents) select material_id, doc_id, cast(row_number() over w as int) as chapter, cast(coalesce(sum(n) over (w rows between unbounded preceding and 1 preceding), 0) + 1 as bigint) as start_line, cast(sum(n) over w as bigint) as end_line from p window w as (partition by material_id order by doc_id)")
def chapter_index(spark, sf):
    """WN1: chapter numbers and line offsets."""
    w = Window.partitionBy("material_id").orderBy("doc_id")
    lines = fx.read(spark, sf, "documents").select(F.col("source").alias("material_id"), "doc_id", F.size(F.split("text", "\n")).alias("n"))
    end = F.sum("n").over(w)
    return lines.select("material_id", "doc_id", F.row_number().over(w).alias("chapter"), (end - F.col("n") + 1).alias("start_line"), end.alias("end_line"))


@query(f"""with {AP}, one as (select distinct material_id, chapter, name from ap where {REG}),
 dg as (select a.material_id, a.name, count(distinct b.name) as degree from one a join one b on a.material_id = b.material_id and a.chapter = b.chapter and a.name <> b.name group by 1, 2) select * from dg""")
def coappearance_degree(spark, sf):
    """JO12, AG29."""
    return st.neighbour_degree(fx.appearances(spark, sf))


@query(f"""with {AP}, one as (select distinct material_id, chapter, name from ap where {REG}),
 dg as (select a.material_id, a.name, count(distinct b.name) as degree from one a join one b on a.material_id = b.material_id and a.chapter = b.chapter and a.name <> b.name group by 1, 2),
 sg as (select material_id, name, count(*) as n, max(chapter) - min(chapter) + 1 as span, sum((function = '2-HIGH')::int) as key from ap where {REG} group by 1, 2),
 j as (select sg.*, coalesce(degree, 0) as degree from sg left join dg using (material_id, name)),
 nv as (select o_custkey as material_id, 'Brand#' || (o_custkey % 25 + 1) as name, max(o_orderkey % 11) / 10 as confidence from orders group by 1, 2),
 sh as (select j.*, confidence, coalesce(n / nullif(max(n) over w, 0), 0) as a, coalesce(span / nullif(max(span) over w, 0), 0) as b, coalesce(key / nullif(max(key) over w, 0), 0) as c, coalesce(degree / nullif(max(degree) over w, 0), 0) as d from j left join nv using (material_id, name) window w as (partition by material_id)),
 sc as (select *, round(0.35 * a + 0.20 * b + 0.20 * c + 0.10 * d + 0.15 * coalesce(confidence, 0), 6) as score from sh where n >= 5 or confidence is not null),
 rk as (select *, row_number() over (partition by material_id order by score desc, n desc, name) as rank from sc)
 select material_id, name, score, cast(rank as int) as rank, case when coalesce(confidence, 0) >= 0.8 or n >= 50 then 'protagonist' when n >= 10 then 'supporting' else 'minor' end as role_hint,
 concat_ws(',', case when a > 0 then 'chapters:' || n end, case when b >= 0.5 then 'long span' end, case when c > 0 then 'key events:' || key end, case when d > 0 then 'neighbours:' || degree end, case when confidence is not null then 'candidate:' || cast(confidence as decimal(4,2)) end) as reasons from rk where rank <= 12""")
def biography_targets(spark, sf):
    """TK5: targets with reasons and role hints; candidates of the navigation count by their confidence."""
    w = F.col("o_custkey")
    navigation = fx.read(spark, sf, "orders").groupBy(w.alias("material_id"), F.concat(F.lit("Brand#"), (w % 25 + 1).cast("string")).alias("name")).agg((F.max(F.col("o_orderkey") % 11) / 10).alias("confidence"))
    return st.biography_targets(fx.appearances(spark, sf), "2-HIGH", navigation).select("material_id", "name", "score", "rank", "role_hint", F.array_join("reasons", ",").alias("reasons"))


@query(f"with {AP}, c as (select name, count(*) as n from ap where {REG} group by 1) select name, n, case when n >= 50 then 'core' when n >= 10 then 'supporting' when n >= 5 then 'minor' else 'background' end as tier from c")
def character_tiers(spark, sf):
    """TK6, FN23."""
    counts = st.regular(fx.appearances(spark, sf)).groupBy("name").agg(F.count("*").alias("n"))
    return counts.withColumn("tier", st.character_tier(F.col("n")))


@query(f"""with {TN}, r as (select material_id, chapter, row_number() over (partition by material_id order by chapter) as place, list_distinct(regexp_extract_all(summary, '(?s).')) as c from tn)
 select a.material_id, a.chapter as first, b.chapter as second, round(len(list_intersect(a.c, b.c)) / len(list_distinct(list_concat(a.c, b.c))), 6) as similarity from r a join r b on a.material_id = b.material_id and b.place - a.place between 1 and 10
 where round(len(list_intersect(a.c, b.c)) / len(list_distinct(list_concat(a.c, b.c))), 6) > 0.7""")
def near_duplicate_summaries(spark, sf):
    """JO8, DQ7, FN13: similar texts within a band of ten places."""
    return st.banded_pairs(fx.turns(spark, sf), F.col("summary"), 10, 0.7)


@query(f"with {OC}, c as (select material_id, count(*) as n from oc group by 1), p as (select material_id, n, greatest(cast(floor(n * 0.25) as bigint), 1) as a, greatest(cast(floor(n * 0.75) as bigint), 2) as b from c), q as (select material_id, 1 as part, 1 as first, least(a, n) as last from p union all select material_id, 2, a + 1, least(b, n) from p union all select material_id, 3, b + 1, n from p) select * from q where first <= last")
def fallback_parts(spark, sf):
    """FN24."""
    return st.fallback_parts(fx.order_chapters(spark, sf).groupBy("material_id").agg(F.count("*").alias("n")))


@query(f"with {OC} select s.material_id, s.part, count(*) as chapters, sum((tension_level >= 4)::int) as high, min(tension_level) as low_tension, max(tension_level) as high_tension from (select material_id, count(*) as n from oc group by 1) w, lateral (select w.material_id, i as part, (n * (i - 1)) // 4 + 1 as first, (n * i) // 4 as last from range(1, 5) t(i)) s join oc on oc.material_id = s.material_id and chapter between s.first and s.last group by 1, 2")
def sequence_statistics(spark, sf):
    """JO7, AG31: chapters of a sequence's range."""
    oc = fx.order_chapters(spark, sf)
    cut = lambda i: F.floor(F.col("n") * i / 4)
    seq = oc.groupBy("material_id").agg(F.count("*").alias("n")).withColumn("part", F.explode(F.sequence(F.lit(1), F.lit(4)))).select("material_id", "part", (cut(F.col("part") - 1) + 1).alias("first"), cut(F.col("part")).alias("last"))
    met = seq.join(oc, "material_id").where(F.col("chapter").between(F.col("first"), F.col("last")))
    return met.groupBy("material_id", "part").agg(F.count("*").alias("chapters"), F.count_if(F.col("tension_level") >= 4).alias("high"), F.min("tension_level").alias("low_tension"), F.max("tension_level").alias("high_tension"))


@query(f"with {OC}, f as (select material_id, chapter, function, row_number() over (partition by material_id order by chapter) as n from oc where tension_level >= 3) select material_id, min(chapter) as first, string_agg(substr(function, 1, 30), '|' order by n) as events from f where n <= 5 group by 1")
def fallback_profiles(spark, sf):
    """AG30: a profile from the first key events."""
    w = Window.partitionBy("material_id").orderBy("chapter")
    rows = fx.order_chapters(spark, sf).where("tension_level >= 3").withColumn("n", F.row_number().over(w)).where("n <= 5")
    events = F.transform(F.array_sort(F.collect_list(F.struct("n", "function"))), lambda x: F.substring(x["function"], 1, 30))
    return rows.groupBy("material_id").agg(F.min("chapter").alias("first"), F.array_join(events, "|").alias("events"))


@query(f"with {OC}, a as (select material_id, count(*) as chapters, count(distinct function) as functions from oc where chapter <= 80 group by 1), {AP.split(', ap as', 1)[1].join(['ap as', ''])}, b as (select material_id, string_agg(name, ',' order by n desc, name) as cast_names from (select *, row_number() over (partition by material_id order by n desc, name) as r from (select material_id, name, count(*) as n from ap group by 1, 2)) where r <= 50 group by 1) select material_id, chapters, functions, coalesce(cast_names, '') as cast_names from a left join b using (material_id)")
def work_context(spark, sf):
    """AG32: a record for each work from capped sides."""
    a = fx.order_chapters(spark, sf).where("chapter <= 80").groupBy("material_id").agg(F.count("*").alias("chapters"), F.countDistinct("function").alias("functions"))
    order = Window.partitionBy("material_id").orderBy(F.desc("n"), "name")
    names = fx.appearance_counts(spark, sf).withColumn("r", F.row_number().over(order)).where("r <= 50")
    b = names.groupBy("material_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "name"))), lambda x: x["name"]), ",").alias("cast_names"))
    return a.join(b, "material_id", "left").fillna("", ["cast_names"])


@query("with l as (select distinct l_orderkey, p_brand, p_type, p_size from lineitem join part on l_partkey = p_partkey) select l_orderkey, max(p_size) as confidence, string_agg(distinct p_type, ',' order by p_type) as reasons from l group by 1")
def candidate_merge(spark, sf):
    """AG23, AG34: highest confidence and the union of reasons."""
    lines = fx.read(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey")).join(fx.read(spark, sf, "part"), "p_partkey")
    return lines.groupBy("l_orderkey").agg(F.max("p_size").alias("confidence"), F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("reasons"))


@query("with r as (select *, row_number() over (partition by p_type, p_name order by p_partkey) as n from part) select p_partkey, p_type, p_name from r where n = 1")
def first_wins_dedupe(spark, sf):
    """AG33: source duplicates, the first wins."""
    w = Window.partitionBy("p_type", "p_name").orderBy("p_partkey")
    return fx.read(spark, sf, "part").withColumn("n", F.row_number().over(w)).where("n = 1").select("p_partkey", "p_type", "p_name")


@query(f"with {OC}, m as (select material_id, min(chapter) filter (tension_level >= 4) as k from oc group by 1) select material_id, row_number() over (order by coalesce(k, 1000000000), material_id) as place from m")
def stage_map_order(spark, sf):
    """AG24: stages of all works by the start of their first range, those without one last; numbered range by range."""
    first = fx.order_chapters(spark, sf).groupBy("material_id").agg(F.min(F.when(F.col("tension_level") >= 4, F.col("chapter"))).alias("k"))
    return st.numbered(first.select("material_id", F.coalesce("k", F.lit(10**9)).alias("k")), ["k", "material_id"], "place").select("material_id", "place")


@query(f"with {OC}, s as (select material_id, chapter, max(chapter) over (partition by material_id) as n from oc), t as (select * from s where n <= 7 or list_contains(list_transform(range(7), lambda i: i * (n - 1) // 6), chapter - 1)) select material_id, count(*) as sampled, min(chapter) as lo, max(chapter) as hi, case when count(*) < 3 then 'few chapters' else '' end as limitation from t group by 1")
def sampling_coverage(spark, sf):
    """FN25: of the even sample of each work's chapters."""
    c = st.even_sample(fx.order_chapters(spark, sf), "material_id", ["chapter"], 7)
    return c.groupBy("material_id").agg(F.count("*").alias("sampled"), F.min("chapter").alias("lo"), F.max("chapter").alias("hi"), F.when(F.count("*") < 3, "few chapters").otherwise("").alias("limitation"))


@query("with n as (select doc_id, source, row_number() over (partition by source order by doc_id) - 1 as place, count(*) over (partition by source) as size from documents), s as (select * from n where size <= 15 or list_contains(list_transform(range(15), lambda i: i * (size - 1) // 14), place)) select doc_id, source, cast((row_number() over (partition by source order by doc_id) - 1) // 3 + 1 as bigint) as batch from s")
def progressive_batches(spark, sf):
    """WN6: five batches of three from each work."""
    return st.progressive_batches(fx.read(spark, sf, "documents").select("doc_id", "source"), "source", ["doc_id"], 3)
