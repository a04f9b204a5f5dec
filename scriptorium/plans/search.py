"""Registered queries: document types, filters, modes, hooks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from scriptorium import fixtures as fx
from scriptorium.functions import text as tx
from scriptorium.operators import evaluation as ev
from scriptorium.operators import hooks as hk
from scriptorium.operators import retrieval as rt
from scriptorium.plans.retrieval import FUSED, JUDGED, TRIGRAMS, VECTOR, both, every, judges, judgments, vector
from scriptorium.registry import query
from scriptorium.sources.shared import written


def shaped(rows, kind, id, material, title, summary, metadata):
    """Results of one document type in the common shape."""
    return rows.select(
        F.concat_ws(":", F.lit(kind), id.cast("string")).alias("result_id"), F.lit(kind).alias("document_type"), material.cast("string").alias("material_id"), title.cast("string").alias("title"), F.substring(summary, 1, 40).alias("summary"), F.to_json(F.struct(*metadata)).alias("metadata")
    )


TYPED = """select 'chapter:' || doc_id as result_id, 'chapter' as document_type, source as material_id, lang as title, substr(text, 1, 40) as summary, '{"n_chars":' || n_chars || '}' as metadata from documents
 union all select 'event:' || event_id, 'event', cast(user_id as varchar), event_type, substr(event_type, 1, 40), '{"event_id":' || event_id || '}' from events
 union all select 'outline:' || o_orderkey, 'outline', cast(o_custkey as varchar), o_orderstatus, o_orderpriority, '{"o_orderkey":' || o_orderkey || '}' from orders
 union all select 'character:' || p_partkey, 'character', p_brand, p_name, p_type, '{"p_size":' || p_size || '}' from part
 union all select 'world:' || s_suppkey, 'world', cast(s_nationkey as varchar), s_name, s_name, '{"s_nationkey":' || s_nationkey || '}' from supplier
 union all select 'detail:' || conv_id || '-' || turn, 'detail', cast(conv_id as varchar), role, substr(text, 1, 40), '{"turn":' || turn || '}' from conversations
 union all select 'insight:' || page_id, 'insight', regexp_extract(url, '//([^/]+)', 1), url, substr(html, 1, 40), '{"page_id":' || page_id || '}' from pages"""


def typed(spark, sf):
    t, c = lambda name: fx.read(spark, sf, name), F.col
    parts = [
        shaped(t("documents"), "chapter", c("doc_id"), c("source"), c("lang"), c("text"), ["n_chars"]),
        shaped(t("events"), "event", c("event_id"), c("user_id"), c("event_type"), c("event_type"), ["event_id"]),
        shaped(t("orders"), "outline", c("o_orderkey"), c("o_custkey"), c("o_orderstatus"), c("o_orderpriority"), ["o_orderkey"]),
        shaped(t("part"), "character", c("p_partkey"), c("p_brand"), c("p_name"), c("p_type"), ["p_size"]),
        shaped(t("supplier"), "world", c("s_suppkey"), c("s_nationkey"), c("s_name"), c("s_name"), ["s_nationkey"]),
        shaped(t("conversations"), "detail", F.concat_ws("-", "conv_id", "turn"), c("conv_id"), c("role"), c("text"), ["turn"]),
        shaped(t("pages"), "insight", c("page_id"), F.regexp_extract("url", "//([^/]+)", 1), c("url"), c("html"), ["page_id"]),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


@query(TYPED)
def typed_results(spark, sf):
    """RF1, RF7: results of the seven document types in one shape."""
    return typed(spark, sf)


@query(f"with r as ({TYPED}) select document_type, count(*) as n, min(result_id) as first from r where (document_type <> 'event' or title = 'error') and (document_type <> 'chapter' or title = 'en') group by 1")
def filter_dispatch(spark, sf):
    """FI14: each type's own filters, an absent one holds."""
    filters = F.when(F.col("document_type") == "event", F.create_map(F.lit("text"), F.lit("error"))).when(F.col("document_type") == "chapter", F.create_map(F.lit("genre"), F.lit("en"))).otherwise(F.create_map().cast("map<string,string>"))
    rows = typed(spark, sf).withColumn("filters", filters)
    return rows.where(hk.filters_hold(F.col("filters"), {"text": lambda v: F.col("title") == v, "genre": lambda v: F.col("title") == v})).groupBy("document_type").agg(F.count("*").alias("n"), F.min("result_id").alias("first"))


@query("select item_id as query_id, 'chapter' as document_type, 'colour' as key from benchmark where item_id % 2 = 0")
def unknown_filters(spark, sf):
    """FI14: keys that a type does not know are reported."""
    q = fx.read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.lit("chapter").alias("document_type"), F.when(F.col("item_id") % 2 == 0, F.create_map(F.lit("colour"), F.lit("red"), F.lit("genre"), F.lit("en"))).otherwise(F.create_map(F.lit("genre"), F.lit("en"))).alias("filters"))
    return hk.unknown_filters(q)


@query("select vec_id, label from embeddings where embedding is not null")
def vector_guard(spark, sf):
    """FI8: rows without a vector take no part."""
    return fx.vectors(spark, sf).where(F.col("vector").isNotNull()).select("vec_id", F.col("material_id").alias("label"))


@query("with l as (select source, doc_id, len(regexp_split_to_array(text, '\\n')) as n from documents), i as (select source, doc_id, sum(n) over (partition by source order by doc_id) - n + 1 as start_line, sum(n) over (partition by source order by doc_id) as end_line from l where doc_id % 4 <> 0) select d.doc_id, cast(start_line as bigint) as start_line, cast(end_line as bigint) as end_line, start_line is null as missing from documents d left join i using (doc_id)")
def source_locations(spark, sf):
    """JO5, RF5: lines of a hit, and a flag where the index lacks it."""
    w = Window.partitionBy("source").orderBy("doc_id")
    d = fx.read(spark, sf, "documents")
    lines = d.where("doc_id % 4 <> 0").select("source", "doc_id", F.size(F.split("text", "\n")).alias("n"))
    end = F.sum("n").over(w)
    index = lines.select("doc_id", (end - F.col("n") + 1).alias("start_line"), end.alias("end_line"))
    return hk.enriched(d.select("doc_id"), {"index": index}, lambda hits, t: hits.join(t["index"], "doc_id", "left").withColumn("missing", F.col("start_line").isNull()))


@query("select 'matched' as state, count(*) as n from documents join labels using (doc_id) union all select 'retry', count(*) from documents where doc_id not in (select doc_id from labels)")
def output_matching(spark, sf):
    """JO20: outputs by request, and the retry set."""
    done, again = hk.matched_outputs(fx.read(spark, sf, "documents").select("doc_id"), fx.read(spark, sf, "labels"), ["doc_id"])
    return done.agg(F.lit("matched").alias("state"), F.count("*").alias("n")).union(again.agg(F.lit("retry"), F.count("*")))


@query(f"with {FUSED}, m as (select query_id, result_id, string_agg(distinct retriever, ',' order by retriever) as matched_fields from al group by 1, 2) select fu.query_id, fu.result_id, score, cast(rank as int) as rank, retrievers, matched_fields, case when contains(matched_fields, 'semantic') then 'semantic' else 'lexical' end as source, substr(text, 1, 20) as summary from fu join m using (query_id, result_id) left join documents on doc_id = result_id")
def field_merge(spark, sf):
    """RF3: fields merged across retrievers, the later metadata win."""
    texts = fx.read(spark, sf, "documents").select(F.col("doc_id").alias("result_id"), F.substring("text", 1, 20).alias("summary"))
    rows = both(spark, sf).join(texts, "result_id", "left").withColumn("matched_fields", F.array("retriever")).withColumn("metadata", F.create_map(F.lit("source"), F.col("retriever")))
    merged = hk.fused_with_fields(rows)
    return merged.select("query_id", "result_id", "score", "rank", "retrievers", "matched_fields", F.col("metadata")["source"].alias("source"), "summary")


@query(f"with {FUSED} select query_id, result_id, cast(place as int) as place from hy where place <= 10 and query_id % 2 = 0 union all select query_id, vec_id, cast(rank as int) from vec where rank <= 10 and query_id % 2 = 1")
def search_modes(spark, sf):
    """RF4: quality and exact queries in one batch."""
    works = fx.read(spark, sf, "documents").select(F.col("doc_id").alias("result_id"), F.col("source").alias("material_id"))
    results = both(spark, sf).join(works, "result_id", "left")
    asked = results.select("query_id").distinct().withColumn("mode", F.when(F.col("query_id") % 2 == 0, "quality").otherwise("exact"))
    return hk.by_mode(asked, results.where("material_id is not null or query_id % 2 = 1"), 2, 10)


@query(f"with {FUSED}, h as (select *, (result_id % 100) / 100 as rescore from fu where rank <= 60) select query_id, result_id, cast(rank as int) as rank, rescore, cast(row_number() over (partition by query_id order by rescore desc, rank) as int) as place from h")
def rescoring_hook(spark, sf):
    """RF6, UD2: a user's scores on the first sixty, contract checked."""
    return hk.rescored(rt.reciprocal_rank_fusion(both(spark, sf)), lambda rows: (rows["result_id"] % 100) / 100)


@query(f"with {VECTOR} select query_id, vec_id as result_id, cast(rank as int) as rank, 'semantic' as retriever from vec where rank <= 5")
def retriever_registry(spark, sf):
    """UD1: channels by name; one whose table is missing is dropped with a reason."""
    tables = {"vectors": fx.vectors(spark, sf)}

    def semantic(queries, t):
        return rt.vector_search(t["vectors"], every(t["vectors"]), id="vec_id", vector="vector", k=5).select("query_id", F.col("vec_id").alias("result_id"), "rank")

    found, dropped = hk.retrieve(tables["vectors"], tables, {"semantic": semantic, "lexical": lambda q, t: t["postings"]})
    assert dropped == {"lexical": "no table postings"}
    return found


@query(f"with {JUDGED} select query_id, recall, ndcg from mt")
def evaluated_search(spark, sf):
    """UD5, UD3: metrics of a search function."""
    works = fx.read(spark, sf, "documents").select(F.col("doc_id").alias("result_id"), F.col("source").alias("material_id"))
    lists = both(spark, sf)
    cases = lists.select("query_id").distinct()
    return hk.evaluated(cases, lambda asked: rt.reciprocal_rank_fusion(lists.join(asked, "query_id", "left_semi")).join(works, "result_id"), judgments(spark, sf), 20, judges(lists)).select("query_id", "recall", "ndcg")


@F.pandas_udf(ArrayType(FloatType()))
def letter_shares(text: pd.Series) -> pd.Series:
    """A stand-in for an encoder: shares of the letters a to h."""
    return text.map(lambda t: [t.lower().count(c) / max(1, len(t)) for c in "abcdefgh"])


@query("select doc_id, 8 as dimension, round(length(regexp_replace(lower(text), '[^a]', '', 'g')) / length(text), 5) as first from documents where doc_id not in (select doc_id from labels)")
def pending_vectors(spark, sf):
    """UD6, JO17: an encoder over the rows without a vector."""
    out = hk.encoded_pending(fx.read(spark, sf, "documents"), fx.read(spark, sf, "labels"), "doc_id", "text", letter_shares)
    return out.select("doc_id", F.size("vector").alias("dimension"), F.round(F.col("vector")[0].cast("double"), 5).alias("first"))


@query(
    "with f as (select o_custkey as material_id, string_agg(p || '=' || last, ',' order by p) as fields from (select o_custkey, o_orderpriority as p, arg_max(o_orderstatus, o_orderkey) as last from orders group by 1, 2) group by 1), i as (select o_custkey as material_id, item, min(place) as place from (select o_custkey, o_orderstatus as item, o_orderkey * 2 as place from orders union all select o_custkey, o_orderpriority, o_orderkey * 2 + 1 from orders) group by 1, 2), l as (select material_id, string_agg(item, ',' order by place) as items from i group by 1) select * from f join l using (material_id)"
)
def profile_merge_fields(spark, sf):
    """SE5: later definitions of a field win, lists are united in order."""
    lists = F.create_map(F.lit("functions"), F.array("o_orderstatus", "o_orderpriority"))
    rows = fx.read(spark, sf, "orders").select(F.col("o_custkey").alias("material_id"), F.col("o_orderkey").alias("order"), F.create_map("o_orderpriority", "o_orderstatus").alias("fields"), lists.alias("lists"))
    merged = hk.merged_profiles(rows)
    fields = F.array_join(F.transform(F.map_entries("fields"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return merged.select("material_id", fields.alias("fields"), F.array_join(F.col("lists")["functions"], ",").alias("items"))


@query()
def approximate_candidates(spark, sf):
    """TK3: hashed candidates re-ranked exactly, with the share of the exact top ten that they hold."""
    v = fx.vectors(spark, sf)
    found = hk.approximate_then_exact(v, every(v), 10)
    found, exact = written(found, "candidates"), vector(spark, sf, 10).select("query_id", "vec_id")
    hit = found.join(exact, ["query_id", "vec_id"], "left_semi").groupBy("query_id").agg((F.count("*") / 10).alias("recall"))
    gate = ev.candidate_gate(F.col("recall"), F.lit(1.0), F.lit(1.0), F.lit(0.0), F.lit(0))
    return found.join(hit, "query_id").select("query_id", "rank", "vec_id", "score", "recall", gate.alias("passed"))


@query(r"with c as (select doc_id, trim(regexp_replace(regexp_replace(replace(replace(text, chr(12288), ' '), chr(160), ' '), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ') as t from documents) select doc_id, length(t) as n, md5(t) as digest from c")
def whitespace(spark, sf):
    """FN6: white space of all texts."""
    clean = tx.normalize_whitespace(F.col("text"))
    return fx.read(spark, sf, "documents").select("doc_id", F.length(clean).alias("n"), F.md5(clean).alias("digest"))


@query()
def whitespace_whole(spark, sf):
    """FN5, FN6: white space of all texts, and the values of all Chinese and ASCII numerals in them."""
    found = F.regexp_extract_all("text", F.lit(f"[{tx.NUMERAL}]+|[0-9]+"), F.lit(0))
    values = F.transform(found, lambda x: F.coalesce(tx.numeral_value(x).cast("string"), F.lit("?")))
    clean = tx.normalize_whitespace(F.col("text"))
    return fx.read(spark, sf, "documents").select("doc_id", F.length(clean).alias("n"), F.md5(clean).alias("digest"), F.array_join(values, ",").alias("numbers"))


def ranked_sql(kind: str, queries: str, docs: str, ties: str) -> str:
    """Lexical ranking of ``docs`` (id, title, text, …) for ``queries`` (query_id, query) in SQL."""
    words, tri = (lambda c: f"regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}]+')"), TRIGRAMS.format
    return f"""select * from (with qs as ({queries}), d as ({docs}), terms as (select distinct query_id, unnest({words("query")}) as term from qs), nt as (select query_id, count(*) as n_terms from terms group by 1),
 pos as (select id, unnest({words("text")}) as term, generate_subscripts({words("text")}, 1) as pos from d),
 met as (select query_id, id, count(distinct pos.term) as hit, count(*) as n, min(pos) as lo, max(pos) as hi from pos join terms using (term) group by 1, 2),
 tri as (select d.*, query_id, round(n / (hi - lo + 1), 6) as score, {tri("title")} as a, {tri("query")} as b from met join nt using (query_id) join d using (id) join qs using (query_id) where hit = n_terms),
 lik as (select *, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) as likeness from tri),
 r as (select query_id, id, score, row_number() over (partition by query_id order by score desc, likeness desc, {ties}, id) as rank from lik)
 select '{kind}' as document_type, query_id, id, cast(rank as int) as rank, score from r where rank <= 20)"""


TITLE = "array_to_string(list_slice(regexp_split_to_array(text, '\\s+'), 1, 4), ' ')"


@query(
    ranked_sql("chapter", "select item_id as query_id, text as query from benchmark", f"select doc_id as id, {TITLE} as title, text, row_number() over (partition by source order by doc_id) as chapter from documents", "chapter")
    + " union all "
    + ranked_sql("character", "select distinct cast(substr(p_brand, 7) as bigint) as query_id, 'widget ' || p_brand as query from part", "select p_partkey as id, p_name as title, concat_ws(' ', p_name, p_type, p_brand) as text, p_size from part", "p_size desc")
)
def typed_lexical(spark, sf):
    """TK1: by cover density, then likeness of the title, then the order of the type: chapters by number, characters by
    how often they appear."""
    d, p, c = fx.read(spark, sf, "documents"), fx.read(spark, sf, "part"), F.col
    title = F.array_join(F.slice(F.split("text", r"\s+"), 1, 4), " ")
    chapters = d.select("doc_id", title.alias("title"), "text").join(fx.text_chapters(spark, sf), "doc_id").select(c("doc_id").alias("id"), "title", "text", "chapter")
    people = p.select(c("p_partkey").alias("id"), c("p_name").alias("title"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("text"), "p_size")
    asked = p.select("p_brand").distinct().select(F.substring("p_brand", 7, 9).cast("long").alias("query_id"), F.concat(F.lit("widget "), "p_brand").alias("query"))
    by_type = {"chapter": (chapters, fx.search_queries(spark, sf), (F.asc("chapter"),)), "character": (people, asked, (F.desc("p_size"),))}
    found = [rt.lexical_search(docs, queries, id="id", text="text", limit=20, title="title", ties=ties).select(F.lit(kind).alias("document_type"), "query_id", "id", "rank", "score") for kind, (docs, queries, ties) in by_type.items()]
    return found[0].union(found[1])
