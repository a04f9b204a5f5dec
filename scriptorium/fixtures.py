"""How the driver's tables stand for the library's: each mapping as a DataFrame, and as a common table expression.

Works are document sources, customers or conversations; chapters are documents, orders or turns; appearances are the
parts on an order; the tag dictionary is made of parts; entities are suppliers, nations and regions; run events are
``events``.  Numbering a work's chapters is a window over the work, as wide as the largest work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.operators.statistics import numbered_within, spread


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def text_chapters(spark: SparkSession, sf: str) -> DataFrame:
    """(material_id, chapter, doc_id): documents of a source in order, numbered range by range, without their texts."""
    docs = read(spark, sf, "documents").select(F.col("source").alias("material_id"), "doc_id")
    return numbered_within(docs, "material_id", ["doc_id"], "chapter")


TEXT_CHAPTERS = "tc as (select source as material_id, cast(row_number() over (partition by source order by doc_id) as int) as chapter, doc_id, lang as genre, text as summary from documents)"


def order_chapters(spark: SparkSession, sf: str) -> DataFrame:
    """(material_id, chapter, chapter_key, tension_level, function, status, type, price, day): orders of a customer."""
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    orders = read(spark, sf, "orders")
    return spread(orders, "o_custkey", orders.count()).select(
        F.col("o_custkey").alias("material_id"),
        place.alias("chapter"),
        F.col("o_orderkey").alias("chapter_key"),
        (6 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("tension_level"),
        F.col("o_orderpriority").alias("function"),
        F.col("o_orderstatus").alias("status"),
        F.when(F.col("o_orderkey") % 11 == 0, "afterword").when(F.col("o_orderkey") % 7 == 0, "extra").otherwise("normal").alias("type"),
        F.col("o_totalprice").alias("price"),
        F.col("o_orderdate").alias("day"),
    )


ORDER_CHAPTERS = """oc as (select o_custkey as material_id, cast(row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as int) as chapter,
 o_orderkey as chapter_key, 6 - cast(substr(o_orderpriority, 1, 1) as int) as tension_level, o_orderpriority as function, o_orderstatus as status,
 case when o_orderkey % 11 = 0 then 'afterword' when o_orderkey % 7 = 0 then 'extra' else 'normal' end as type, o_totalprice as price, o_orderdate as day from orders)"""


def appearances(spark: SparkSession, sf: str) -> DataFrame:
    """(material_id, chapter, chapter_key, type, tension_level, function, name): a part's brand is a character.

    A chapter's names are made distinct before they meet the chapter, which is a row of its own by work and number."""
    lines = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("chapter_key"), F.col("l_partkey").alias("p_partkey"))
    names = read(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("name"))
    named = spread(lines.join(names, "p_partkey").select("chapter_key", "name"), "chapter_key", lines.count()).distinct()
    return named.join(order_chapters(spark, sf), "chapter_key").select("material_id", "chapter", "chapter_key", "type", "tension_level", "function", "name")


def appearance_counts(spark: SparkSession, sf: str) -> DataFrame:
    """(material_id, name, n) over all chapters, by work in partitions of bounded rows."""
    own = spread(appearances(spark, sf).select("material_id", "name"), "material_id", read(spark, sf, "lineitem").count())
    return own.groupBy("material_id", "name").agg(F.count("*").alias("n"))


APPEARANCES = ORDER_CHAPTERS + ", ap as (select distinct material_id, chapter, chapter_key, type, tension_level, function, p_brand as name from oc join lineitem on l_orderkey = chapter_key join part on p_partkey = l_partkey)"


def tags(spark: SparkSession, sf: str) -> DataFrame:
    """(dimension, tag, domain, is_common, synonym_of)."""
    one = read(spark, sf, "part").groupBy(F.col("p_type").alias("dimension"), F.col("p_name").alias("tag")).agg(F.min("p_brand").alias("domain"))
    first = F.min("tag").over(Window.partitionBy("dimension", "domain"))
    return one.withColumn("first", first).select("dimension", "tag", "domain", (F.col("domain") == "Brand#1").alias("is_common"), F.when(F.col("first") != F.col("tag"), F.col("first")).alias("synonym_of"))


TAGS = """tg0 as (select p_type as dimension, p_name as tag, min(p_brand) as domain from part group by 1, 2),
 tg1 as (select *, min(tag) over (partition by dimension, domain) as first from tg0),
 tg as (select dimension, tag, domain, domain = 'Brand#1' as is_common, case when first <> tag then first end as synonym_of from tg1)"""


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """(material_id, chapter, type, summary): conversations, one row for each turn."""
    one = read(spark, sf, "conversations").groupBy(F.col("conv_id").alias("material_id"), (F.col("turn") + 1).cast("int").alias("chapter"))
    return one.agg(F.min("role").alias("type"), F.min("text").alias("summary"))


TURNS = "tn as (select conv_id as material_id, cast(turn + 1 as int) as chapter, min(role) as type, min(text) as summary from conversations group by 1, 2)"


def run_events(spark: SparkSession, sf: str) -> DataFrame:
    """(event_id, run_id, stage_id, event_name, occurred_at, observed_at, duration_ms, k): k is the attribute."""
    e = read(spark, sf, "events")
    late = F.make_interval(secs=(F.col("event_id") % 120).cast("decimal(18,6)"))
    return e.select("event_id", F.col("user_id").alias("run_id"), (F.col("event_id") % 4).alias("stage_id"), F.col("event_type").alias("event_name"), F.col("ts").alias("occurred_at"), (F.col("ts") + late).alias("observed_at"), F.col("value").alias("duration_ms"), F.get_json_object("props", "$.k").cast("long").alias("k"))


RUN_EVENTS = """ev as (select event_id, user_id as run_id, event_id % 4 as stage_id, event_type as event_name, ts as occurred_at,
 ts + to_seconds(event_id % 120) as observed_at, value as duration_ms, cast(json_extract_string(props, '$.k') as bigint) as k from events)"""


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """(vec_id, material_id, vector)."""
    return read(spark, sf, "embeddings").select("vec_id", F.col("label").alias("material_id"), F.col("embedding").alias("vector"))


def search_queries(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, query): every benchmark item as a whole."""
    return read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


SEARCH_QUERIES = "qs as (select item_id as query_id, text as query from benchmark)"
