"""Registered queries: stores that are written step by step, and layouts with precedence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium import fixtures as fx
from scriptorium.plans.streams import arriving, run_events
from scriptorium.registry import query
from scriptorium.sources import layers
from scriptorium.sources.keyed_table import KeyedTable
from scriptorium.sources.reports import ReportLog
from scriptorium.sources.shared import new_path
from scriptorium.sources.units import UnitRuns
from scriptorium.streaming.events import merged_by_batch

EV = fx.RUN_EVENTS


@query(f"with {EV} select run_id, arg_max(event_id, (occurred_at, event_id)) as event_id, arg_max(event_name, (occurred_at, event_id)) as event_name from ev group by 1")
def stream_keyed_merge(spark, sf):
    """ST7: the state of every run, from changes that each micro-batch writes to the buckets of its keys, newest wins; the
    table is compacted on the way, and a batch that comes again changes nothing."""
    changes = arriving(run_events(spark, sf), "occurred_at").select("run_id", "event_id", "event_name", "occurred_at")
    table = KeyedTable(spark, new_path(spark, "runs"), changes.schema, keys=["run_id"], order=["occurred_at", "event_id"], buckets=16)
    merged_by_batch(changes, table, every=2)
    table.apply(run_events(spark, sf).select(*changes.columns).where("event_name = 'error'"), table.compacted())
    return table.read().select("run_id", "event_id", "event_name")


class Broken(Exception):
    """Stands for the loss of a driver."""


WORKS = "w as (select c_custkey as work_id, count(o_orderkey) as n, coalesce(sum(o_totalprice), 0) as total from customer left join orders on o_custkey = c_custkey group by 1)"


@query(f"with {WORKS} select work_id, n, round(total / greatest(n, 1), 4) as mean, case when n > 10 then 'long' else 'short' end as class, 1 as times_counted, 1 as times_averaged from w")
def resumed_run(spark, sf):
    """ST8: three stages over all works.  The first run loses its driver half-way through the second stage, and every seventh
    work fails there; the second run does what is missing, the third finds nothing to do: every work is done once."""
    orders, runs = fx.read(spark, sf, "orders"), UnitRuns(spark, new_path(spark, "run"), id="work_id", parts=4)
    done, attempt = F.lit(False).alias("failed"), {"n": 0}

    def count(units: DataFrame) -> DataFrame:
        own = orders.groupBy(F.col("o_custkey").alias("work_id")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
        return units.join(own, "work_id", "left").select("work_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.col("total").cast("double"), F.lit(0.0)).alias("total"), done)

    def average(units: DataFrame) -> DataFrame:
        attempt["n"] += 1
        if attempt["n"] == 3:
            raise Broken
        fails = (F.col("work_id") % 7 == 0) & F.lit(attempt["n"] < 4)
        return units.select("work_id", "n", F.round(F.col("total") / F.greatest("n", F.lit(1)), 4).alias("mean"), fails.alias("failed"))

    def classed(units: DataFrame) -> DataFrame:
        return units.select("work_id", "n", "mean", F.when(F.col("n") > 10, "long").otherwise("short").alias("class"), done)

    works, stages = fx.read(spark, sf, "customer").select(F.col("c_custkey").alias("work_id")), [("count", count), ("average", average), ("class", classed)]
    try:
        runs.run(works, stages)
    except Broken:
        pass
    runs.run(works, stages)
    times = lambda stage, name: runs.attempts(stage).groupBy("work_id").agg(F.count("*").cast("int").alias(name))
    result = runs.run(works, stages).select("work_id", "n", "mean", "class")
    return result.join(times("count", "times_counted"), "work_id").join(times("average", "times_averaged"), "work_id")


HALVES = "h as (select user_id as material_id, ts < timestamp '2024-01-16' as early, count(*) as events, sum((event_type = 'error')::int) as errors, min(ts) as started from events group by 1, 2)"


@query(f"with {HALVES} select coalesce(a.material_id, b.material_id) as material_id, a.events as before, coalesce(b.events, a.events) as latest, coalesce(b.errors, a.errors) as errors, (a.events is not null)::int + (b.events is not null)::int as reports from (select * from h where early) a full join (select * from h where not early) b on a.material_id = b.material_id")
def report_log(spark, sf):
    """SK9: a report of each work's run in either half of the month; the latest of every work, and the one before it, which
    can still be read as of the first version."""
    e = run_events(spark, sf).withColumn("early", F.col("occurred_at") < F.lit("2024-01-16").cast("timestamp"))
    reports = e.groupBy(F.col("run_id").alias("material_id"), "early").agg(F.count("*").alias("events"), F.count_if(F.col("event_name") == "error").alias("errors"), F.min("occurred_at").alias("started_at"))
    log = ReportLog(spark, new_path(spark, "reports"))
    first = log.append(reports.where("early").drop("early"))
    log.append(reports.where("not early").drop("early"))
    then = log.latest(as_of=first).select("material_id", F.col("events").alias("before"))
    n = log.read().groupBy("material_id").agg(F.count("*").cast("int").alias("reports"))
    return log.latest().join(then, "material_id", "left").join(n, "material_id").select("material_id", "before", F.col("events").alias("latest"), "errors", "reports")


PLACED = "c as (select source, 100 + cast(substr(md5(source), 1, 1) > '7' as int) as kind, row_number() over (partition by source order by doc_id) as chapter, doc_id, lang from documents)"


@query(f"with {PLACED} select source as material_id, chapter, case when chapter % 2 = 0 then 'T' || doc_id else 'M' || doc_id end as title, case when chapter % 5 = 0 then 'extra' when chapter % 3 = 0 then 'own' else 'normal' end as type, case when kind = 101 then 'split' else 'merged' end as layer from (select source, kind, chapter, lang, doc_id from c where kind = 100 or chapter % 4 <> 1)")
def layered_chapters(spark, sf):
    """SC2: works with one file for each chapter, of which some are broken, over works with a merged file; a work that has
    both is read from the former, and the index of types goes before the records' own."""
    docs = fx.read(spark, sf, "documents").select("source", "doc_id")
    place = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).cast("long")
    c = docs.withColumn("chapter", place).withColumn("kind", F.when(F.substring(F.md5("source"), 1, 1) > "7", "split").otherwise("merged"))
    title = F.concat(F.when(F.col("chapter") % 2 == 0, "T").otherwise("M"), F.col("doc_id").cast("string"))
    record = F.struct("chapter", title.alias("title"), F.when(F.col("chapter") % 3 == 0, "own").alias("type"), F.lit("x").alias("summary"))
    path = new_path(spark, "works")
    broken = F.when(F.col("chapter") % 4 == 1, F.lit("[no object")).otherwise(F.to_json(record))
    split = c.where("kind = 'split'").select("source", F.lit("split").alias("layer"), F.concat(F.col("chapter").cast("string"), F.lit(".json")).alias("name"), broken.alias("value"))
    # A work that has split files has a merged one as well, which must not count.
    merged = c.groupBy("source").agg(F.to_json(F.array_sort(F.collect_list(record))).alias("value"))
    layers.write_files(split, path)  # one for each chapter
    merged.repartition("source").select("source", F.lit("merged").alias("layer"), "value").write.mode("append").partitionBy("source", "layer").option("maxRecordsPerFile", 1).text(path)
    types = c.where("chapter % 5 = 0").select(F.concat(F.lit("source="), "source").alias("material_id"), "chapter", F.lit("extra").alias("type"))
    rows = layers.read_chapters(spark, path, types)
    return rows.select(F.regexp_replace("material_id", "^source=", "").alias("material_id"), "chapter", "title", "type", "layer")


@query("with v as (select label as material_id, vec_id, embedding, label % 3 = 2 as bare, vec_id % 17 = 0 as short, vec_id % 19 = 0 as odd from embeddings) select material_id, case when material_id % 2 = 0 then vec_id::varchar else 'k' || vec_id end as key, case when bare then 'no manifest' when short then 'dimension' when odd then 'not finite' else 'kept' end as state from v")
def layered_vectors(spark, sf):
    """SC3, EM1: files of vectors by number or by name, checked against their works' manifests, the others rejected."""
    v, path, id = fx.vectors(spark, sf), new_path(spark, "vectors"), F.col("vec_id")
    x = F.transform("vector", lambda c: c.cast("double"))
    x = F.when(id % 17 == 0, F.slice(x, 1, 63)).when(id % 19 == 0, F.concat(F.slice(x, 1, 63), F.array(F.lit(None).cast("double")))).otherwise(x)
    block = (F.col("vec_id") / 256).cast("long")  # a file has a bounded number of vectors
    files = v.select("material_id", block.alias("block"), "vec_id", x.alias("x")).groupBy("material_id", "block").agg(F.array_sort(F.collect_list(F.struct("vec_id", "x"))).alias("rows"))
    numbered = F.when(F.col("material_id") % 2 == 0, F.col("rows.vec_id"))
    named = F.when(F.col("material_id") % 2 == 1, F.transform("rows.vec_id", lambda i: F.concat(F.lit("k"), i.cast("string"))))
    files.select("material_id", F.lit("vectors").alias("kind"), numbered.alias("chapters"), named.alias("keys"), F.col("rows.x").alias("vectors")).write.partitionBy("material_id", "kind").json(path)
    manifest = v.where("material_id % 3 <> 2").select("material_id").distinct().select("material_id", F.lit("manifest").alias("kind"), F.lit(64).alias("dimension"), F.lit("m").alias("model"))
    manifest.write.mode("append").partitionBy("material_id", "kind").json(path)
    kept, rejected = layers.read_vectors(spark, path)
    both = kept.withColumn("reason", F.lit("kept")).union(rejected)
    return both.select(F.regexp_replace("material_id", "^material_id=", "").cast("int").alias("material_id"), "key", F.col("reason").alias("state"))
