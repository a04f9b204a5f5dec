"""Registered queries: run events in batch and as streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scriptorium import fixtures as fx
from scriptorium.operators import events as ev
from scriptorium.registry import query
from scriptorium.sources.shared import VersionedTable, new_path
from scriptorium.streaming import events as st

EV = fx.RUN_EVENTS


def doubled(spark, sf):
    """Events with a third of them delivered twice."""
    e = fx.run_events(spark, sf)
    return e.union(e.where("event_id % 3 = 0").withColumn("observed_at", F.col("observed_at") + F.expr("interval 1 hour")))


@query(f"with {EV} select event_id, run_id, event_name from ev")
def event_dedupe(spark, sf):
    """SC4: strict scan, first of each event."""
    return ev.deduplicated(doubled(spark, sf)).select("event_id", "run_id", "event_name")


@query(f"with {EV} select run_id, count(*) as calls, sum((event_name = 'purchase')::int) as completed, sum((event_name = 'error')::int) as errors, cast(sum(k) as bigint) as tokens, round(sum(duration_ms), 4) as cost, arg_max(event_name, (occurred_at, event_id)) as last_event from ev group by 1")
def run_summary(spark, sf):
    """AG14, AG36."""
    return ev.run_summary(ev.deduplicated(doubled(spark, sf)))


@query(f"with {EV}, r as (select *, row_number() over (partition by run_id, stage_id, event_name order by occurred_at, event_id) as n from ev) select run_id, stage_id, event_name, count(*) as total, string_agg(case when n <= 3 then cast(event_id as varchar) end, ',' order by n) as samples from r group by 1, 2, 3")
def diagnostic_rollup(spark, sf):
    """AG15."""
    return ev.diagnostic_rollup(fx.run_events(spark, sf))


@query(f"with {EV}, o as (select run_id, stage_id, sum(k) as tokens, count(*) as calls, sum((event_name = 'error')::int) as errors, sum(duration_ms) as ms from ev group by 1, 2) select run_id, stage_id, cast(tokens as bigint) as tokens, calls, round(errors / calls, 6) as error_rate, round(ms / sum(ms) over (partition by run_id), 6) as share, round(tokens / calls, 6) as per_call from o")
def stage_costs(spark, sf):
    """AG38."""
    return ev.stage_costs(fx.run_events(spark, sf))


@query(f"with {EV}, r as (select stage_id as material_id, run_id, date_trunc('day', occurred_at) as d, min(occurred_at) as started_at, round(sum(duration_ms), 3) as ms, sum((event_name = 'error')::int) < 2 as ok from ev group by 1, 2, 3) select a.material_id, a.run_id, strftime(a.d, '%Y-%m-%d') as day, a.ms, round(b.m, 4) as baseline, round(100 * (a.ms - round(b.m, 4)) / round(b.m, 4), 4) as delta from r a, lateral (select median(ms) as m from (select ms from r c where c.ok and c.material_id = a.material_id and (c.started_at < a.started_at or c.started_at = a.started_at and c.run_id < a.run_id) order by c.started_at desc, c.run_id desc limit 3)) b")
def duration_baseline(spark, sf):
    """AG16."""
    runs = fx.run_events(spark, sf).groupBy(F.col("stage_id").alias("material_id"), "run_id", F.date_format("occurred_at", "yyyy-MM-dd").alias("day")).agg(F.min("occurred_at").alias("started_at"), F.round(F.sum("duration_ms"), 3).alias("ms"), (F.count_if(F.col("event_name") == "error") < 2).alias("ok"))
    return ev.duration_baseline(runs).select("material_id", "run_id", "day", "ms", "baseline", "delta")


@query(f"with {EV} select run_id, sum((event_name = 'signup')::int) as starts, sum((event_name = 'signup')::int) <> 1 as bad_start, sum((event_name = 'purchase')::int) = 0 as no_completion, arg_max(stage_id, (occurred_at, event_id)) as last_stage from ev group by 1")
def run_report(spark, sf):
    """AG17, SK9: report checks of each run."""
    e = fx.run_events(spark, sf)
    n = F.count_if(F.col("event_name") == "signup")
    return e.groupBy("run_id").agg(n.alias("starts"), (n != 1).alias("bad_start"), (F.count_if(F.col("event_name") == "purchase") == 0).alias("no_completion"), F.max_by("stage_id", F.struct("occurred_at", "event_id")).alias("last_stage"))


@query(f"with {EV}, p as (select event_id, run_id, occurred_at, duration_ms as rate, count(*) over (partition by run_id) - row_number() over (partition by run_id order by occurred_at, event_id) as lft from ev), q as (select *, list(rate) over w as l from p window w as (partition by run_id order by occurred_at, event_id rows 4 preceding)) select event_id, case when len(l) >= 2 then round(round(list_aggregate(l, 'median'), 4) * lft, 3) end as eta from q")
def remaining_estimate(spark, sf):
    """WN14."""
    w = Window.partitionBy("run_id").orderBy("occurred_at", "event_id")
    p = fx.run_events(spark, sf).withColumn("rate", F.col("duration_ms")).withColumn("left", F.count("*").over(Window.partitionBy("run_id")) - F.row_number().over(w))
    return ev.remaining_estimate(p).select("event_id", "eta")


@query(f"with {EV}, f as (select distinct strftime(occurred_at, '%Y-%m-%d') as day, run_id as file from ev), r as (select *, dense_rank() over (order by day desc) as nth, row_number() over (order by day desc, file desc) as place from f) select day, file, nth <= 7 and place <= 400 as keep from r")
def retention(spark, sf):
    """ST6: the files of the newest seven days, the latest 400 of them."""
    files = fx.run_events(spark, sf).select(F.date_format("occurred_at", "yyyy-MM-dd").alias("day"), F.col("run_id").alias("file")).distinct()
    return ev.retained(files, 7, 400)


def stream(spark, sf):
    """The events table as a finite stream.

    A folder of part files is streamed itself; a single file by its name from the folder that it lies in.
    """
    table = f"{sf}/events.parquet"
    source = spark.readStream.schema(spark.read.parquet(table).schema)
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    folder = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(path).isDirectory()
    e = source.parquet(table) if folder else source.option("pathGlobFilter", "events.parquet").parquet(sf)
    late = F.make_interval(secs=(F.col("event_id") % 120).cast("decimal(18,6)"))
    return e.select("event_id", F.col("user_id").alias("run_id"), (F.col("event_id") % 4).alias("stage_id"), F.col("event_type").alias("event_name"), F.col("ts").cast("timestamp").alias("occurred_at"), (F.col("ts").cast("timestamp") + late).alias("observed_at"), F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("select event_id, user_id as run_id from events")
def stream_dedupe(spark, sf):
    """ST1."""
    return st.drained(st.deduplicated(stream(spark, sf)), "append").select("event_id", "run_id")


@query(f"with {EV} select run_id, count(*) as calls, sum((event_name = 'error')::int) as errors, cast(sum(k) as bigint) as tokens from ev group by 1")
def stream_run_summary(spark, sf):
    """ST2."""
    return st.drained(st.running_summary(stream(spark, sf)), "complete")


@query("select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, event_type as event_name, count(*) as n from events group by 1, 2")
def stream_daily_counts(spark, sf):
    """ST5: windows under a watermark."""
    out = st.drained(st.windowed_counts(stream(spark, sf)), "complete")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_name", "n")


@query("with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 60 minutes then 0 else 1 end as new from events), s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as s from g) select user_id as run_id, s, count(*) as n, max(ts) + interval 60 minutes < (select max(ts) from events) as silent from s group by 1, 2")
def stream_sessions(spark, sf):
    """ST4: liveness as session windows; a session that had ended when the last event of all came is silent."""
    out = st.drained(st.sessions(stream(spark, sf)), "complete")
    last = fx.run_events(spark, sf).agg(F.max("occurred_at").cast("timestamp").alias("now"))
    return out.crossJoin(F.broadcast(last)).select("run_id", F.row_number().over(Window.partitionBy("run_id").orderBy("start")).alias("s"), "n", (F.col("end") < F.col("now")).alias("silent"))


@query(f"with {EV}, r as (select *, row_number() over (partition by run_id, stage_id, event_name order by occurred_at, event_id) as n from ev) select run_id, stage_id, event_name, n, event_id from r where n <= 3")
def stream_throttle(spark, sf):
    """ST3: the first three of each diagnostic, from the state store."""
    out = st.drained(st.throttled(stream(spark, sf)), "append")
    return out.where("kind = 'sample'").select("run_id", "stage_id", "event_name", "n", "event_id")


@query("select event_id, event_id % 120 as lag, event_id % 120 > 90 as late from events")
def late_event_lag(spark, sf):
    """ST5: lag between both clocks, on whole seconds."""
    e = fx.run_events(spark, sf).withColumn("occurred_at", F.date_trunc("second", "occurred_at")).withColumn("observed_at", F.date_trunc("second", "observed_at"))
    return st.late_events(e).select("event_id", "lag", "late")


@query(f"with {EV} select run_id, arg_max(event_id, (occurred_at, event_id)) as event_id, arg_max(event_name, (occurred_at, event_id)) as event_name from ev group by 1")
def stream_upsert(spark, sf):
    """ST7: the state of every run, upserted from a stream of changes."""
    changes = stream(spark, sf).select("run_id", "event_id", "event_name", "occurred_at")
    return st.upserted(changes, VersionedTable(spark, new_path(spark, "runs")), ["run_id"], ["occurred_at", "event_id"]).select("run_id", "event_id", "event_name")
