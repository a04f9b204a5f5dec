"""Registered queries: streams over several micro-batches, the events arriving by days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium import fixtures as fx
from scriptorium.registry import query
from scriptorium.sources.shared import new_path, written
from scriptorium.streaming import events as st
from scriptorium.streaming import sinks
from scriptorium.streaming import stateful as sf_

#: Days whose events come in one micro-batch, and files of a micro-batch.
DAYS, FILES = 8, 2
EVENT = "event_id long, run_id long, stage_id long, event_name string, occurred_at timestamp, observed_at timestamp, k long, delivery int"


def arriving(events: DataFrame, at: str, days: int = DAYS) -> DataFrame:
    """``events`` as a stream in the order of their time ``at``: ``days`` days come in a micro-batch.

    The stream's source goes by the files' times, so each slice is written after the one before it."""
    spark = events.sparkSession
    path, slice_of = new_path(spark, "arriving"), F.floor(F.unix_seconds(at) / (86_400 * days)).alias("slice")
    sliced = written(events.select("*", slice_of), "slices")
    for row in sorted(r["slice"] for r in sliced.select("slice").distinct().collect()):  # as many as micro-batches
        sliced.where(F.col("slice") == row).drop("slice").repartition(FILES).write.mode("append").parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", FILES).parquet(path)


def run_events(spark, sf) -> DataFrame:
    """Events in UTC with their delivery, 0 for the first."""
    e = fx.run_events(spark, sf).withColumn("delivery", F.lit(0))
    stamps = {c: F.col(c).cast("timestamp") for c in ("occurred_at", "observed_at")}
    return e.withColumns(stamps).select(*[c.split()[0] for c in EVENT.split(", ")])


@query("select event_id, user_id as run_id, false as replayed from events union all select event_id, user_id, true from events where event_id % 5 = 0")
def stream_repeats(spark, sf):
    """ST1: a third of the events comes again after five minutes and is dropped, a fifth of them again after ten days, when
    the watermark has passed and their state has gone."""
    e = run_events(spark, sf)
    later = lambda rows, delivery, seconds: rows.withColumns({"delivery": F.lit(delivery), "observed_at": F.col("observed_at") + F.make_interval(secs=F.lit(seconds))})
    every = e.union(later(e.where("event_id % 3 = 0"), 1, 300)).union(later(e.where("event_id % 5 = 0"), 2, 864_000))
    once = arriving(every, "observed_at", 4).withWatermark("observed_at", "10 minutes").dropDuplicatesWithinWatermark(["event_id"])
    return sinks.drained_by_batch(once).select("event_id", "run_id", (F.col("delivery") == 2).alias("replayed"))


#: Episodes of (run) or (run, stage, name): an event begins one if the one before it is longer ago than the gap.
EPISODES = """g as (select *, ts - lag(ts) over w > interval {gap} hours as later from e window w as (partition by {key} order by ts, event_id)),
 p as (select *, sum(coalesce(later, true)::int) over (partition by {key} order by ts, event_id rows unbounded preceding) as episode from g),
 n as (select *, row_number() over (partition by {key}, episode order by ts, event_id) as nth from p),
 t as (select {key}, episode, count(*) as n, max(ts) as last, max(max(ts)) over () - interval 10 minutes as watermark, max(episode) over (partition by {key}) as newest from p group by {key}, episode),
 ended as (select * from t where episode < newest or last + interval {gap} hours < watermark)"""
EVENTS = "e as (select event_id, user_id as run_id, event_id % 4 as stage_id, event_type as event_name, ts from events)"


@query(f"with {EVENTS}, {EPISODES.format(key='run_id', gap=1)} select run_id, strftime(last, '%Y-%m-%d %H:%M:%S') as silent_since, n, true as in_time from ended")
def stream_silences(spark, sf):
    """ST4: runs that went silent for an hour, told by timers while the stream goes on: every silence is known in the
    micro-batch that brings the watermark beyond it, or the one after it, not when all is over."""
    found = written(sinks.drained_by_batch(sf_.silences(arriving(run_events(spark, sf), "occurred_at"))), "silences")
    first = F.floor(F.unix_seconds("silent_since") / (86_400 * DAYS))
    begin = found.agg(F.min(first).alias("begin"))
    in_time = F.col("batch") <= first - F.col("begin") + 2
    return found.crossJoin(F.broadcast(begin)).select("run_id", F.date_format("silent_since", "yyyy-MM-dd HH:mm:ss").alias("silent_since"), "n", in_time.alias("in_time"))


KEY = "run_id, stage_id, event_name"


@query(f"with {EVENTS}, {EPISODES.format(key=KEY, gap=48)} select {KEY}, 'sample' as kind, nth as n, event_id from n where nth <= 3 union all select {KEY}, 'total', n, -1 from ended")
def stream_diagnostics(spark, sf):
    """ST3: the first three diagnostics of a key, and the total of all when none came for two days."""
    return sinks.drained_by_batch(sf_.throttled_episodes(arriving(run_events(spark, sf), "occurred_at"), 48 * 3600)).drop("batch")


LATE_SECONDS = 90
ON_TIME = f"select * from events where event_id % 120 <= {LATE_SECONDS}"


def split_by_lag(spark, sf) -> str:
    """The folder to which one stream writes late events and all others, by micro-batch."""
    path, names = new_path(spark, "by-lag"), [c.split()[0] for c in EVENT.split(", ")]

    def split(rows: DataFrame) -> dict[str, DataFrame]:
        told = st.late_events(rows, LATE_SECONDS)
        return {"late": told.where("late").select(*names, "lag"), "others": told.where("not late").select(*names)}

    sinks.written_by_batch(arriving(run_events(spark, sf), "observed_at"), split, path=path)
    return path


@query(f"select event_id, event_id % 120 as lag from events where event_id % 120 > {LATE_SECONDS}")
def stream_late_side_output(spark, sf):
    """ST5: the side table of late events."""
    return sinks.stored(spark, split_by_lag(spark, sf), "late", f"{EVENT}, lag long").select("event_id", "lag")


@query(f"with o as ({ON_TIME}), w as (select max(ts) - interval 10 minutes as watermark from o) select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, event_type as event_name, count(*) as n from o, w where date_trunc('day', ts) + interval 1 day <= watermark group by 1, 2")
def stream_closed_days(spark, sf):
    """ST5: counts of the events that came in time, by days, each once it is over: in append mode under a watermark."""
    path = split_by_lag(spark, sf)
    others = spark.readStream.schema(f"{EVENT}, batch long").option("maxFilesPerTrigger", FILES).parquet(f"{path}/others")
    out = sinks.drained_by_batch(st.windowed_counts(others, "1 day"))
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_name", "n")
