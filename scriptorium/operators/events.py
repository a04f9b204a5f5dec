"""Run events in batch: summaries, roll-ups, baselines, cost."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def deduplicated(events: DataFrame) -> DataFrame:
    """One row for each event_id, the first by time observed."""
    first = Window.partitionBy("event_id").orderBy("observed_at", "occurred_at")
    return events.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def run_summary(events: DataFrame) -> DataFrame:
    """(run_id, calls, completed, errors, tokens, cost, last_event): cost is null where any part of it is unknown."""
    return events.groupBy("run_id").agg(
        F.count("*").alias("calls"), F.count_if(F.col("event_name") == "purchase").alias("completed"), F.count_if(F.col("event_name") == "error").alias("errors"), F.sum("k").alias("tokens"),
        F.when(F.count_if(F.col("duration_ms").isNull()) == 0, F.round(F.sum("duration_ms"), 4)).alias("cost"), F.max_by("event_name", F.struct("occurred_at", "event_id")).alias("last_event"),
    )


def diagnostic_rollup(events: DataFrame, samples: int = 3) -> DataFrame:
    """(run_id, stage_id, event_name, total, samples): totals with the first samples."""
    order = Window.partitionBy("run_id", "stage_id", "event_name").orderBy("occurred_at", "event_id")
    numbered = events.withColumn("n", F.row_number().over(order))
    kept = F.array_sort(F.collect_list(F.when(F.col("n") <= samples, F.struct("n", "event_id"))))
    return numbered.groupBy("run_id", "stage_id", "event_name").agg(F.count("*").alias("total"), F.array_join(F.transform(kept, lambda s: s["event_id"].cast("string")), ",").alias("samples"))


def stage_costs(events: DataFrame) -> DataFrame:
    """Per stage of a run: tokens, calls, error rate, share of the run's time, tokens per call."""
    one = events.groupBy("run_id", "stage_id").agg(F.sum("k").alias("tokens"), F.count("*").alias("calls"), F.count_if(F.col("event_name") == "error").alias("errors"), F.sum("duration_ms").alias("ms"))
    share = F.col("ms") / F.sum("ms").over(Window.partitionBy("run_id"))
    return one.select("run_id", "stage_id", "tokens", "calls", F.round(F.col("errors") / F.col("calls"), 6).alias("error_rate"), F.round(share, 6).alias("share"), F.round(F.col("tokens") / F.col("calls"), 6).alias("per_call"))


def duration_baseline(runs: DataFrame) -> DataFrame:
    """Adds ``baseline`` (median duration of the last three successful runs before) and ``delta`` in percent.

    A success knows its two forerunners by ``lag``; every run then takes over what the last success before it knows.  All
    frames grow by a row at a time, so that a work of many runs costs a sort and no more."""
    own = Window.partitionBy("material_id", "ok").orderBy("started_at", "run_id")
    before = Window.partitionBy("material_id").orderBy("started_at", "run_id").rowsBetween(Window.unboundedPreceding, -1)
    known = F.array_sort(F.array_compact(F.array("ms", F.lag("ms", 1).over(own), F.lag("ms", 2).over(own))))
    marked = runs.repartition("material_id").withColumn("_k", F.when(F.col("ok"), known)).withColumn("_g", F.last("_k", ignorenulls=True).over(before))
    return marked.withColumn("baseline", median("_g")).withColumn("delta", F.round(100 * (F.col("ms") - F.col("baseline")) / F.col("baseline"), 4)).drop("_g", "_k")


def median(array: str):
    """Median of a sorted array."""
    n = F.size(array)
    return F.round((F.element_at(array, F.floor((n + 1) / 2).cast("int")) + F.element_at(array, F.floor(n / 2).cast("int") + 1)) / 2, 4)


def remaining_estimate(progress: DataFrame, window: int = 5) -> DataFrame:
    """Adds ``eta``: the median rate of the last batches times what is left; null under two batches."""
    recent = Window.partitionBy("run_id").orderBy("occurred_at", "event_id").rowsBetween(1 - window, 0)
    rates = progress.withColumn("_r", F.array_sort(F.collect_list("rate").over(recent)))
    return rates.withColumn("eta", F.when(F.size("_r") >= 2, F.round(median("_r") * F.col("left"), 3))).drop("_r")


def retained(files: DataFrame, newest: int, most: int) -> DataFrame:
    """(day, file, keep) of log files (day, file): those of the ``newest`` days stay, and of these the ``most`` latest by
    day and name.  Days are numbered by a count of the later ones, files by the days' totals before and a rank within
    the day."""
    days = files.groupBy("day").agg(F.count("*").alias("n"))
    # One row a day: a window over all of them is as long as the log's history in days.
    latest = Window.orderBy(F.desc("day"))
    placed = days.withColumn("nth", F.row_number().over(latest)).withColumn("before", F.coalesce(F.sum("n").over(latest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("day").orderBy(F.desc("file")))
    return files.withColumn("rank", rank).join(placed, "day").select("day", "file", ((F.col("nth") <= newest) & (F.col("before") + F.col("rank") <= most)).alias("keep"))
