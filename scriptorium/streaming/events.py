"""Run events as streams.  Every function takes a streaming DataFrame and returns one; state is bounded by a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.sources.keyed_table import KeyedTable
from scriptorium.sources.shared import VersionedTable, new_path

LATE = "10 minutes"


def deduplicated(events: DataFrame, late: str = LATE) -> DataFrame:
    """First of each event_id within the watermark."""
    return events.withWatermark("occurred_at", late).dropDuplicatesWithinWatermark(["event_id"])


def running_summary(events: DataFrame) -> DataFrame:
    """Totals of every run, for update or complete mode."""
    return events.groupBy("run_id").agg(F.count("*").alias("calls"), F.count_if(F.col("event_name") == "error").alias("errors"), F.sum("k").alias("tokens"))


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = LATE) -> DataFrame:
    return events.withWatermark("occurred_at", late).groupBy(F.window("occurred_at", width), "event_name").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_name", "n")


def sessions(events: DataFrame, gap: str = "60 minutes", late: str = LATE) -> DataFrame:
    """Stretches of a run without a silence longer than ``gap``: a run whose last session is over is silent."""
    return events.withWatermark("occurred_at", late).groupBy(F.session_window("occurred_at", gap), "run_id").agg(F.count("*").alias("n")).select("run_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


#: Groups of keys of ``throttled``: a call and a state for each, so that keys cost no calls of their own.
BUCKETS = 2048
KEY = ["run_id", "stage_id", "event_name"]


def throttled(events: DataFrame, first: int = 3, late: str = LATE) -> DataFrame:
    """The first diagnostics of every (run, stage, name) as they come, and their total once the watermark has passed.

    State is a count and a time-out for each key, which is dropped at the time-out; keys lie in ``BUCKETS`` by their hash,
    and those of a bucket are counted together.  Within a micro-batch the first are the earliest of all its rows, however
    many Arrow chunks they come in.
    """

    def step(bucket, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        # With nullable types a null in a key stays one.
        types = {"run_id": "Int64", "stage_id": "Int64", "event_name": "object", "n": "int64", "expiry": "int64"}
        counts = pd.DataFrame(dict(zip(types, state.get if state.exists else ([],) * 5))).astype(types)
        now, came, head = state.getCurrentWatermarkMs(), [], None
        for batch in () if state.hasTimedOut else batches:
            rows = batch.astype({"run_id": "Int64", "stage_id": "Int64"})
            came.append(rows.groupby(KEY, dropna=False, sort=False).size().rename("n").reset_index())
            rows = rows[[*KEY, "occurred_at", "event_id"]]
            rows = (rows if head is None else pd.concat([head, rows])).sort_values(["occurred_at", "event_id"])
            head = rows[rows.groupby(KEY, dropna=False, sort=False).cumcount() < first]
        if came:
            new = pd.concat(came).groupby(KEY, dropna=False, sort=False)["n"].sum().reset_index().assign(expiry=now + 60_000)
            before = head.merge(counts[[*KEY, "n"]], on=KEY, how="left")["n"].fillna(0).astype("int64").to_numpy()
            nth = before + head.groupby(KEY, dropna=False, sort=False).cumcount().to_numpy() + 1
            yield head.assign(kind="sample", n=nth)[nth <= first][[*KEY, "kind", "n", "event_id"]]
            counts = (pd.concat([counts, new]) if len(counts) else new).groupby(KEY, dropna=False, sort=False).agg({"n": "sum", "expiry": "max"}).reset_index()
        over = counts["expiry"] < now
        if over.any():
            yield counts[over].assign(kind="total", event_id=-1)[[*KEY, "kind", "n", "event_id"]]
        counts = counts[~over]
        if len(counts):
            state.update(tuple([None if v is pd.NA or v is None else v for v in counts[c].tolist()] for c in types))
            state.setTimeoutTimestamp(int(counts["expiry"].min()))
        elif state.exists:
            state.remove()

    bucket = F.pmod(F.xxhash64(*KEY), F.lit(BUCKETS)).alias("bucket")
    keyed = events.withWatermark("occurred_at", late).select(*KEY, "occurred_at", "event_id", bucket).groupBy("bucket")
    states = "run_ids array<long>, stage_ids array<long>, event_names array<string>, n array<long>, expiry array<long>"
    return keyed.applyInPandasWithState(step, "run_id long, stage_id long, event_name string, kind string, n long, event_id long", states, "append", "EventTimeTimeout")


def late_events(events: DataFrame, late_seconds: int = 90) -> DataFrame:
    """Adds the lag between both clocks; rows over the limit are for the side output of a foreachBatch writer."""
    lag = F.unix_seconds("observed_at") - F.unix_seconds("occurred_at")
    return events.withColumn("lag", lag).withColumn("late", lag > late_seconds)


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """Everything that a finite stream gives, written to the shared folder: by micro-batch, so that one that runs again
    changes nothing, or the last complete result."""
    spark = stream.sparkSession
    out, state = new_path(spark, "stream"), new_path(spark, "stream-state")
    place = lambda batch: out if mode == "complete" else f"{out}/batch={batch}"
    spark.createDataFrame([], stream.schema).write.parquet(place(-1))
    sink = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
    sink.foreachBatch(lambda rows, batch: rows.write.mode("overwrite").parquet(place(batch))).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).select(*stream.columns)


def upserted(stream: DataFrame, table: VersionedTable, keys: list[str], order: list[str]) -> DataFrame | None:
    """Every micro-batch of changed rows upserted into ``table``: the newest row of a key by ``order`` stays, whichever batch
    it comes in, so that a batch that is run again changes nothing.  Each batch writes the next version of the whole
    table; readers keep the one that they began with.  Returns the table once the stream is drained."""

    def step(rows: DataFrame, _: int) -> None:
        stored = table.read()
        both = rows if stored is None else stored.unionByName(rows)
        table.write(both.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("row")).select("row.*"))

    state = new_path(stream.sparkSession, "stream-state")
    stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(step).start().awaitTermination()
    return table.read()


def merged_by_batch(stream: DataFrame, table: KeyedTable, every: int = 10, state: str | None = None) -> None:
    """Every micro-batch of changed rows stored in ``table``, in the buckets of its keys only; after each ``every`` batches
    the buckets that changed are compacted.  With the checkpoint ``state`` of an earlier run it goes on from there."""

    def step(rows: DataFrame, batch: int) -> None:
        table.apply(rows, batch)
        if batch % every == every - 1:
            table.compact()

    state = state or new_path(stream.sparkSession, "stream-state")
    stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(step).start().awaitTermination()
