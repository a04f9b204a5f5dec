"""Streams over both forms of the events table, and throttling over more than one Arrow chunk."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from scriptorium.plans import events as plan
from scriptorium.sources.shared import VersionedTable, new_path
from scriptorium.streaming import events as st
from scriptorium.streaming.sinks import drained_by_batch, stored, written_by_batch
from scriptorium.streaming.stateful import silences, throttled_episodes

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("parts", [0, 3])
def test_stream_reads_a_file_and_a_folder_of_parts(spark, tmp_path, parts):
    table, rows = tmp_path / "neutral" / "events.parquet", pd.read_parquet(f"{SF}/events.parquet")
    (table if parts else table.parent).mkdir(parents=True)
    for i in range(parts):
        rows[rows["event_id"] % parts == i].to_parquet(table / f"part-{i:05d}.parquet", coerce_timestamps="us")
    if not parts:
        rows.to_parquet(table, coerce_timestamps="us")
    got = plan.stream_dedupe(spark, str(table.parent)).toPandas()
    assert sorted(got["event_id"]) == sorted(rows["event_id"])


def test_throttle_takes_the_earliest_of_all_chunks(spark, tmp_path):
    t0 = pd.Timestamp("2024-01-01")
    rows = pd.DataFrame({"event_id": range(50), "occurred_at": [t0 + pd.Timedelta(seconds=50 - i) for i in range(50)]})
    (tmp_path / "rows").mkdir()
    rows.to_parquet(tmp_path / "rows" / "part-0.parquet", coerce_timestamps="us")
    e = spark.readStream.schema("event_id long, occurred_at timestamp").parquet(str(tmp_path / "rows"))
    e = e.withColumns({"run_id": F.lit(1).cast("long"), "stage_id": F.lit(1).cast("long"), "event_name": F.lit("a")})
    key, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(key, 2)
    try:
        got = st.drained(st.throttled(e), "append").where("kind = 'sample'").toPandas()
    finally:
        spark.conf.set(key, before)
    assert got.sort_values("n")["event_id"].tolist() == [49, 48, 47]


def test_upsert_keeps_the_newest_row_whichever_file_it_comes_in(spark, tmp_path):
    for i, rows in enumerate([[(1, 5, "new"), (2, 1, "only")], [(1, 3, "old"), (3, 7, "late")]]):
        pd.DataFrame(rows, columns=["k", "at", "v"]).to_parquet(tmp_path / f"part-{i}.parquet")
    changes = spark.readStream.schema("k long, at long, v string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    table = VersionedTable(spark, new_path(spark, "upserted"))
    got = st.upserted(changes, table, ["k"], ["at"])
    assert sorted(r["v"] for r in got.collect()) == ["late", "new", "only"]
    assert table.version() == 2


def arriving(spark, path, slices):
    """A stream of events (run_id, stage_id, event_name, event_id, occurred_at), one slice in each micro-batch; times are minutes
    from the thousandth, since what lies at the watermark's beginning is late."""
    for rows in slices:
        own = [(1, "a", *r) for r in rows]
        df = spark.createDataFrame(own, "stage_id long, event_name string, run_id long, event_id long, minute double")
        df.select("run_id", "stage_id", "event_name", "event_id", F.timestamp_seconds(F.col("minute") * 60 + 60_000).alias("occurred_at")).coalesce(1).write.mode("append").parquet(str(path))
    schema = "run_id long, stage_id long, event_name string, event_id long, occurred_at timestamp"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


SLICES = [[(1, 1, 0.0), (1, 2, 50.0), (2, 3, 55.0)], [(2, 4, 100.0)], [(2, 5, 150.0), (2, 6, 155.0)], [(2, 7, 200.0)], [(1, 8, 240.0), (2, 9, 245.0)], [(3, 10, 330.0)], [(3, 11, 331.0)]]


def test_a_silent_run_is_flagged_while_the_stream_goes_on(spark, tmp_path):
    got = drained_by_batch(silences(arriving(spark, tmp_path / "in", SLICES), 3600)).collect()
    found = {(r["run_id"], r["silent_since"].timestamp() / 60 - 1000, r["n"]): r["batch"] for r in got}
    assert found.keys() == {(1, 50.0, 2), (1, 240.0, 1), (2, 245.0, 6)}
    assert found[1, 50.0, 2] < 4  # before the run's next event, and long before the last batch
    assert max(found.values()) > 4


def test_diagnostics_are_sampled_and_totalled_by_episodes(spark, tmp_path):
    got = drained_by_batch(throttled_episodes(arriving(spark, tmp_path / "in", SLICES), 3600, first=2)).collect()
    rows = sorted((r["run_id"], r["kind"], r["n"], r["event_id"]) for r in got)
    assert rows == [(1, "sample", 1, 1), (1, "sample", 1, 8), (1, "sample", 2, 2), (1, "total", 1, -1), (1, "total", 2, -1), (2, "sample", 1, 3), (2, "sample", 2, 4), (2, "total", 6, -1), (3, "sample", 1, 10), (3, "sample", 2, 11)]


def test_the_first_of_repeated_events_wins_across_batches(spark, tmp_path):
    slices = [[(1, 7, 0.0)], [(2, 7, 5.0), (1, 8, 30.0)], [(1, 9, 40.0)], [(3, 7, 60.0)]]
    events = arriving(spark, tmp_path / "in", slices).withWatermark("occurred_at", "10 minutes").dropDuplicatesWithinWatermark(["event_id"])
    got = sorted((r["event_id"], r["run_id"]) for r in drained_by_batch(events).collect())
    assert got == [(7, 1), (7, 3), (8, 1), (9, 1)]  # the repeat within the watermark went, the one after its expiry did not


def test_both_sinks_of_a_batch_are_overwritten_when_it_runs_again(spark, tmp_path):
    path, state = str(tmp_path / "out"), str(tmp_path / "state")
    stream = arriving(spark, tmp_path / "in", SLICES[:2])
    split = lambda rows: {"even": rows.where("event_id % 2 = 0").select("event_id"), "odd": rows.where("event_id % 2 = 1").select("event_id")}
    for again in range(2):  # the second time with a new checkpoint: all batches run again
        written_by_batch(stream, split, path=path, state=f"{state}{again}")
        assert sorted(r["event_id"] for r in stored(spark, path, "even", "event_id long").collect()) == [2, 4]
        assert sorted((r["event_id"], r["batch"]) for r in stored(spark, path, "odd", "event_id long").collect()) == [(1, 0), (3, 0)]
