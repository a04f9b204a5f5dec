"""Sinks by micro-batch: every batch writes folders of its own, so that a batch that is run again changes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scriptorium.sources.shared import new_path


def written_by_batch(stream: DataFrame, split: Callable[[DataFrame], dict[str, DataFrame]], *, path: str, state: str | None = None) -> None:
    """Drain ``stream``: of every micro-batch each table that ``split`` gives goes to ``path``/name/batch=number.

    The micro-batch is computed once for all its tables.  A batch that is run again after a failure overwrites its folders.
    ``state`` is the stream's checkpoint; with that of an earlier run it goes on where that run ended."""

    def step(rows: DataFrame, batch: int) -> None:
        rows.persist()
        for name, table in split(rows).items():
            table.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch}")
        rows.unpersist()

    state = state or new_path(stream.sparkSession, "stream-state")
    stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(step).start().awaitTermination()


def stored(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """What all batches wrote, with their number in ``batch``."""
    return spark.read.schema(f"{schema}, batch long").option("basePath", f"{path}/{name}").parquet(f"{path}/{name}/batch=*")


def drained_by_batch(stream: DataFrame) -> DataFrame:
    """All rows of a finite stream with the number of the micro-batch that gave them."""
    path = new_path(stream.sparkSession, "stream")
    written_by_batch(stream, lambda rows: {"rows": rows}, path=path)
    return stored(stream.sparkSession, path, "rows", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema))
