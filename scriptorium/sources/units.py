"""Runs over many units in stages that can be broken off and taken up again.

A stage maps a table of units to a table of their results; a result of which ``failed`` is true does not count.  Results
are written in parts, by the hash of the unit, and a part counts once it is in the log.  The next run does what the log
does not have: units without a result, and units whose earlier stage was done anew since.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A stage: its name and the function from (id, ...) to (id, failed, ...).
Stage = tuple[str, Callable[[DataFrame], DataFrame]]
LOG = "stage string, attempt long, part int"


class UnitRuns:
    """Runs under ``path``; one at a time.  ``parts`` of a stage are done one after the other."""

    def __init__(self, spark: SparkSession, path: str, *, id: str, parts: int = 8):
        self.spark, self.path, self.id, self.parts = spark, path, id, parts

    def log(self) -> DataFrame:
        """(stage, attempt, part) of all parts that were written whole."""
        try:
            return self.spark.read.schema(LOG).json(f"{self.path}/log")
        except Exception as error:
            if "PATH_NOT_FOUND" in str(error):
                return self.spark.createDataFrame([], LOG)
            raise

    def attempts(self, stage: str) -> DataFrame | None:
        """All results of a stage that count, with the ``attempt`` that they come from; None before there is any."""
        done = [(r["attempt"], r["part"]) for r in self.log().where(F.col("stage") == stage).distinct().collect()]  # a record for each attempt and part
        if not done:
            return None
        paths = [f"{self.path}/{stage}/attempt={a}/part={p}" for a, p in done]
        return self.spark.read.option("basePath", f"{self.path}/{stage}").parquet(*paths).where("not failed").drop("failed", "part")

    def results(self, stage: str) -> DataFrame | None:
        """The newest result of every unit of a stage, with its ``attempt``."""
        rows = self.attempts(stage)
        if rows is None:
            return None
        others = [c for c in rows.columns if c != self.id]
        return rows.groupBy(self.id).agg(F.max_by(F.struct(*others), "attempt").alias("row")).select(self.id, "row.*")

    def pending(self, units: DataFrame, stage: str) -> DataFrame:
        """The ``units`` (id, attempt, ...) that a stage has no result for, or an older one than the unit itself."""
        done = self.results(stage)
        if done is None:
            return units
        fresh = done.select(F.col(self.id), F.col("attempt").alias("_done"))
        return units.join(fresh, self.id, "left").where("_done is null or _done < attempt").drop("_done")

    def run(self, units: DataFrame, stages: list[Stage]) -> DataFrame | None:
        """Do what is missing, stage by stage, and return the results of the last one."""
        attempt = (self.log().agg(F.max("attempt")).first()[0] or 0) + 1
        given = units.withColumn("attempt", F.lit(0).cast("long"))
        for stage, work in stages:
            todo, part = self.pending(given, stage), F.pmod(F.xxhash64(self.id), F.lit(self.parts))
            for p in range(self.parts):
                path = f"{self.path}/{stage}/attempt={attempt}/part={p}"
                work(todo.where(part == p).drop("attempt")).write.mode("overwrite").parquet(path)
                self.spark.createDataFrame([(stage, attempt, p)], LOG).coalesce(1).write.mode("append").json(f"{self.path}/log")
            given = self.results(stage)
        return given
