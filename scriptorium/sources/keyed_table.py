"""A keyed table that is merged on read: changes go to files of their hash buckets, the newest row of a key wins.

A batch of changes writes its own folder and in it the buckets of its keys, nothing else; written again it overwrites just
that.  Reading takes the base of each bucket and the batches after it.  Compaction writes new bases for the buckets that
changed and lists them in one record, with the last batch that each holds; what is not listed does not count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


class KeyedTable:
    """Rows of ``schema`` by ``keys`` under ``path``; of two rows of a key the one of the greater ``order`` stays, and of equal
    ones the greater row.  A bucket is written by one task, so there should be as many as make buckets of a task's size;
    their number stays as it was at first.  One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, *, keys: list[str], order: list[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.keys, self.order, self.buckets = spark, path, schema, keys, order, buckets

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets))

    def _newest(self, rows: DataFrame) -> DataFrame:
        """One row for each key; keys are grouped with their nulls."""
        row = F.struct(*[F.col(c) for c in self.order], F.struct(*self.schema.names).alias("row"))
        return rows.groupBy("bucket", *self.keys).agg(F.max(row).alias("newest")).select("bucket", "newest.row.*")

    def apply(self, rows: DataFrame, batch: int) -> None:
        """Store a batch of changes, numbered in the order of time from 0; the same batch again changes nothing."""
        if batch <= self.compacted():
            return  # the bases hold it already
        once = self._newest(rows.select(*self.schema.names, self._bucket().alias("bucket")))
        once.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/changes/batch={batch}")

    def compacted(self) -> int:
        """The last batch that the bases hold, -1 for none."""
        return max((through for _, through in self._bases().values()), default=-1)

    def _bases(self) -> dict[int, tuple[int, int]]:
        """Bucket -> (version of its base, last batch in it); at most as many as buckets."""
        try:
            log = self.spark.read.schema("bucket int, version long, through long").json(f"{self.path}/log")
            newest = log.groupBy("bucket").agg(F.max(F.struct("version", "through")).alias("n")).select("bucket", "n.*").collect()
        except Exception as error:
            if "PATH_NOT_FOUND" in str(error):
                return {}
            raise
        return {r["bucket"]: (r["version"], r["through"]) for r in newest}

    def _stored(self, kind: str, paths: list[str]) -> DataFrame | None:
        more = [StructField("bucket", LongType()), StructField("batch" if kind == "changes" else "version", LongType())]
        read = self.spark.read.schema(StructType([*self.schema.fields, *more])).option("basePath", f"{self.path}/{kind}")
        try:
            return read.parquet(*paths)
        except Exception as error:
            if "PATH_NOT_FOUND" in str(error):
                return None
            raise

    def changes(self) -> DataFrame | None:
        """Changes that no base holds, with ``bucket`` and ``batch``; which folders are read is settled by their names."""
        rows = self._stored("changes", [f"{self.path}/changes/batch=*"])
        return None if rows is None else rows.where(F.col("batch") > self.compacted())

    def _rows(self) -> DataFrame:
        base = self._stored("base", [f"{self.path}/base/version={v}/bucket={b}" for b, (v, _) in self._bases().items()]) if self._bases() else None
        parts = [rows.select(*self.schema.names, "bucket") for rows in (base, self.changes()) if rows is not None]
        none = self.spark.createDataFrame([], StructType([*self.schema.fields, StructField("bucket", LongType())]))
        return none if not parts else parts[0] if len(parts) == 1 else parts[0].union(parts[1])

    def read(self) -> DataFrame:
        return self._newest(self._rows()).select(*self.schema.names)

    def compact(self) -> list[int]:
        """New bases for all buckets that have changes; returns them."""
        changes, bases = self.changes(), self._bases()
        last = {} if changes is None else {r["bucket"]: r["last"] for r in changes.groupBy("bucket").agg(F.max("batch").alias("last")).collect()}  # at most as many as buckets
        if not last:
            return []
        version = max((v for v, _ in bases.values()), default=0) + 1
        touched = self._newest(self._rows().where(F.col("bucket").isin(list(last))))
        touched.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/base/version={version}")
        through = max(last.values())
        # The others keep their bases, which hold all batches so far as well.
        log = [(b, version if b in last else bases[b][0], through) for b in sorted({*last, *bases})]
        self.spark.createDataFrame(log, "bucket int, version long, through long").coalesce(1).write.mode("append").json(f"{self.path}/log")
        return sorted(last)
