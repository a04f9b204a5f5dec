"""Run reports: an append-only log of records, with the latest of each work as of any version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ReportLog:
    """Records (material_id, ...) under ``path``; a record once written never changes.  Each append is a version; one that
    fails half-way leaves no version.  One writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def versions(self) -> list[int]:
        try:
            return sorted(r["version"] for r in self.spark.read.schema("version long").json(f"{self.path}/versions").collect())
        except Exception as error:
            if "PATH_NOT_FOUND" in str(error):
                return []
            raise

    def append(self, reports: DataFrame) -> int:
        version = max(self.versions(), default=0) + 1
        reports.write.mode("overwrite").parquet(f"{self.path}/records/version={version}")
        self.spark.createDataFrame([(version,)], "version long").coalesce(1).write.mode("append").json(f"{self.path}/versions")
        return version

    def read(self, as_of: int | None = None) -> DataFrame:
        """All records up to a version, with the ``version`` that brought them."""
        known = [v for v in self.versions() if as_of is None or v <= as_of]
        if not known:
            raise ValueError(f"no report as of version {as_of}")
        return self.spark.read.option("basePath", f"{self.path}/records").parquet(*[f"{self.path}/records/version={v}" for v in known])

    def latest(self, as_of: int | None = None, order: str = "started_at") -> DataFrame:
        """The newest record of every work as of a version, by version and ``order``."""
        rows = self.read(as_of)
        others = [c for c in rows.columns if c != "material_id"]
        return rows.groupBy("material_id").agg(F.max_by(F.struct(*others), F.struct("version", order)).alias("row")).select("material_id", "row.*")
