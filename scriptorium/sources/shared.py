"""Tables in the folder that driver and executors share, and versioned tables with a pointer to the current version."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@lru_cache(None)
def one_machine_dir(application: str) -> str:
    return f"file://{tempfile.mkdtemp(prefix='spark-')}"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir.

    Where none is configured a temporary folder serves, but only for a local master, whose tasks all see it; on a
    cluster that is an error, since no folder of one machine would do."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if spark.sparkContext.master.startswith("local"):
        return one_machine_dir(spark.sparkContext.applicationId)
    raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")


@lru_cache(None)
def application_dir(folder: str, application: str) -> str:
    """A folder of this application under ``folder``, which Hadoop deletes when the driver's JVM ends."""
    spark = SparkSession.getActiveSession()
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/scriptorium/{application}")
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return path.toString()


def new_path(spark: SparkSession, label: str) -> str:
    return f"{application_dir(shared_dir(spark), spark.sparkContext.applicationId)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back, which cuts the lineage.

    Lost executors cost a re-read at most.  The tables go when the application ends.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class VersionedTable:
    """Parquet versions under one folder and a pointer table with the newest version that was written whole.

    One writer at a time; readers always see a whole version.  A failed write leaves the pointer as it was.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def version(self) -> int:
        try:
            return self.spark.read.schema("version long").json(f"{self.path}/pointer").agg(F.max("version")).first()[0] or 0
        except Exception as error:
            if "PATH_NOT_FOUND" in str(error):
                return 0
            raise

    def read(self) -> DataFrame | None:
        version = self.version()
        return self.spark.read.parquet(f"{self.path}/v{version}") if version else None

    def write(self, rows: DataFrame) -> int:
        version = self.version() + 1
        rows.write.mode("overwrite").parquet(f"{self.path}/v{version}")
        self.spark.createDataFrame([(version,)], "version long").coalesce(1).write.mode("append").json(f"{self.path}/pointer")
        return version
