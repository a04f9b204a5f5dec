"""Scans of file layouts with precedence: split chapter files over a merged one, vectors by number or by name."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.sources.shared import new_path

#: Tasks that write small files, and bytes that opening one counts as when files are dealt over tasks.
TASKS, OPEN_BYTES = 64, 65_536
#: What Spark's writers escape in the names of folders, and the name for none.
ESCAPED, NO_NAME = re.compile(r"[\x01-\x1f\"#%'*/:=?\\\x7f{\[\]^]"), "__HIVE_DEFAULT_PARTITION__"
CHAPTER = "chapter long, title string, type string, summary string"
MANIFEST = "dimension int, model string"


def _work(depth: int) -> Column:
    """The folder ``depth`` steps above a file, which names its work."""
    return F.element_at(F.split("_metadata.file_path", "/"), -1 - depth)


def write_files(rows: DataFrame, path: str) -> None:
    """A file for every row (name, value, ...) of strings, in folders by its other columns like those of ``partitionBy``.

    Hadoop's local file system starts a process for each file that it creates, which sets the file's mode and takes longer
    than all else.  If ``path`` is there, the tasks write the files themselves: a file has its name once it is whole, and a
    task that runs again writes the same files.  Anywhere else Spark's writer does it, with names of its own."""
    spark, folders = rows.sparkSession, [c for c in rows.columns if c not in ("name", "value")]
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = top.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    dealt = rows.repartition(TASKS, *folders, "name")
    if files.getUri().getScheme() != "file":
        # Moved into place by the tasks.
        each = dealt.drop("name").write.mode("append").partitionBy(*folders).option("maxRecordsPerFile", 1)
        return each.option("mapreduce.fileoutputcommitter.algorithm.version", 2).text(path)
    files.mkdirs(top)
    root = files.makeQualified(top).toUri().getPath()
    folder = lambda c, v: f"{c}=" + (ESCAPED.sub(lambda x: f"%{ord(x[0]):02X}", v) if v else NO_NAME)

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = set()
        for batch in batches:
            for name, value, *of in batch[["name", "value", *folders]].itertuples(index=False):
                at = "/".join([root, *map(folder, folders, of)])
                if at not in made:
                    os.makedirs(at, exist_ok=True)
                    made.add(at)
                new = f"{at}/.{name}.{uuid.uuid4().hex}"
                with open(new, "w", encoding="utf-8", newline="") as f:
                    f.write(value)
                os.replace(new, f"{at}/{name}")
            yield pd.DataFrame({"n": [len(batch)]})

    dealt.mapInPandas(put, "n long").agg(F.sum("n")).collect()


def read_chapters(spark: SparkSession, path: str, types: DataFrame | None = None) -> DataFrame:
    """(material_id, chapter, title, type, summary, layer) of all works under ``path``.

    A work is a folder with the folders ``split``, of files with an object each, or ``merged``, of files with an array, or
    with both; those may be named ``layer=split``.  Where any split file of a work can be read,
    its merged file does not count.  Files, or entries, that are no objects with a chapter number have no row.  The type of
    ``types`` (material_id, chapter, type) goes before the record's own, which is ``normal`` if it is missing."""
    read = lambda session: session.read.schema(CHAPTER).option("multiLine", True).option("mode", "DROPMALFORMED")
    one = lambda layer, session=spark: read(session).json(f"{path}/*/*{layer}").select(_work(2).alias("material_id"), *[c.split()[0] for c in CHAPTER.split(", ")], F.lit(layer).alias("layer")).where("chapter is not null")
    # Files are opened once, by tasks of many: with a session of its own this holds for no other read.
    many, parsed = spark.newSession(), new_path(spark, "split")
    many.conf.set("spark.sql.files.openCostInBytes", OPEN_BYTES)
    found = one("split", many)
    found.write.parquet(parsed)
    split = spark.read.schema(found.schema).parquet(parsed)
    rows = split.unionByName(one("merged").join(split.select("material_id").distinct(), "material_id", "left_anti"))
    if types is not None:
        rows = rows.join(types.withColumnRenamed("type", "_type"), ["material_id", "chapter"], "left").withColumn("type", F.coalesce("_type", "type")).drop("_type")
    return rows.withColumn("type", F.coalesce("type", F.lit("normal"))).select("material_id", "chapter", "title", "type", "summary", "layer")


def read_vectors(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Two tables of all works under ``path``: (material_id, key, vector), and those that are rejected with the ``reason``.

    A work is a folder with the folders ``vectors`` and ``manifest``, of files with an object: with ``chapters``, numbers, or ``keys``, names, beside ``vectors``, and with their dimension
    and model.  Numbers are read as names.  Rejected are vectors of another dimension than the manifest's or with a component that
    is missing or not finite, all of a work without a manifest, and keys without a vector."""
    files = spark.read.schema("chapters array<long>, keys array<string>, vectors array<array<double>>").json(f"{path}/*/*vectors")
    manifest = spark.read.schema(MANIFEST).json(f"{path}/*/*manifest").select(_work(2).alias("material_id"), "dimension")
    keys = F.coalesce(F.transform("chapters", lambda c: c.cast("string")), "keys")
    rows = files.select(_work(2).alias("material_id"), F.explode(F.arrays_zip(keys.alias("key"), F.col("vectors").alias("vector"))).alias("x")).select("material_id", "x.key", "x.vector")
    checked = rows.join(manifest, "material_id", "left")
    odd = F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    reason = F.when(F.col("key").isNull() | F.col("vector").isNull(), "no key or vector").when(F.col("dimension").isNull(), "no manifest").when(F.size("vector") != F.col("dimension"), "dimension").when(odd, "not finite")
    checked = checked.withColumn("reason", reason)
    return checked.where("reason is null").select("material_id", "key", "vector"), checked.where("reason is not null").select("material_id", "key", "vector", "reason")
