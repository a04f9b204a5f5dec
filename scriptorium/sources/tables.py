"""Scans and sinks: raw files, event logs, catalogues; upserts, replacements, deletes, imports."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Encodings of raw files, in the order of trial.
ENCODINGS = ("utf-8", "gb18030", "big5", "latin-1")


@F.pandas_udf(StringType())
def decoded(content: pd.Series) -> pd.Series:
    """Bytes in the first encoding that fits."""

    def one(data):
        for encoding in ENCODINGS:
            try:
                return data.decode(encoding)
            except UnicodeDecodeError:
                continue
        return None

    return content.map(lambda data: None if data is None else one(data))


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.str.normalize("NFC")


@lru_cache(None)
def unsettled() -> str:
    """A class of characters without which a text is in NFC: marks, those that NFC replaces or joins with the one before, with
    gaps of up to 64 between them, and those that the JVM does not know."""
    joins = {int(parts[1], 16) for c in range(0x80, 0x110000) if len(parts := unicodedata.decomposition(chr(c)).split()) == 2 and "<" not in parts[0]} | {*range(0x1160, 0x1200)}
    spans = []
    for c in range(0x80, 0x110000):
        if c in joins and unicodedata.category(chr(c))[0] != "M" or not 0xD800 <= c < 0xE000 and not unicodedata.is_normalized("NFC", chr(c)):
            if spans and c - spans[-1][1] <= 64:
                spans[-1][1] = c
            else:
                spans.append([c, c])
    return "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in spans) + r"\p{M}\p{Cn}]"


def composed(text: Column) -> Column:
    """Unicode NFC; a text without a character that NFC may touch is composed as it is and is not sent to Python."""
    return F.coalesce(nfc(F.when(text.rlike(unsettled()), text)), text)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of raw files; valid UTF-8 stays in the JVM, only other files are decoded in Python.
    Spark's scan leaves out files without any byte."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return files.select("path", F.coalesce(text, F.when(text.isNull(), decoded("content"))).alias("text"))


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Run logs as JSON lines; a line that does not parse stops the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_catalogue(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def append_events(events: DataFrame, path: str, most: int = 1_000_000) -> None:
    """Append-only sink, a folder for each date, files of a bounded number of rows."""
    events.withColumn("date", F.to_date("occurred_at")).write.mode("append").partitionBy("date").option("maxRecordsPerFile", most).json(path)


def upsert(target: DataFrame, source: DataFrame, keys: list[str], keep_if_null: tuple[str, ...] = (), delete_missing: bool = False) -> DataFrame:
    """The target after an upsert: a source row replaces that of its key; a null in ``keep_if_null`` keeps the old value."""
    s, t = source.withColumn("_s", F.lit(True)).alias("s"), target.withColumn("_t", F.lit(True)).alias("t")
    both = s.join(t, [F.col(f"s.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys], "left" if delete_missing else "full")

    def value(name: str) -> Column:
        new, old = F.col(f"s.{name}"), F.col(f"t.{name}")
        return (F.coalesce(new, old) if name in keep_if_null else F.when(F.col("_s"), new).otherwise(old)).alias(name)

    return both.select(*[value(c) for c in target.columns])


def partial_update(target: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Non-null values of ``updates`` replace those of the target; no row is added."""
    new = [c for c in updates.columns if c not in keys]
    both = target.join(updates.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in new]), keys, "left")
    return both.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in new else F.col(c) for c in target.columns])


def replace_by_key(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """All target rows of the source's keys give way to the source's rows."""
    return target.join(source.select(key).distinct(), key, "left_anti").select(*target.columns).unionByName(source)


def cascade_delete(tables: dict[str, DataFrame], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    return {name: t.join(gone.select(key).distinct(), key, "left_anti") for name, t in tables.items()}


def import_rows(rows: DataFrame, id_map: DataFrame, key: str) -> DataFrame:
    """Rows under new ids, by a map (old_id, new_id); rows without an entry are left out."""
    return rows.join(id_map, F.col(key) == F.col("old_id")).withColumn(key, F.col("new_id")).drop("old_id", "new_id")


def sync_status(results: DataFrame) -> DataFrame:
    """Totals of a sync and its status."""
    count = lambda s: F.count_if(F.col("status") == s)
    one = results.agg(F.count("*").alias("total"), count("succeeded").alias("succeeded"), count("failed").alias("failed"), count("skipped").alias("skipped"))
    return one.withColumn("status", F.when(F.col("failed") == 0, "success").when(F.col("succeeded") > 0, "degraded").otherwise("failed"))


SEARCH_CASE = "id string, query string, document_type string, filters string, judgments string, require_diversity boolean, require_neighbors boolean, broken string"


def read_search_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation queries as JSON lines, with the first structural fault of each in ``issue``, null for none: no JSON object,
    a required field that is missing or empty, or filters or judgments that are no map.  Absent maps are empty."""
    rows = spark.read.schema(SEARCH_CASE).option("columnNameOfCorruptRecord", "broken").json(path)
    no_map = lambda c: F.col(c).isNotNull() & ~F.startswith(F.ltrim(c), F.lit("{"))
    missing = [F.when(F.coalesce(c, F.lit("")) == "", f"missing {c}") for c in ("id", "query", "document_type")]
    issue = F.coalesce(F.when(F.col("broken").isNotNull(), "no object"), *missing, *[F.when(no_map(c), f"{c} is no map") for c in ("filters", "judgments")])
    read = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    return rows.withColumn("issue", issue).withColumns({c: F.when(F.col("issue").isNull(), read(c)) for c in ("filters", "judgments")})
