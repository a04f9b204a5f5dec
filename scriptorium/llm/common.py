"""Shared pieces: table access, fold predicates, boxed rows and Arrow batch helpers."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scriptorium.sources.shared import written

__all__ = ["BOX", "blocks", "boxed", "extended", "fitted", "fold", "in_share", "sampled", "table", "unboxed", "with_columns", "written"]

#: Bytes of text handled at once inside a Python worker.
BLOCK_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str, modulus: int, remainder: int) -> Column:
    """True where crc32(key as text) mod ``modulus`` is ``remainder``; a null key counts as empty text."""
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % modulus == remainder


def in_share(id: Column, share: float) -> Column:
    """True where the id's hash falls into the first ``share`` of all hashes."""
    return F.pmod(F.xxhash64(id), F.lit(1 << 30)) < F.lit(int(min(1.0, share) * (1 << 30)))


def sampled(rows: DataFrame, id: str, share: float) -> DataFrame:
    """The rows whose id's hash falls into the first ``share`` of all hashes."""
    return rows.where(in_share(F.col(id), share))


def fitted(sample: DataFrame, fit: Callable[[list[tuple]], dict]) -> dict | None:
    """Weights of a model that one task fits on a bounded sample; only they come back to the driver.

    The rows are put in order first, so that the fit does not depend on how they arrived.  None without any row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(rows))], pa.binary())], names=["weights"])

    found = sample.repartition(1).mapInArrow(run, "weights binary").collect()
    return pickle.loads(found[0]["weights"]) if found else None


def blocks(texts: list, limit: int = BLOCK_BYTES, most: int = 10_000) -> Iterator[tuple[int, list]]:
    """Consecutive runs of about ``limit`` characters and at most ``most`` texts, each with its first index; a longer
    text stands alone."""
    start, size, run = 0, 0, []
    for i, text in enumerate(texts):
        n = len(text)
        if run and (size + n > limit or len(run) >= most):
            yield start, run
            start, size, run = i, 0, []
        run.append(text)
        size += n
    if run:
        yield start, run


def with_columns(batch: pa.RecordBatch, keep: list[str], **columns) -> pa.RecordBatch:
    """The columns ``keep`` of ``batch`` followed by new ones."""
    names = [*keep, *columns]
    return pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(k)) for k in keep] + [v if isinstance(v, pa.Array) else pa.array(v) for v in columns.values()], names=names)


def extended(schema: StructType, ddl: str) -> StructType:
    """A new schema: the fields of ``schema`` and those of ``ddl``."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


#: The column that holds all of a caller's columns while an operator works with columns of its own.
BOX = "caller"


def boxed(docs: DataFrame, columns: list[str], **own: Column) -> DataFrame:
    """The caller's ``columns`` in one struct, beside columns of the operator's own, so that no names can clash."""
    return docs.select(F.struct(F.lit(None).cast("int"), *columns).alias(BOX), *[c.alias(k) for k, c in own.items()])


def unboxed(columns: list[str], schema: StructType) -> list[Column]:
    """The caller's columns out of the struct, by place: their names may be any."""
    return [F.col(BOX)[schema[BOX].dataType.names[i + 1]].alias(c) for i, c in enumerate(columns)]
