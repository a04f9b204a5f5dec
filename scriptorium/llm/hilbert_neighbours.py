"""Approximate nearest neighbours by shifted space-filling curves.

Each of several curves projects the vectors onto a few random orthogonal directions, shifts them at random, and orders
them by the Hilbert index of the grid cell.  Spark range-partitions every ordering.  A query's candidates are the rows
within a window around its place on each curve; blocks of consecutive rows are compared with the queries whose windows
reach them, with exact distances on the original vectors, and the best of all curves are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import written
from scriptorium.llm.near_duplicates import grouped


@dataclass(frozen=True)
class Curves:
    """``share`` of all rows lies in a query's window on each curve, and never fewer than ``least`` rows on each side."""

    curves: int = 16
    directions: int = 12
    bits: int = 4
    share: float = 0.08
    least: int = 64
    block: int = 2048
    seed: int = 10


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of integer points (rows of ``cells``), ``bits`` bits for each axis.

    Axes are untangled from the highest bit down: where an axis's bit is set the first axis is reflected below that
    bit, and else the two swap their lower bits; the Gray code of what is left gives the index.
    """
    axes = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for i in range(len(axes)):
            is_set = (axes[i] >> bit) & 1 == 1
            swap = np.where(is_set, 0, (axes[0] ^ axes[i]) & low)
            axes[0] = np.where(is_set, axes[0] ^ low, axes[0] ^ swap)
            axes[i] = axes[i] ^ swap if i else axes[0]
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    flip = np.zeros(len(cells), np.int64)
    for bit in range(bits - 1, 0, -1):
        flip = np.where((axes[-1] >> bit) & 1 == 1, flip ^ ((1 << bit) - 1), flip)
    index = np.zeros(len(cells), np.int64)
    for bit in range(bits - 1, -1, -1):
        for axis in axes:
            index = (index << 1) | (((axis ^ flip) >> bit) & 1)
    return index


def vectors_of(column: pa.Array) -> np.ndarray:
    """A float64 matrix of equally long lists without nulls."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def packed(x: np.ndarray, dtype: str) -> pa.Array:
    """Rows of a matrix as byte strings, which Spark shuffles as they are."""
    x = np.ascontiguousarray(x, dtype)
    ends = np.arange(len(x) + 1, dtype=np.int32) * np.int32(x.shape[1] * x.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(x)])


def unpacked(column: pa.Array, dtype: str, d: int) -> np.ndarray:
    """The float64 matrix of ``d`` columns that was packed."""
    column = column.cast(pa.binary())
    if not len(column):
        return np.empty((0, d))
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(dtype).reshape(len(column), d).astype(np.float64)


def usable(vectors: DataFrame, id: str, vector: str) -> DataFrame:
    """(vec_id, vec) of the rows that take part."""
    vec = F.col(vector).cast("array<double>")
    finite = ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col(id).isNotNull() & vec.isNotNull()).where(finite & F.exists(vec, lambda x: x != 0)).select(F.col(id).cast("long").alias("vec_id"), vec.alias("vec"))


def nearest(vectors: DataFrame, *, id: str, vector: str, is_query: Column, k: int = 10, how: Curves = Curves()) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for every row of ``is_query``, by Euclidean distance.

    ``is_query`` is a condition on the column ``vec_id``.  Null, zero and non-finite vectors, null ids and vectors of
    another length than most take no part.  Ties go to the smaller id; a query never finds its own id, and rows that
    repeat an id count as one vector, the nearest of them.  An empty table gives an empty result.

    Vectors travel as byte strings, of single floats where the column holds those.

    Recall rests on ``how.share``: windows are a share of all rows because the recall of a fixed window falls as rows
    are added.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id, vector)
    dtype = "<f4" if vectors.select(vector).schema[0].dataType.elementType.typeName() == "float" else "<f8"
    result = "query_id long, rank int, vec_id long, score double"
    sizes = rows.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], result)
    d, n_rows = sizes[0]["d"], sizes[0]["n"]
    rows = rows.where(F.size("vec") == d)
    m = min(how.directions, d)
    rng = np.random.default_rng(how.seed)
    turns = np.stack([np.linalg.qr(rng.normal(size=(d, d)))[0][:, :m] for _ in range(how.curves)])
    shift = rng.random((how.curves, m))

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, square, n = np.zeros(d), np.zeros((d, d)), 0
        for batch in batches:
            x = vectors_of(batch.column(0))
            if len(x):
                total, square, n = total + x.sum(0), square + x.T @ x, n + len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([0] * (d + 1)), pa.array(range(d + 1)), pa.array([*square.tolist(), total.tolist()], pa.list_(pa.float64()))], names=["g", "i", "v"])

    summed = rows.select("vec").mapInArrow(moments, "g long, i long, v array<double>").groupBy("i").agg(F.array(*[F.sum(F.col("v")[j]) for j in range(d)]).alias("v")).orderBy("i").collect()
    square, mean = np.array([r["v"] for r in summed[:-1]]) / n_rows, np.array(summed[-1]["v"]) / n_rows
    spread = np.sqrt(np.maximum(np.einsum("cim,ij,cjm->cm", turns, square - np.outer(mean, mean), turns), 1e-18))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 2000) for i in range(0, len(batch), 2000)):
                own = vectors_of(part.column(1))
                x, vec = own - mean, packed(own, dtype)
                for c in range(how.curves):
                    grid = (x @ turns[c] / spread[c] + 3 + shift[c] / 2) / 6.5 * (1 << how.bits)
                    key = hilbert_index(np.clip(grid, 0, (1 << how.bits) - 1).astype(np.int64), how.bits)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), c, np.int32)), pa.array(key), part.column(0), vec], names=["curve", "key", "vec_id", "vec"])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            curve = batch.column(0).to_numpy()
            place = np.empty(len(batch), np.int64)
            for c in np.unique(curve).tolist():
                own = np.flatnonzero(curve == c)
                place[own] = seen.get(c, 0) + np.arange(len(own))
                seen[c] = seen.get(c, 0) + len(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(np.full(len(batch), part, np.int64)), pa.array(place)], names=["curve", "vec_id", "vec", "part", "place"])

    parts = max(how.curves, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = rows.mapInArrow(keyed, "curve int, key long, vec_id long, vec binary")
    placed = placed.repartitionByRange(parts, "curve", "key", "vec_id").sortWithinPartitions("curve", "key", "vec_id")
    ordered = written(placed.mapInArrow(numbered, "curve int, vec_id long, vec binary, part long, place long"), "curves")
    before = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ordered.groupBy("curve", "part").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    ranked = ordered.join(starts, ["curve", "part"]).withColumn("at", F.col("place") + F.col("start")).drop("part", "place", "start")

    reach = max(how.least, math.ceil(how.share * n_rows / 2))
    asking = ranked.where(is_query)
    n_queries = rows.where(is_query).count()
    # Queries that reach a block are split into groups of bounded size, each of which meets the block in its own task.
    groups = max(1, math.ceil(n_queries * min(1.0, how.share + how.block / n_rows) / 4096))
    reached = F.sequence(F.floor(F.greatest(F.col("at") - reach, F.lit(0)) / how.block), F.floor(F.least(F.col("at") + reach, F.lit(n_rows - 1)) / how.block))
    queries = asking.select("curve", F.explode(reached).alias("block"), F.pmod(F.xxhash64("vec_id"), F.lit(groups)).alias("grp"), F.lit(True).alias("query"), "at", "vec_id", "vec")
    data = ranked.select("curve", F.floor(F.col("at") / how.block).alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("grp"), F.lit(False).alias("query"), "at", "vec_id", "vec")
    met = queries.union(data).repartition("curve", "block", "grp").sortWithinPartitions("curve", "block", "grp", "query")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, ["curve", "block", "grp"]):
            t = t.combine_chunks()
            asks = t.column("query").to_numpy()
            at, ids = t.column("at").to_numpy(), t.column("vec_id").to_numpy()
            x = unpacked(t.column("vec").chunk(0), dtype, d)
            q, r = np.flatnonzero(asks), np.flatnonzero(~asks)
            if not len(q) or not len(r):
                continue
            out, repeated = ([], [], []), len(np.unique(ids[r])) < len(r)
            for i in q.tolist():
                own = r[(np.abs(at[r] - at[i]) <= reach) & (ids[r] != ids[i])]
                score = np.sqrt(((x[own] - x[i]) ** 2).sum(1))
                if len(own) > 4 * k and not repeated:  # ties at the edge stay in
                    edge = np.partition(score, k)[k]
                    own, score = own[score <= edge], score[score <= edge]
                best = np.lexsort((ids[own], score))
                if repeated:
                    best = best[np.sort(np.unique(ids[own[best]], return_index=True)[1])]
                best = best[:k]
                for column, values in zip(out, (np.full(len(best), ids[i]), ids[own[best]], score[best])):
                    column.append(values)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["query_id", "vec_id", "score"])

    found = met.mapInArrow(compared, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
