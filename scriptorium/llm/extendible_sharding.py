"""Byte-limited shards by extendible hashing, with DataFrame functions only.

The directory has one entry for each prefix of the deepest level, pointing at a bucket; a bucket over the byte limit is
split on one more bit of the hash, and only that bucket.  The tree of prefixes is summed up in one aggregation.  Rows
whose hash bits cannot part them (repeated keys, single rows as large as a shard) go to a bucket's overflow chain.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import BOX, boxed, unboxed, written

#: Bits of the first histogram; deeper ones are taken where the number of shards asks for them.
FIRST_BITS = 14
#: Bits of prefix below the mean shard, so that a bucket at full depth is far under the limit unless a key repeats.
SPARE_BITS = 4
#: A directory of at most this many entries is broadcast; a larger one is joined by shuffle.
BROADCAST_ENTRIES = 1 << 15


def prefix(bits: int | Column) -> Column:
    """The first ``bits`` bits of the hash ``h``."""
    return F.expr("0L") if isinstance(bits, int) and bits == 0 else F.shiftrightunsigned("h", 64 - bits)


def directory(cells: DataFrame, bits: int, limit: int) -> DataFrame:
    """(cell, depth, bucket) for every prefix of ``bits`` bits that has rows: the bucket is the shortest prefix whose
    bytes are within ``limit``, or the whole cell where none is."""
    levels = cells.select("cell", "bytes", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth"))
    nodes = levels.groupBy("depth", F.expr(f"shiftright(cell, {bits} - depth)").alias("bucket")).agg(F.sum("bytes").alias("bytes"))
    split = nodes.where((F.col("bytes") > limit) & (F.col("depth") < bits)).select("depth", "bucket")
    children = split.select((F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("bucket") * 2, F.col("bucket") * 2 + 1)).alias("bucket"))
    root = cells.sparkSession.range(1).select(F.lit(0).alias("depth"), F.lit(0).cast("long").alias("bucket"))
    leaves = children.union(root).join(split, ["depth", "bucket"], "left_anti")
    span = F.expr(f"shiftleft(1L, {bits} - depth)")
    return leaves.select(F.explode(F.sequence(F.col("bucket") * span, (F.col("bucket") + 1) * span - 1)).alias("cell"), "depth", "bucket")


def shard(docs: DataFrame, *, keys: list[str], size: Column, limit: int) -> DataFrame:
    """Add ``shard_id``, ``depth``, ``chain`` and ``n_bytes`` to every row.

    ``n_bytes`` is ``size`` (null: 0).  Rows of one ``shard_id`` have at most ``limit`` bytes together, but for a single
    row that is larger itself, which stands alone.  ``depth`` is the number of hash bits that the bucket uses, ``chain``
    the place in its overflow chain (0 without one).  Null keys hash like a value of their own; repeated rows are placed
    each; an empty table gives an empty one; existing columns of the new names are replaced, and columns of any other name
    pass through.

    Two scans of the key and the size, no shuffle of the rows themselves unless the directory is too large to broadcast.
    Only the rows of buckets at full depth that are still over the limit are written and numbered, by their own
    partition first, so that a key with a third of all rows is never gathered.
    """
    keep = [c for c in docs.columns if c not in ("shard_id", "depth", "chain", "n_bytes")]
    rows = boxed(docs, keep, h=F.xxhash64(*keys), n=F.coalesce(size.cast("long"), F.lit(0).cast("long")))
    histogram = lambda b: written(rows.groupBy(prefix(b).alias("cell")).agg(F.sum("n").alias("bytes")), "cells")
    cells, bits = histogram(FIRST_BITS), FIRST_BITS
    total = cells.agg(F.sum("bytes")).first()[0] or 0
    wanted = min(48, math.ceil(math.log2(max(1.0, total / limit))) + SPARE_BITS)
    if wanted > bits:
        cells, bits = histogram(wanted), wanted
    entries = written(directory(cells, bits, limit), "directory")
    if bits <= math.log2(BROADCAST_ENTRIES):
        entries = F.broadcast(entries)
    full = written(cells.where(F.col("bytes") > limit).select("cell"), "full-cells")
    placed = rows.withColumn("cell", prefix(bits)).join(entries, "cell")
    code = F.expr("shiftleft(1L, depth)") + F.col("bucket")
    result = lambda df: df.select(*unboxed(keep, rows.schema), F.concat_ws("-", code, "chain").alias("shard_id"), "depth", "chain", F.col("n").alias("n_bytes"))
    none = F.lit(0).cast("long")
    if full.isEmpty():
        return result(placed.withColumn("chain", none))

    plain = placed.join(full, "cell", "left_anti").withColumn("chain", none)
    over = placed.join(full, "cell", "left_semi").withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id())
    over = written(over, "overflow")
    # Rows over half the limit stand alone; the others fill places of a stride that leaves room for the row on its edge.
    small = over.where(F.col("n") <= limit // 2)
    stride = limit - limit // 2
    sums = small.groupBy("cell", "part").agg(F.sum("n").alias("sum"))
    before = Window.partitionBy("cell").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("sum").over(before), F.lit(0))).drop("sum")
    within = Window.partitionBy("cell", "part").orderBy("h", "row").rowsBetween(Window.unboundedPreceding, -1)
    numbered = small.withColumn("own", F.coalesce(F.sum("n").over(within), F.lit(0))).join(starts, ["cell", "part"])
    numbered = numbered.withColumn("chain", F.floor((F.col("start") + F.col("own")) / stride).cast("long"))
    alone = over.where(F.col("n") > limit // 2).withColumn("chain", -1 - F.col("row"))
    ready = lambda df: df.select(BOX, "n", "depth", "bucket", "chain")
    return result(ready(plain).union(ready(numbered)).union(ready(alone)))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard; rows are dealt out by shard, and a shard never exceeds its byte limit."""
    sharded.repartition("shard_id").write.partitionBy("shard_id").parquet(path)
