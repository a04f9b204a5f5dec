"""An inverted file of vectors: cells around centroids, product-quantised codes for candidates, whole vectors to re-rank.

``build`` fits centroids and code books on a bounded sample, in one task, and stores every vector in the folder of its
nearest centroid, with a code of one byte for each part of it.  ``search`` opens the cells that lie nearest to a query,
scores codes by table look-up, and takes the exact cosine of the best few candidates only.  Ids of both are longs.  How many cells are opened
is measured when the index is built: as many as hold the asked share of the sample's own neighbours.  So is the length of
the codes: parts are halved until the candidates hold that share.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators.retrieval import top_k
from scriptorium.sources.shared import written

#: Vectors that the model is fitted on, those of them whose neighbours set the number of cells, and neighbours of each.
SAMPLE, CALIBRATED, NEIGHBOURS = 32_768, 256, 10
#: Most centroids, and codes of a part.  With ``d`` dimensions the model has 4 * d * (MOST_CELLS + CODES) bytes.
MOST_CELLS, CODES = 1024, 256
#: Most dimensions of a part, queries and codes that meet in a task, and codes that are scored at once.
PART, QUERY_BLOCK, SLICE, CHUNK = 4, 1024, 262_144, 4096
MODEL, CELL = "kind string, at int, value array<float>", "id long, vector array<float>, codes binary, cell int"


def means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """k-means of the rows of ``x``; a mean without rows stays where it is."""
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, centres)
        n = np.bincount(own, minlength=len(centres))
        sums = np.stack([np.bincount(own, weights=column, minlength=len(centres)) for column in x.T], axis=1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres).astype(np.float32)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([np.argmin(half - x[at : at + 8192] @ centres.T, axis=1) for at in range(0, len(x), 8192)] or [np.empty(0, np.int64)])


def units(column: pa.Array | pa.ChunkedArray, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of norm 1 as float32, and which rows they are: those of the right length, finite and not zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.nan_to_num(np.array(column.value_lengths().to_numpy(zero_copy_only=False), np.float64)).astype(np.int64)
    right = np.flatnonzero(lengths == dimension)
    flat = column.take(pa.array(right)).flatten().to_numpy(zero_copy_only=False)
    x = np.array(flat, np.float64).reshape(len(right), dimension)
    norm = np.linalg.norm(x, axis=1)
    good = np.isfinite(norm) & (norm > 0)
    return (x[good] / norm[good, None]).astype(np.float32), right[good]


@dataclass(frozen=True)
class Model:
    """Centroids, the code books of the parts of a vector, and the number of cells that a query opens."""

    centroids: np.ndarray
    books: list[np.ndarray]
    probes: int

    @property
    def dimension(self) -> int:
        return self.centroids.shape[1]

    def parts(self, x: np.ndarray) -> list[np.ndarray]:
        return np.array_split(x, len(self.books), axis=1)

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([nearest(part, book) for part, book in zip(self.parts(x), self.books)], axis=1).astype(np.uint8)


def by_codes(model: Model, asked: np.ndarray, stored: np.ndarray) -> np.ndarray:
    """What the codes ``stored`` tell of the cosines with the rows of ``asked``."""
    tables = [part @ book.T for part, book in zip(model.parts(asked), model.books)]
    guess = np.zeros((len(asked), len(stored)), np.float32)
    for i, table in enumerate(tables):
        guess += table[:, stored[:, i]]
    return guess


def fitted(x: np.ndarray, cells: int, target: float, most: int, total: int) -> Model:
    rng = np.random.default_rng(0)
    centroids = means(x, cells, rng)
    asked = x[rng.choice(len(x), min(CALIBRATED, len(x)), replace=False)]
    near = np.argsort(-asked @ x.T, axis=1)[:, 1 : NEIGHBOURS + 1]
    # Of all vectors a query has NEIGHBOURS among ``most`` candidates; of the sample as many fewer as it is smaller.
    first, held, part = max(1, NEIGHBOURS * len(x) // total), max(2, most * len(x) // total), PART
    while True:
        model = Model(centroids, [means(columns, CODES, rng) for columns in np.array_split(x, max(1, x.shape[1] // part), axis=1)], 0)
        guess = by_codes(model, asked, model.codes(x))
        least = -np.partition(-guess, min(held, len(x)) - 1, axis=1)[:, min(held, len(x)) - 1]
        if part == 1 or np.mean(np.take_along_axis(guess, near[:, :first], axis=1) >= least[:, None]) >= target:
            break
        part //= 2
    books = model.books
    own = nearest(x, centroids)
    order = np.argsort(((centroids**2).sum(axis=1) / 2 - asked @ centroids.T), axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
    needed = np.sort(np.take_along_axis(place, own[near], axis=1).ravel())
    return Model(centroids, books, int(needed[int(np.ceil(target * len(needed))) - 1]) + 1 if len(needed) else 1)


def build(vectors: DataFrame, *, id: str, vector: str, path: str, dimension: int, target: float = 0.995, most: int = 50) -> None:
    """Write the index of ``vectors`` to the empty folder ``path``: the model, the cells, and vectors that take no part
    (null, of another dimension than the manifest's, zero, or with components that are not finite) as rejects.

    ``target`` is the share of the sample's neighbours that lie in the opened cells, and that the first ``most`` candidates
    by their codes hold; codes have a byte for each dimension at most.  A cell of any size is dealt over
    several files and tasks.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("vector"))
    total = rows.count()
    cells = int(min(MOST_CELLS, max(1, total**0.5)))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = [pa.Table.from_batches([b]) for b in batches]
        table = pa.concat_tables(table).sort_by("id") if table else None
        x = units(table.column("vector"), dimension)[0] if table is not None else np.empty((0, dimension), np.float32)
        if not len(x):
            return
        model = fitted(x[:SAMPLE], cells, target, most, max(total, len(x)))
        named = [("probes", model.probes, np.zeros(0))] + [("cell", i, c) for i, c in enumerate(model.centroids)] + [(f"part{p:04d}", i, c) for p, book in enumerate(model.books) for i, c in enumerate(book)]
        kinds, places, values = zip(*named)
        yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(places, pa.int32()), pa.array([v.tolist() for v in values], pa.list_(pa.float32()))], names=["kind", "at", "value"])

    share = F.lit(int(min(1.0, 0.9 * SAMPLE / max(total, 1)) * (1 << 30)))
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share).repartition(1)
    sample.mapInArrow(fit, MODEL).write.parquet(f"{path}/model")
    model = read_model(spark, path)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, right = units(batch.column(1), dimension)
            cell, codes = np.full(len(batch), -1, np.int32), [None] * len(batch)
            if len(right) and model is not None:
                cell[right] = nearest(x, model.centroids)
                for i, code in zip(right.tolist(), model.codes(x)):
                    codes[i] = code.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.binary()), pa.array(cell)], names=["id", "vector", "codes", "cell"])

    placed = rows.mapInArrow(assign, CELL)
    placed.hint("rebalance", F.col("cell")).write.partitionBy("cell").parquet(f"{path}/cells")


def read_model(spark: SparkSession, path: str) -> Model | None:
    """The stored model; its size is bounded, see ``MOST_CELLS``."""
    rows = sorted((r["kind"], r["at"], r["value"]) for r in spark.read.schema(MODEL).parquet(f"{path}/model").collect())
    if not rows:
        return None
    of = lambda kind: np.array([v for k, _, v in rows if k == kind], np.float32)
    parts = sorted({k for k, _, _ in rows if k.startswith("part")})
    return Model(of("cell"), [of(k) for k in parts], next(at for k, at, _ in rows if k == "probes"))


def cells(spark: SparkSession, path: str) -> DataFrame:
    """(id, vector, codes, cell) of the vectors that take part."""
    return spark.read.schema(CELL).parquet(f"{path}/cells").where("cell >= 0")


def rejects(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CELL).parquet(f"{path}/cells").where("cell < 0").select("id", "vector")


def routed(queries: DataFrame, model: Model) -> DataFrame:
    """(query_id, asked, cell): every query vector, of norm 1, once for each cell that it opens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, right = units(batch.column(1), model.dimension)
            order = np.argsort((model.centroids**2).sum(axis=1) / 2 - x @ model.centroids.T, axis=1)[:, : model.probes]
            names = batch.column(0).take(pa.array(np.repeat(right, order.shape[1])))
            asked = pa.array([v.tobytes() for v in np.repeat(x, order.shape[1], axis=0)], pa.binary())
            yield pa.RecordBatch.from_arrays([names, asked, pa.array(order.ravel().astype(np.int32))], names=["query_id", "asked", "cell"])

    return queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<float>").alias("vector")).mapInArrow(run, "query_id long, asked binary, cell int")


def candidates(spark: SparkSession, path: str, queries: DataFrame, *, most: int) -> tuple[DataFrame, DataFrame]:
    """Two tables: (query_id, id, cell, asked, guess, rank), the ``most`` best of every query by their codes, and (query_id,
    scanned), the codes that were looked at.  ``queries`` is (query_id, vector).  Only the folders of opened cells are read,
    and of those the codes."""
    model = read_model(spark, path)
    if model is None:
        return spark.createDataFrame([], "query_id long, id long, cell int, asked binary, guess double, rank int"), spark.createDataFrame([], "query_id long, scanned long")
    asked = written(routed(queries, model), "routed")
    opened = [r["cell"] for r in asked.select("cell").distinct().collect()]  # at most MOST_CELLS
    codes = cells(spark, path).where(F.col("cell").isin(opened)).select("id", "codes", "cell")
    sizes = codes.groupBy("cell").agg(F.count("*").alias("n")).withColumn("slices", (F.col("n") / SLICE).cast("int") + 1)
    asking = asked.groupBy("cell").agg(F.count("*").alias("m")).withColumn("blocks", (F.col("m") / QUERY_BLOCK).cast("int") + 1)
    shape = written(sizes.join(asking, "cell"), "shape")
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(shape, "cell").select("query_id", "asked", "cell", dealt("query_id", "blocks").alias("block"), every("slices").alias("slice"))
    right = codes.join(shape, "cell").select("id", "codes", "cell", dealt("id", "slices").alias("slice"), every("blocks").alias("block"))
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("cell", pa.int32()), ("asked", pa.binary()), ("guess", pa.float64())])

    def run(q: pa.Table, v: pa.Table) -> pa.Table:
        if not len(q) or not len(v):
            return schema.empty_table()
        binary = q.column("asked").to_pylist()
        x = np.frombuffer(b"".join(binary), np.float32).reshape(len(q), model.dimension)
        stored = np.frombuffer(b"".join(v.column("codes").to_pylist()), np.uint8).reshape(len(v), len(model.books))
        ids = v.column("id").to_numpy()
        best, best_id = np.empty((len(q), 0), np.float32), np.empty((len(q), 0), np.int64)
        for at in range(0, len(v), CHUNK):
            guess = by_codes(model, x, stored[at : at + CHUNK])
            guess, names = np.hstack([best, guess]), np.hstack([best_id, np.broadcast_to(ids[at : at + CHUNK], guess.shape)])
            order = np.lexsort((names, -guess), axis=1)[:, :most]
            best, best_id = np.take_along_axis(guess, order, 1), np.take_along_axis(names, order, 1)
        width = best.shape[1]
        rows = np.repeat(np.arange(len(q)), width)
        cell = v.column("cell")[0].as_py()
        return pa.table([q.column("query_id").take(pa.array(rows)), pa.array(best_id.ravel()), pa.array(np.full(len(rows), cell, np.int32)), pa.array([binary[i] for i in rows], pa.binary()), pa.array(best.ravel().astype(np.float64))], schema=schema)

    keys = ("cell", "block", "slice")
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "query_id long, id long, cell int, asked binary, guess double")
    scanned = asked.join(shape, "cell").groupBy("query_id").agg(F.sum("n").alias("scanned"))
    return top_k(met, "query_id", [F.desc("guess"), F.asc("id")], most), scanned


def search(spark: SparkSession, path: str, queries: DataFrame, *, k: int, most: int) -> DataFrame:
    """(query_id, id, rank, score, scanned): the ``k`` best of every query by exact cosine, to six places, among its ``most``
    candidates, and how many codes were looked at for it.  Null, zero and odd vectors take no part."""
    found, scanned = candidates(spark, path, queries, most=most)
    found = written(found.select("query_id", "id", "cell", "asked"), "candidates")
    opened = [r["cell"] for r in found.select("cell").distinct().collect()]
    stored = cells(spark, path).where(F.col("cell").isin(opened)).select("id", "cell", "vector")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.float32).reshape(len(batch), -1).astype(np.float64)
            x = np.array(batch.column(3).flatten().to_numpy(), np.float64).reshape(asked.shape)
            score = (asked * x).sum(axis=1) / np.linalg.norm(x, axis=1) / np.linalg.norm(asked, axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.round(score, 6))], names=["query_id", "id", "score"])

    rows = found.join(stored, ["cell", "id"]).select("query_id", "id", "asked", "vector").mapInArrow(exact, "query_id long, id long, score double")
    return top_k(rows, "query_id", [F.desc("score"), F.asc("id")], k).join(scanned, "query_id").select("query_id", "id", "rank", "score", "scanned")
