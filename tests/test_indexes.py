"""Indexes against exact searches: rows, what is read, updates, merges, and odd rows."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.operators import retrieval as rt
from scriptorium.operators import text_index as ti
from scriptorium.operators import vector_index as vi
from scriptorium.sources.shared import new_path

SF = "/root/testdata/sf0.001"


def vectors(spark, n=1500, d=24, clusters=30, seed=1):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(clusters, d))
    x = centres[r.integers(clusters, size=n)] + 0.25 * r.normal(size=(n, d))
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, vector array<double>")


def test_cells_and_codes_find_the_neighbours_and_leave_most_cells_shut(spark):
    v, path = vectors(spark), new_path(spark, "index")
    vi.build(v, id="id", vector="vector", path=path, dimension=24)
    queries = v.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")
    rows = vi.search(spark, path, queries, k=10, most=60).collect()
    exact = {(r["query_id"], r["id"]) for r in rt.vector_search(v, queries, id="id", vector="vector", k=10).collect()}
    assert len(exact & {(r["query_id"], r["id"]) for r in rows}) >= 0.98 * len(exact)
    assert {r["rank"] for r in rows} == set(range(1, 11))
    assert np.mean([r["scanned"] for r in rows]) < 0.5 * v.count()  # such vectors lie in clusters
    scores = {(r["query_id"], r["id"]): r["score"] for r in rt.vector_search(v, queries, id="id", vector="vector", k=1500).collect()}
    assert all(scores[r["query_id"], r["id"]] == pytest.approx(r["score"], abs=2e-6) for r in rows)


def test_only_the_folders_of_opened_cells_are_read(spark):
    v, path = vectors(spark), new_path(spark, "index")
    vi.build(v, id="id", vector="vector", path=path, dimension=24)
    model = vi.read_model(spark, path)
    one = v.where("id = 7").select(F.col("id").alias("query_id"), "vector")
    found, scanned = vi.candidates(spark, path, one, most=5)
    sizes = {r["cell"]: r["count"] for r in vi.cells(spark, path).groupBy("cell").count().collect()}
    opened = {r["cell"] for r in vi.routed(one, model).collect()}
    assert len(opened) == model.probes < len(sizes) and scanned.first()["scanned"] == sum(sizes[c] for c in opened)
    assert {r["cell"] for r in found.collect()} <= opened


def test_a_large_cell_is_searched_in_slices_and_blocks(spark, monkeypatch):
    v, path = vectors(spark, n=600), new_path(spark, "index")
    vi.build(v, id="id", vector="vector", path=path, dimension=24)
    queries = v.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")
    once = sorted(map(tuple, vi.search(spark, path, queries, k=5, most=50).collect()))
    for name, n in (("SLICE", 9), ("QUERY_BLOCK", 3), ("CHUNK", 4)):
        monkeypatch.setattr(vi, name, n)
    assert len(once) == 150 and sorted(map(tuple, vi.search(spark, path, queries, k=5, most=50).collect())) == once


def test_odd_vectors_are_rejected_and_empty_tables_searched(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [1.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 0.0])]
    v = spark.createDataFrame(rows, "id long, vector array<double>")
    path, empty = new_path(spark, "index"), new_path(spark, "index")
    vi.build(v, id="id", vector="vector", path=path, dimension=2)
    queries = v.withColumnRenamed("id", "query_id")
    got = {(r["query_id"], r["id"]) for r in vi.search(spark, path, queries, k=9, most=9).collect()}
    assert got == {(a, b) for a in (1, 2, 9) for b in (1, 2, 9)}
    assert {r["id"] for r in vi.rejects(spark, path).collect()} == {3, 4, 5, 6, 7, 8}
    vi.build(v.limit(0), id="id", vector="vector", path=empty, dimension=2)
    assert vi.search(spark, empty, queries, k=3, most=3).isEmpty()


def same(index_rows, exact_rows):
    rows = lambda found: sorted((r["query_id"], r["id"], r["rank"], round(r["score"], 6)) for r in found.collect())
    assert rows(index_rows) == rows(exact_rows)


@pytest.mark.parametrize("match", ["all", "any"])
def test_text_index_has_the_rows_of_the_search_without_one(spark, monkeypatch, match):
    monkeypatch.setattr(ti, "RANGE", 16)
    monkeypatch.setattr(ti, "FIRST", 1)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    queries = spark.createDataFrame([(1, "the"), (2, "the and of"), (3, "nowhere the"), (4, ""), (5, "de la"), (6, "und der the")], "query_id long, query string")
    index = ti.TextIndex(spark, new_path(spark, "text"))
    index.upsert(docs, id="id", text="text")
    want = rt.lexical_search(docs, queries, id="id", text="text", match=match, limit=7)
    same(index.search(queries, match=match, limit=7), want)
    scored, every = index.scored(queries, match=match, limit=7).count(), rt.lexical_search(docs, queries, id="id", text="text", match=match, limit=10_000).count()
    assert scored < every or match == "any"  # ranges that cannot reach the first seven are left alone


def test_text_index_follows_changes_and_merges(spark):
    index = ti.TextIndex(spark, new_path(spark, "text"))
    old = spark.createDataFrame([(1, "rain at night"), (2, "rain and rain"), (3, None), (4, "night")], "id long, text string")
    new = spark.createDataFrame([(2, "sun"), (3, "rain"), (5, "rain night rain"), (4, None)], "id long, text string")
    queries = spark.createDataFrame([(1, "rain"), (2, "rain night"), (3, "sun")], "query_id long, query string")
    now = spark.createDataFrame([(1, "rain at night"), (2, "sun"), (3, "rain"), (4, None), (5, "rain night rain")], "id long, text string")
    assert index.segments() == [] and index.upsert(old, id="id", text="text") == 0
    same(index.search(queries, limit=9), rt.lexical_search(old, queries, id="id", text="text", limit=9))
    index.upsert(new, id="id", text="text")
    for match in ("all", "any"):
        same(index.search(queries, match=match, limit=9), rt.lexical_search(now, queries, id="id", text="text", match=match, limit=9))
    assert index.merge() == 2 and index.segments() == [2]
    same(index.search(queries, match="any", limit=9), rt.lexical_search(now, queries, id="id", text="text", match="any", limit=9))
    index.upsert(spark.createDataFrame([(1, "moon")], "id long, text string"), id="id", text="text")
    assert {r["id"] for r in index.search(queries, limit=9).collect()} == {2, 3, 5}


def test_text_index_opens_the_folders_of_its_words_only(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    index = ti.TextIndex(spark, new_path(spark, "text"))
    index.upsert(docs, id="doc_id", text="text")
    terms = spark.createDataFrame([("the",), ("nowhere",)], "term string")
    folders = {r["folder"] for r in index.opened(terms).select("folder").distinct().collect()}
    assert 1 <= len(folders) <= 2 and re.search(r"PartitionFilters: \[[^\]]*folder", index.asked(terms)._jdf.queryExecution().executedPlan().toString())
