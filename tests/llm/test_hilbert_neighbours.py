import itertools

import numpy as np
from pyspark.sql import functions as F

from scriptorium.llm import hilbert_neighbours as hn

SCHEMA = "vec_id long, vec array<double>, score int"


def exact(rows, query, k):
    by = {i: np.array(v, float) for i, v in rows}
    out = sorted((float(np.sqrt(((by[query] - v) ** 2).sum())), i) for i, v in by.items() if i != query)
    return [i for _, i in out[:k]]


def test_the_curve_visits_neighbouring_cells():
    for axes, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=axes)))
        index = hn.hilbert_index(cells, bits)
        path = cells[np.argsort(index)]
        assert sorted(index) == list(range(len(cells)))
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_vectors_come_back_from_byte_strings():
    x = np.random.default_rng(3).normal(size=(9, 5)).astype(np.float32)
    for dtype in ("<f4", "<f8"):
        one = hn.packed(x, dtype)
        assert (hn.unpacked(one, dtype, 5) == x.astype(np.float64)).all()
        assert (hn.unpacked(one.slice(4, 3), dtype, 5) == x[4:7]).all()
        assert hn.unpacked(one.slice(9), dtype, 5).shape == (0, 5)


def test_small_tables_are_exact_and_odd_vectors_take_no_part(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)]
    rows[20] = (20, rows[0][1])
    rows[21] = (21, rows[0][1])
    odd = [(100, None), (101, [0.0] * 4), (102, [1.0, None, 0.0, 1.0]), (103, [float("nan"), 0.0, 0.0, 1.0]), (104, [1.0, float("inf"), 0.0, 0.0]), (105, [1.0]), (None, [1.0] * 4), (5, rows[5][1])]
    data = spark.createDataFrame([(*r, 1) for r in rows + odd], SCHEMA)
    got = hn.nearest(data, id="vec_id", vector="vec", is_query=F.col("vec_id") % 20 == 0, k=7).orderBy("query_id", "rank").collect()
    for q in (0, 20, 40):
        assert [r.vec_id for r in got if r.query_id == q] == exact(rows, q, 7)
    assert len(got) == 21
    few = data.where("vec_id < 3")
    assert hn.nearest(few, id="vec_id", vector="vec", is_query=F.col("vec_id") == 0, k=7).count() == 2
    assert hn.nearest(data.limit(0), id="vec_id", vector="vec", is_query=F.lit(True)).count() == 0


def test_recall_on_the_given_vectors(spark):
    from scriptorium.llm.registry import op10_hilbert_neighbours

    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    found, n = 0, 0
    for r in op10_hilbert_neighbours(spark, "/root/testdata/sf0.1").groupBy("query_id").agg(F.collect_set("vec_id").alias("ids")).collect():
        found, n = found + len({*r.ids} & {*exact(rows, r.query_id, 10)}), n + 10
    assert n == 200 and found >= 0.9 * n
