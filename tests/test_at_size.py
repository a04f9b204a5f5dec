"""Steps that failed at size: what they shuffle and write, against plain searches."""

import re
import unicodedata
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scriptorium import fixtures as fx
from scriptorium.operators import evaluation as ev
from scriptorium.operators import hooks as hk
from scriptorium.operators import retrieval as rt
from scriptorium.operators import statistics as st
from scriptorium.operators import text_index as ti
from scriptorium.operators import vector_index as vi
from scriptorium.operators.cleaning import cleaned
from scriptorium.sources import layers
from scriptorium.sources import tables as tb
from scriptorium.sources.shared import new_path
from scriptorium.streaming import events as se
from scriptorium.streaming import stateful
from scriptorium.streaming.sinks import drained_by_batch

SF = "/root/testdata/sf0.001"


def test_hashed_candidates_meet_in_slices_and_shuffle_k_rows_of_each(spark, monkeypatch):
    r = np.random.default_rng(3)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(r.normal(size=(900, 16)))] + [(900, None), (901, [0.0] * 16)]
    v = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    queries = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "vector")
    monkeypatch.setattr(rt, "VECTOR_BYTES", 16 * 8 * 200)
    monkeypatch.setattr(hk, "CANDIDATES", 60)
    found = hk.approximate_then_exact(v, queries, 10)
    assert not re.search("(?i)SortMergeJoin|BroadcastHashJoin|CartesianProduct", found._jdf.queryExecution().executedPlan().toString())
    exact = {(x["query_id"], x["vec_id"]): x["score"] for x in rt.vector_search(v, queries, id="vec_id", vector="vector", k=10).collect()}
    got = {(x["query_id"], x["vec_id"]): x["score"] for x in found.collect()}
    assert len(got) == len(exact) == 18 * 10 and len(exact.keys() & got.keys()) >= 0.95 * len(exact)
    assert all(exact[pair] == pytest.approx(got[pair], abs=2e-6) for pair in exact.keys() & got.keys())


def test_codes_are_as_long_as_the_candidates_need(spark):
    x = np.random.default_rng(5).normal(size=(3000, 32))  # without clusters
    v = spark.createDataFrame([(i, [float(c) for c in row]) for i, row in enumerate(x)], "id long, vector array<double>")
    path, queries = new_path(spark, "index"), v.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")
    vi.build(v, id="id", vector="vector", path=path, dimension=32, most=20)
    pairs = lambda found: {(r["query_id"], r["id"]) for r in found.collect()}
    exact, got = pairs(rt.vector_search(v, queries, id="id", vector="vector", k=10)), pairs(vi.search(spark, path, queries, k=10, most=20))
    assert len(exact & got) >= 0.98 * len(exact) and len(vi.read_model(spark, path).books) > 32 // vi.PART


def test_only_documents_with_the_rarest_word_meet_a_query(spark, monkeypatch):
    rows = [(i, "the rain and the wind" + (" over helsinki" if i % 40 == 0 else "")) for i in range(400)]
    docs = spark.createDataFrame(rows, "id long, text string")
    queries = spark.createDataFrame([(1, "the helsinki and the rain"), (2, "the nowhere"), (3, "wind"), (4, "")], "query_id long, query string")
    seen, postings = [], rt.postings

    def counted(docs, **names):
        seen.append(docs.count())
        return postings(docs, **names)

    monkeypatch.setattr(rt, "postings", counted)
    found = rt.lexical_search(docs, queries.where("query_id <> 3"), id="id", text="text", limit=50).collect()
    assert seen == [10] and {(r["query_id"], r["id"]) for r in found} == {(1, i) for i in range(0, 400, 40)} and {r["score"] for r in found} == {round(5 / 7, 6)}
    assert {(r["query_id"], r["id"]) for r in rt.lexical_search(docs, queries, id="id", text="text", limit=3).collect()} == {(1, 0), (1, 40), (1, 80), (3, 0), (3, 1), (3, 2)}


def test_queries_that_share_judgments_are_judged_without_copies_of_them(spark):
    r = np.random.default_rng(8)
    ranked = spark.createDataFrame([(q, int(d), i + 1, int(d) % 3) for q in range(6) for i, d in enumerate(r.permutation(40)[:9])], "query_id long, result_id long, rank int, material_id long")
    shared = spark.createDataFrame([(int(d) % 2, int(d), int(r.integers(4))) for d in range(0, 40)], "judged_by long, result_id long, relevance int")
    groups = spark.createDataFrame([(q, q % 2) for q in range(7)], "query_id long, judged_by long")
    own = ev.metrics_at(ranked, groups.join(shared, "judged_by").drop("judged_by"), 5).collect()
    got = ev.metrics_at(ranked, shared, 5, groups).select(*own[0].asDict()).collect()
    assert len(own) == 7 and sorted(map(tuple, own)) == sorted(map(tuple, got))


def test_throttle_counts_keys_in_buckets_over_micro_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(se, "BUCKETS", 2)
    slices = [[(1, 1, 1), (2, 2, 1), (1, 3, 2)], [(1, 4, 3), (1, 5, 4), (3, 6, 4)], [(2, 7, 2000)], [(1, 8, 4000)]]
    for rows in slices:  # (run, event, minute); keys of a bucket time out each by its own
        df = spark.createDataFrame(rows, "run_id long, event_id long, minute long").withColumns({"stage_id": F.lit(1).cast("long"), "event_name": F.when(F.col("run_id") != 3, "a")})
        df.select("run_id", "stage_id", "event_name", "event_id", F.timestamp_seconds(F.col("minute") * 60 + 3_600_000).alias("occurred_at")).coalesce(1).write.mode("append").parquet(str(tmp_path))
    e = spark.readStream.schema("run_id long, stage_id long, event_name string, event_id long, occurred_at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    got = sorted((r["run_id"], r["kind"], r["n"], r["event_id"]) for r in se.drained(se.throttled(e), "append").collect())
    samples = [(1, "sample", 1, 1), (1, "sample", 1, 8), (1, "sample", 2, 3), (1, "sample", 3, 4)]
    assert [r for r in got if r[0] == 1] == [*samples, (1, "total", 1, -1), (1, "total", 4, -1)]
    assert [r for r in got if r[0] == 2] == [(2, "sample", 1, 2), (2, "sample", 1, 7), (2, "total", 1, -1), (2, "total", 1, -1)] and [r for r in got if r[0] == 3] == [(3, "sample", 1, 6), (3, "total", 1, -1)]


def test_chapter_files_are_opened_once(spark, tmp_path):
    for chapter in range(6):
        folder = tmp_path / "w1" / "split"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{chapter}.json").write_text(f'{{"chapter": {chapter}}}' if chapter else "[no object")
    (tmp_path / "w2" / "merged").mkdir(parents=True)
    (tmp_path / "w2" / "merged" / "all.json").write_text('[{"chapter": 1}, {"chapter": 2}]')
    rows = layers.read_chapters(spark, str(tmp_path))
    assert sorted((r["material_id"], r["chapter"]) for r in rows.collect()) == [("w1", i) for i in range(1, 6)] + [("w2", 1), ("w2", 2)]
    assert not [f for f in rows.inputFiles() if "/split/" in f]  # they are not read again


def test_appearances_and_chapters_lie_in_partitions_of_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(st, "TASK_ROWS", 100)
    most = lambda df: max(r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect())
    for rows in (fx.appearances(spark, SF), fx.order_chapters(spark, SF), fx.appearance_counts(spark, SF)):
        assert rows.count() > 1000 and most(rows) < 400  # a partition of compressed rows would hold all of them


def test_texts_are_composed_by_lines_and_only_where_something_may_change(spark):
    texts = spark.createDataFrame([(1, "café\r\n江流第１章，　é\n한 Å\nक़")], "id long, text string")
    rows = cleaned(texts, id="id", text="text")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("Generate posexplode")  # lines go to Python, not texts
    assert rows.first()["text"] == unicodedata.normalize("NFC", texts.first()["text"]).replace("\r\n", "\n").replace("　", " ")
    touched = spark.createDataFrame([("江流第１章，é 가",), ("é",), ("Å",), ("하",)], "t string").select(F.col("t").rlike(tb.unsettled()).alias("x")).collect()
    assert [r["x"] for r in touched] == [False, True, True, True]


def test_postings_of_an_index_are_not_shuffled_one_by_one(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    seen, write = [], ti.TextIndex._write
    monkeypatch.setattr(ti.TextIndex, "_write", lambda self, rows, *more: (seen.append(rows), write(self, rows, *more)))
    index = ti.TextIndex(spark, new_path(spark, "text"))
    index.upsert(docs, id="doc_id", text="text")
    index.upsert(docs.where("doc_id % 3 = 0"), id="doc_id", text="text")
    index.merge()
    plans = [rows._jdf.queryExecution().executedPlan().toString() for rows in seen]
    assert [len(re.findall(r"Exchange hashpartitioning\(range", p)) for p in plans[:2]] == [1, 1] and "explode(entries" not in plans[2]
    assert not re.search("Exchange", plans[0][: plans[0].index("Generate")])  # words stay where their text's range is
    queries = spark.read.parquet(f"{SF}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    for match in ("all", "any"):
        plan = index.scored(queries, match=match, limit=3)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Exchange", plan[: plan.index("Generate")])  # neither do the documents that a range's blocks name


def test_chapter_files_are_written_without_a_process_each_and_read_by_few_tasks(spark):
    path, works = new_path(spark, "works"), ["a", "b c", "d/e=f%", None]
    rows = [(w, "split", f"{i}.json", "[no object" if i % 4 == 1 else f'{{"chapter": {i}, "title": "第{i}章\\r"}}') for w in works for i in range(120)]
    layers.write_files(spark.createDataFrame(rows, "source string, layer string, name string, value string"), path)
    top = Path(path.removeprefix("file:"))
    assert sorted(p.name for p in top.rglob("*") if p.is_file()) == sorted(r[2] for r in rows)  # Hadoop leaves a .crc beside each
    spark.createDataFrame([(w, "x") for w in works], "source string, value string").write.partitionBy("source").text(f"{path}-of-spark")
    assert {p.name for p in top.iterdir()} == {p.name for p in Path(f"{top}-of-spark").iterdir() if p.is_dir()}
    spark.createDataFrame([("a", "merged", "[]")], "source string, layer string, value string").write.mode("append").partitionBy("source", "layer").text(path)
    found = layers.read_chapters(spark, path)
    assert found.count() == 90 * len(works) and {r["title"] for r in found.collect()} == {f"第{i}章\r" for i in range(120) if i % 4 != 1}
    assert len([f for f in found.inputFiles() if f.endswith(".parquet")]) <= 4  # one of each task; 32 files in a task made 15


def test_diagnostics_of_a_bucket_are_cut_together_and_key_by_key(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stateful, "BUCKETS", 2)
    wait = StreamingQuery.awaitTermination
    monkeypatch.setattr(StreamingQuery, "awaitTermination", lambda q: (wait(q), progress.extend(q.recentProgress)))
    progress, events, r = [], [], np.random.default_rng(7)
    for i in range(5):  # slices after one another; keys are beyond what a fraction holds, or null in part
        rows = [((2**60 + 1, 2**60 + 2, None)[r.integers(3)], (1, None)[r.integers(2)], ("a", None)[r.integers(2)], i * 100 + j, i * 400 + int(r.integers(400))) for j in range(60)]
        events += rows
        df = spark.createDataFrame(rows, "run_id long, stage_id long, event_name string, event_id long, minute long")
        df.withColumn("occurred_at", F.timestamp_seconds(F.col("minute") * 60 + 3_600_000)).drop("minute").coalesce(1).write.mode("append").parquet(str(tmp_path))
    want, end = [], max(e[4] for e in events) - 10
    for key in {e[:3] for e in events}:
        n, last = 0, None
        for event, at in sorted((e[3:] for e in events if e[:3] == key), key=lambda x: x[::-1]):
            if last is not None and at - last > 60:
                want, n = [*want, (*key, "total", n, -1)], 0
            n, last = n + 1, at
            want += [(*key, "sample", n, event)] * (n <= 2)
        want += [(*key, "total", n, -1)] * (last + 60 < end)
    stream = spark.readStream.schema("run_id long, stage_id long, event_name string, event_id long, occurred_at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    chunk = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(chunk)
    spark.conf.set(chunk, 7)
    try:
        got = [tuple(x) for x in drained_by_batch(stateful.throttled_episodes(stream, 3600, first=2)).drop("batch").collect()]
    finally:
        spark.conf.set(chunk, before)
    assert len({x[:3] for x in got}) == 12 and sorted(got, key=str) == sorted(want, key=str)
    assert max(p.stateOperators[0].numRowsTotal for p in progress) <= 2  # not a state for each key
