import pytest
from pyspark.sql import functions as F

from scriptorium.operators import evaluation as ev
from scriptorium.operators import quality as ql
from scriptorium.operators import retrieval as rt
from scriptorium.operators import statistics as st
from scriptorium.sources import tables as tb
from scriptorium.sources.shared import VersionedTable


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, r, i + 1, m) for i, (r, m) in enumerate([("a", "n1"), ("b", "n1"), ("c", "n2"), ("d", "n3")])], "query_id int, result_id string, rank int, material_id string")
    judged = spark.createDataFrame([(1, "a", 3), (1, "c", 2), (1, "x", 1), (2, "a", 0)], "query_id int, result_id string, relevance int")
    one, none = ev.metrics_at(ranked, judged, 4).orderBy("query_id").collect()
    assert (one.recall, one.precision, one.reciprocal_rank, one.works) == (pytest.approx(2 / 3, abs=1e-6), 0.5, 1.0, 3)
    assert (none.recall, none.ndcg, none.reciprocal_rank, none.works) == (0.0, 0.0, 0.0, 0)


def test_fusion_and_duplicates(spark):
    rows = [(1, "lexical", r, i) for i, r in enumerate(["a", "b"], 1)] + [(1, "semantic", r, i) for i, r in enumerate(["c", "a", "c"], 1)]
    got = rt.reciprocal_rank_fusion(spark.createDataFrame(rows, "query_id int, retriever string, result_id string, rank int")).orderBy("rank").collect()
    assert [r.result_id for r in got] == ["a", "c", "b"] and got[0].retrievers == "lexical,semantic"


@pytest.mark.parametrize(("works", "first"), [("1111123", 3), ("11111234", 2)])
def test_diversity_back_fills(spark, works, first):
    rows = [(1, i, i, f"n{w}") for i, w in enumerate(works, 1)]
    got = rt.diversified(spark.createDataFrame(rows, "query_id int, result_id int, rank int, material_id string"), cap=2, limit=5).collect()
    assert len(got) == 5 and sum(r.material_id == "n1" for r in got) == first


def test_lexical_match_modes_and_vectors(spark):
    docs = spark.createDataFrame([(1, "rain night rain"), (2, "night"), (3, None), (4, "rain x x night")], "id long, text string")
    asked = spark.createDataFrame([(1, "Rain night"), (2, ""), (3, "absent")], "query_id long, query string")
    every = rt.lexical_search(docs, asked, id="id", text="text").orderBy("rank").collect()
    assert [(r.query_id, r.id, r.score) for r in every] == [(1, 1, 1.0), (1, 4, 0.5)]
    assert rt.lexical_search(docs, asked, id="id", text="text", match="any").count() == 3
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [2.0, 0.0])], "id long, v array<double>")
    got = rt.vector_search(v, spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, vector array<double>"), id="id", vector="v", k=2).orderBy("rank").collect()
    assert [r.id for r in got] == [1, 5]


def test_candidate_gate(spark):
    rows = [(0.985, 0.82, 0.815, 1.0, 0), (0.97, 0.82, 0.815, 1.0, 0), (0.985, 0.82, 0.80, 1.0, 0), (0.985, 0.82, 0.815, 181_000.0, 0), (0.985, 0.82, 0.815, 1.0, 1)]
    got = spark.createDataFrame(rows, "r double, e double, n double, p double, l int").select(ev.candidate_gate(F.col("r"), F.col("n"), F.col("e"), F.col("p"), F.col("l"))).collect()
    assert [r[0] for r in got] == [True, False, False, False, False]


def test_structural_roles(spark):
    rows = [(0.05, 3, False, False), (0.2, 4, True, False), (0.5, 4, False, False), (0.7, 5, True, False), (0.85, 2, False, True), (0.95, 1, False, False), (0.3, 5, True, True)]
    got = spark.createDataFrame(rows, "p double, t int, a boolean, b boolean").select(st.structural_role(F.col("p"), F.col("t"), F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [*st.ROLES, None]


def test_upsert_is_idempotent_and_keeps_vectors(spark, tmp_path):
    target = spark.createDataFrame([(1, "a", [1.0]), (2, "b", [2.0])], "id int, name string, v array<double>")
    source = spark.createDataFrame([(2, None, None), (3, "c", [3.0])], "id int, name string, v array<double>")
    table = VersionedTable(spark, str(tmp_path / "t"))
    assert table.read() is None
    table.write(target)
    for _ in range(2):
        table.write(tb.upsert(table.read(), source, ["id"], keep_if_null=("v",)))
        assert sorted(map(tuple, table.read().collect())) == [(1, "a", [1.0]), (2, None, [2.0]), (3, "c", [3.0])]
    assert table.version() == 3
    assert {r.id for r in tb.upsert(target, source, ["id"], delete_missing=True).collect()} == {2, 3}


def test_gate_and_worst(spark):
    rows = spark.createDataFrame([(1, "a", "success"), (1, "b", "running"), (2, "a", "failed"), (2, "b", "pending"), (3, "a", "success")], "material_id int, stage string, status string")
    assert [(r.decision, r.reasons) for r in ql.release_gate(rows).orderBy("material_id").collect()] == [("hold", "b:running"), ("block", "a:failed,b:pending"), ("allow", "")]
    assert rows.groupBy().agg(ql.worst(F.col("status"), ql.STATES)).first()[0] == "failed"


def test_throttle_totals_come_with_the_watermark(spark, tmp_path):
    from scriptorium.streaming import events as sv

    schema = "event_id long, run_id long, stage_id long, event_name string, occurred_at timestamp"
    for i, rows in enumerate([[(k, 1, 1, "x", f"2024-01-01 00:00:0{k}") for k in range(5)], [(9, 2, 1, "y", "2024-01-02 00:00:00")], [(10, 2, 1, "y", "2024-01-02 00:00:01")]]):
        spark.createDataFrame(rows, "event_id long, run_id long, stage_id long, event_name string, t string").select("event_id", "run_id", "stage_id", "event_name", F.col("t").cast("timestamp").alias("occurred_at")).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
    got = sv.drained(sv.throttled(stream), "append").collect()
    assert sorted((r.run_id, r.n) for r in got if r.kind == "sample") == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2)]
    assert [(r.run_id, r.n) for r in got if r.kind == "total"] == [(1, 5)]


def test_search_cases_are_checked(spark, tmp_path):
    lines = ['{"id":"a","query":"x","document_type":"chapter","judgments":{"1":3}}', '{"id":"","query":"x","document_type":"chapter"}', '{"id":"b","query":"x","document_type":"chapter","filters":[1]}', "no json", '{"id":"c","query":"x","document_type":"chapter","judgments":"x"}']
    (tmp_path / "cases.json").write_text("\n".join(lines))
    got = tb.read_search_cases(spark, str(tmp_path)).select("id", "issue", "filters", "judgments").collect()
    assert sorted((r["issue"] or "") for r in got) == ["", "filters is no map", "judgments is no map", "missing id", "no object"]
    assert [(r["filters"], r["judgments"]) for r in got if r["issue"] is None] == [({}, {"1": "3"})]


def test_profile_quality_without_targets_or_profiles(spark):
    works = spark.createDataFrame([(1, None, None), (2, -1, -1), (3, 1, 4)], "material_id int, target_count int, failed_count int")
    rows = [(1, "a", "full", True, None), (1, "b", None, True, None), (1, "c", None, None, ["x"]), (3, "a", "full", True, None), (3, "b", "full", True, None)]
    profiles = spark.createDataFrame(rows, "material_id int, name string, level string, complete boolean, schema_issues array<string>")
    targets = spark.createDataFrame([(2, "z"), (3, "a"), (3, "b"), (3, None)], "material_id int, name string")
    got = {r["material_id"]: r.asDict() for r in ql.profile_quality(works, profiles, targets).collect()}
    assert (got[1]["full"], got[1]["partial"], got[1]["targets"], got[1]["completed"], got[1]["failed"]) == (2, 1, 0, 1, 0)
    assert (got[2]["full"], got[2]["targets"], got[2]["completed"]) == (0, 1, 0)
    assert (got[3]["targets"], got[3]["completed"], got[3]["failed"]) == (1, 1, 4)


def test_lexical_ties_by_title_then_by_type(spark):
    docs = spark.createDataFrame([(1, "zzz", "red ring", 5), (2, "red", "red ring", 1), (3, "zzz", "red ring", 9), (4, None, "red ring", 9)], "id int, name string, body string, size int")
    asked = spark.createDataFrame([(7, "red")], "query_id int, query string")
    found = rt.lexical_search(docs, asked, id="id", text="body", title="name", ties=(F.desc("size"),))
    assert [r["id"] for r in found.orderBy("rank").collect()] == [2, 3, 1, 4]
