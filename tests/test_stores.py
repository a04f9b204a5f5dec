"""Stores that are written step by step: what a batch writes, replays, compaction, broken runs, versions, layouts."""

import json

import pytest
from pyspark.sql import functions as F

from scriptorium.sources import layers
from scriptorium.sources.keyed_table import KeyedTable
from scriptorium.sources.reports import ReportLog
from scriptorium.sources.shared import new_path
from scriptorium.sources.units import UnitRuns
from scriptorium.streaming.events import merged_by_batch

SHAPE = "k long, at long, v string"


def keyed(spark, buckets=8):
    schema = spark.createDataFrame([], SHAPE).schema
    return KeyedTable(spark, new_path(spark, "keyed"), schema, keys=["k"], order=["at"], buckets=buckets)


def rows(df):
    return sorted((r["k"] is not None, r["k"], r["at"], r["v"]) for r in df.collect())


def files(spark, path):
    return {r["path"]: r["modificationTime"] for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "modificationTime").collect()}


def test_a_batch_writes_the_buckets_of_its_keys_and_the_newest_row_wins(spark):
    t = keyed(spark)
    t.apply(spark.createDataFrame([(i, 1, "a") for i in range(100)], SHAPE), 0)
    before = files(spark, t.path)
    t.apply(spark.createDataFrame([(5, 2, "b"), (5, 3, "c"), (6, 0, "old"), (None, 1, "null")], SHAPE), 1)
    new = set(files(spark, t.path)) - set(before)
    assert 1 <= len(new) <= 3 and all("batch=1" in f for f in new)
    want = sorted((True, i, 3 if i == 5 else 1, "c" if i == 5 else "a") for i in range(100))
    assert rows(t.read()) == sorted([*want, (False, None, 1, "null")])


def test_replayed_batches_and_compaction_change_nothing(spark):
    t = keyed(spark)
    batches = [[(i, n, f"b{n}") for i in range(n, 40, n + 1)] for n in range(3)]
    df = [spark.createDataFrame(b, SHAPE) for b in batches]
    assert t.compact() == [] and t.read().isEmpty()
    t.apply(df[0], 0)
    t.apply(df[1], 1)
    state = rows(t.read())
    t.apply(df[1], 1)
    assert rows(t.read()) == state
    first = t.compact()
    assert first and rows(t.read()) == state and t.changes().isEmpty()
    before = files(spark, t.path)
    t.apply(df[0], 0)
    assert files(spark, t.path) == before  # the bases hold it
    t.apply(spark.createDataFrame([(1, 9, "new")], SHAPE), 2)
    assert len(t.compact()) == 1 and (True, 1, 9, "new") in rows(t.read()) and len(rows(t.read())) == len(state)
    assert t.compacted() == 2


def test_a_stream_of_changes_goes_on_after_a_break(spark, tmp_path):
    t, state = keyed(spark), new_path(spark, "state")
    for n in range(3):
        spark.createDataFrame([(i, n, f"n{n}") for i in range(0, 20, n + 1)], SHAPE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(SHAPE).parquet(str(tmp_path / "in"))
        merged_by_batch(source, t, every=2, state=state)
    assert rows(t.read()) == sorted((True, i, 2 if i % 3 == 0 else 1 if i % 2 == 0 else 0, f"n{2 if i % 3 == 0 else 1 if i % 2 == 0 else 0}") for i in range(20))


def test_a_broken_run_does_only_the_rest(spark):
    seen = {"first": [], "second": []}
    runs = UnitRuns(spark, new_path(spark, "units"), id="u", parts=3)
    units = spark.range(30).withColumnRenamed("id", "u")

    def stage(name, fails):
        def work(todo):
            own = sorted(r["u"] for r in todo.collect())
            seen[name].append(own)
            if fails(len(seen[name])):
                raise RuntimeError("lost")
            return todo.select("u", (F.col("u") * 2).alias("x"), ((F.col("u") == 4) & F.lit(len(seen["second"]) < 4) & F.lit(name == "second")).alias("failed"))

        return name, work

    stages = [stage("first", lambda n: False), stage("second", lambda n: n == 3)]
    with pytest.raises(RuntimeError):
        runs.run(units, stages)
    half = [u for part in seen["second"][:2] for u in part]
    assert sorted(u for part in seen["first"] for u in part) == list(range(30))
    assert sorted(r["u"] for r in runs.run(units, stages).collect()) == list(range(30))
    assert sum(seen["first"][3:], []) == []  # nothing of the first stage was done again
    missing = sorted(set(range(30)) - set(half) | ({4} & set(half)))
    assert sorted(sum(seen["second"][3:], [])) == missing
    assert sum(map(len, seen["second"])) == 30 + len(seen["second"][2]) + (4 in half)
    done = len(sum(seen["second"], []))
    assert runs.run(units, stages).count() == 30 and len(sum(seen["second"], [])) == done
    more = units.union(spark.createDataFrame([(99,)], "u long"))
    assert runs.run(more, stages).count() == 31 and sum(seen["second"], [])[done:] == [99]


def test_reports_as_of_a_version(spark):
    log = ReportLog(spark, new_path(spark, "reports"))
    with pytest.raises(ValueError):
        log.read()
    shape = "material_id long, started_at long, state string"
    log.append(spark.createDataFrame([(1, 5, "a"), (2, 5, "a"), (1, 6, "b")], shape))
    log.append(spark.createDataFrame([(1, 1, "c"), (3, 1, "c")], shape))
    latest = lambda v=None: {r["material_id"]: r["state"] for r in log.latest(v).collect()}
    assert latest() == {1: "c", 2: "a", 3: "c"} and latest(1) == {1: "b", 2: "a"} and log.read().count() == 5
    log.spark.createDataFrame([(9, 9, "half")], shape).write.parquet(f"{log.path}/records/version=3")  # never listed
    assert latest() == {1: "c", 2: "a", 3: "c"}


def test_split_files_go_before_the_merged_one(spark, tmp_path):
    def put(path, value):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(value if isinstance(value, str) else json.dumps(value))

    one = lambda n, **more: {"chapter": n, "title": f"t{n}", "summary": "s", **more}
    put("both/split/1.json", one(1, type="extra"))
    put("both/split/2.json", "[broken")
    put("both/merged/all.json", [one(1), one(2)])
    put("broken/split/1.json", "nothing")
    put("broken/merged/all.json", [one(1), {"title": "no number"}, one(3)])
    types = spark.createDataFrame([("broken", 3, "afterword"), ("both", 7, "extra")], "material_id string, chapter long, type string")
    got = sorted((r["material_id"], r["chapter"], r["type"], r["layer"]) for r in layers.read_chapters(spark, str(tmp_path), types).collect())
    assert got == [("both", 1, "extra", "split"), ("broken", 1, "normal", "merged"), ("broken", 3, "afterword", "merged")]


def test_vectors_in_two_layouts_against_their_manifests(spark, tmp_path):
    def put(path, value):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(json.dumps(value))

    put("a/vectors/v.json", {"chapters": [1, 2, 3], "vectors": [[1.0, 2.0], [1.0], None]})
    put("a/manifest/m.json", {"dimension": 2, "model": "x"})
    put("b/vectors/v.json", {"keys": ["k", "l", "m"], "vectors": [[1.0], [None]]})
    put("b/manifest/m.json", {"dimension": 1, "model": "x"})
    put("c/vectors/v.json", {"keys": ["k"], "vectors": [[1.0]]})
    kept, rejected = layers.read_vectors(spark, str(tmp_path))
    assert sorted((r["material_id"], r["key"]) for r in kept.collect()) == [("a", "1"), ("b", "k")]
    assert sorted((r["material_id"], r["key"], r["reason"]) for r in rejected.collect()) == [("a", "2", "dimension"), ("a", "3", "no key or vector"), ("b", "l", "not finite"), ("b", "m", "no key or vector"), ("c", "k", "no manifest")]
