"""Rules of chapter records and their neighbours on rows made for them, nulls among them."""

from pyspark.sql import functions as F

from scriptorium.operators import chapter_rules as cr
from scriptorium.operators.statistics import numbered_within

RECORD = "material_id string, chapter int, type string, summary string, tension_level int, characters array<string>, functions array<string>, hook_type string, pacing string, tension_change string, emotion_transition string, plot_progress string, key_plot_point string"
GOOD = ("w", 1, "normal", "s" * 60, 3, ["a"], ["f"], "无钩子", "快", None, "calm→tense", "p" * 10, "climax")


def codes(spark, *changes):
    """Broken rules of records that differ from the good one, by chapter."""
    names = [c.split()[0] for c in RECORD.split(", ")]
    rows = [tuple(change.get(n, v) for n, v in zip(names, (GOOD[0], i, *GOOD[2:]))) for i, change in enumerate(changes, 1)]
    found = cr.chapter_issues(spark.createDataFrame(rows, RECORD)).collect()
    return [sorted(r["code"] for r in found if r["chapter"] == i) for i in range(1, len(changes) + 1)]


def test_limits_of_normal_and_special_chapters(spark):
    special = {"type": "afterword", "characters": None, "tension_level": None}
    got = codes(spark, {}, {"summary": "s" * 45}, {**special, "summary": "s" * 20}, {**special, "summary": "s" * 19}, {"summary": "s" * 201}, {"summary": None, "type": None}, {"summary": "s" * 501})
    short = ["analysis_summary_short", "summary_short"]
    assert got == [[], ["summary_short"], [], short, ["summary_long"], short, ["summary_beyond_contract", "summary_long"]]


def test_closed_sets_ranges_and_labels(spark):
    got = codes(spark, {"hook_type": "x", "pacing": "x", "key_plot_point": "x"}, {"tension_level": 6, "characters": [], "functions": None}, {"hook_type": None, "pacing": "", "key_plot_point": None, "tension_level": None, "plot_progress": "short", "emotion_transition": "a"})
    assert got == [["hook_type", "key_plot_point", "pacing"], ["no_characters", "no_functions", "tension_range"], ["emotion_transition_short", "plot_progress_short"]]


def test_change_of_tension_against_the_number_before(spark):
    change = lambda t, c, **more: {"tension_level": t, "tension_change": c, **more}
    got = codes(spark, change(3, "上升"), change(4, "上升"), change(4, "下降"), change(2, "乱"), change(2, "持平", chapter=50))
    assert got == [[], [], ["tension_change_differs"], ["tension_change", "tension_change_differs"], []]


def test_gate(spark):
    works = spark.createDataFrame([("ok", "quick", False), ("hold", "quick", False), ("over", "quick", True), ("bad", "quick", True), ("none", "deep", None), ("audit", "quick", True)], "material_id string, mode string, allow_degraded boolean")
    stages = spark.createDataFrame([("ok", "tags", "failed"), ("hold", "insights", "degraded"), ("over", "characters", "degraded"), ("bad", "analyze", "failed"), ("bad", "insights", "degraded")], "material_id string, stage string, status string")
    audits = spark.createDataFrame([("audit", 1, 2)], "material_id string, blocker int, error int")
    got = {r["material_id"]: tuple(r[1:]) for r in cr.gate(works, stages, audits).collect()}
    assert got == {
        "ok": ("allow", "success", False, ""), "hold": ("hold", "degraded", False, "insights_degraded"), "over": ("allow", "degraded", True, "characters_degraded"),
        "bad": ("block", "failed", False, "analyze_failed"), "none": ("block", "failed", False, "profile_missing"), "audit": ("block", "failed", False, "audit_blocker,audit_error"),
    }


def test_pacing_tags_and_pending_works(spark):
    rows = spark.createDataFrame([("喘息", 5, None), (None, 5, None), (None, 3, ["日常", "x"]), (None, None, None), (None, 1, ["战斗"])], "pacing string, tension_level int, functions array<string>")
    got = [(r["pacing"], r["fallback_fields"]) for r in cr.recovered_pacing(rows).collect()]
    assert got == [("喘息", None), ("快", ["pacing"]), ("慢", ["pacing"]), ("中", ["pacing"]), ("快", ["pacing"])]
    uses = spark.createDataFrame([("work", "d", "new"), ("chapter", "d", "new"), ("work", "d", "old"), ("work", "e", "old"), ("work", "d", None)], "scope string, dimension string, tag string")
    known = spark.createDataFrame([("d", "old"), ("d", "old")], "dimension string, tag string")
    assert sorted((r["dimension"], r["tag"], r["severity"]) for r in cr.unknown_tags(uses, known).collect()) == [("d", "new", "error"), ("d", "new", "warning"), ("e", "old", "error")]
    ids = lambda *n: spark.createDataFrame([(i,) for i in n], "id int")
    assert {r["id"] for r in cr.pending(ids(1, 2, 3, 4), ids(2, 3, 3), ids(3, 9), "id").collect()} == {1, 3, 4}


def test_places_within_groups_that_span_ranges(spark):
    rows = spark.range(300).select((F.col("id") % 3 + F.when(F.col("id") < 200, 0).otherwise(7)).alias("g"), (F.col("id") * 7 % 300).alias("x"))
    got = numbered_within(rows, "g", ["x"], "n").collect()
    for g in {r["g"] for r in got}:
        own = sorted((r["x"], r["n"]) for r in got if r["g"] == g)
        assert [n for _, n in own] == list(range(1, len(own) + 1))
