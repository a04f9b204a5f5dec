"""Contracts of nested records: each gives a row for every rule that a record breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.operators.quality import violations

# Versions, stages and sample fields of navigation records; quality levels of work summaries.
STAGES = (1, 2, 3, 4, 5)
SAMPLE_FIELDS = ("sampled_chapters", "covered_ranges", "limitations")
QUALITY_LEVELS = ("full", "limited")
#: Characters of a piece of evidence at most.
EVIDENCE_LENGTH = 120


def blank(text: Column) -> Column:
    return F.coalesce(F.trim(text) == "", F.lit(True))


def navigation_violations(records: DataFrame) -> DataFrame:
    """(material_id, rule) of navigation records, whose required fields depend on their version: 2.0.1 needs a chapter
    total, a hint of characters and stage summaries, 3.0.0 a sample coverage with all its fields."""
    old, new = F.col("schema_version") == "2.0.1", F.col("schema_version") == "3.0.0"
    keys = F.array_sort(F.map_keys("stage_summaries"))
    return violations(records, ["material_id"], {
        "version": ~(old | new) | F.col("schema_version").isNull(),
        "types": ~F.size("novel_type").between(1, 5) | F.exists("novel_type", blank),
        "total": F.col("total_chapters") < 1,
        "stages": F.col("stage_summaries").isNotNull() & (keys != F.array(*map(F.lit, STAGES))),
        "no_total": old & F.col("total_chapters").isNull(),
        "no_hint": old & F.col("core_characters_hint").isNull(),
        "no_stages": old & F.col("stage_summaries").isNull(),
        "sample_fields": new & (F.size(F.array_except(F.array(*map(F.lit, SAMPLE_FIELDS)), F.coalesce(F.map_keys("sample_coverage"), F.array().cast("array<string>")))) > 0),
    })


def insight_violations(insights: DataFrame, fields: DataFrame) -> DataFrame:
    """(insight_id, rule) of insights (insight_id, profile, schema_version, values, evidence, confidence) against the
    required ``fields`` (profile, field, min_length, max_length) of their profile."""
    own = insights.select("insight_id", "profile", "values").join(fields, "profile")
    value = F.try_element_at("values", "field")
    state = F.when(blank(value), "missing").when(F.length(value) < F.col("min_length"), "short").when(F.length(value) > F.col("max_length"), "long")
    by_field = own.select("insight_id", F.concat_ws(":", state, F.when(state.isNotNull(), F.col("field"))).alias("rule")).where("rule <> ''")
    parts = lambda e: blank(e["field"]) | blank(e["source"]) | blank(e["text"])
    general = violations(insights, ["insight_id"], {
        "version": F.coalesce(F.col("schema_version") != "1.0", F.lit(True)),
        "no_evidence": F.coalesce(F.size("evidence") < 1, F.lit(True)),
        "evidence_part": F.exists("evidence", parts),
        "evidence_long": F.exists("evidence", lambda e: F.coalesce(F.length(e["text"]) > EVIDENCE_LENGTH, F.lit(False))),
        "confidence": ~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)),
    })
    return by_field.union(general)


def range_violations(outlines: DataFrame) -> DataFrame:
    """(material_id, act, sequence, rule) of outlines (material_id, chapter_count, acts): acts and sequences lie within
    the work's chapters, beats within their sequence, tensions within 1 to 5."""
    acts = outlines.select("material_id", "chapter_count", F.explode("acts").alias("a"))
    sequences = acts.select("material_id", "chapter_count", F.col("a.act_number").alias("act"), F.explode("a.sequences").alias("s"))
    beats = sequences.select("material_id", "act", F.col("s.sequence_number").alias("sequence"), "s.chapter_start", "s.chapter_end", F.explode("s.beats").alias("b"))
    inside = lambda r: (F.lit(1) <= r["chapter_start"]) & (r["chapter_start"] <= r["chapter_end"]) & (r["chapter_end"] <= F.col("chapter_count"))
    bad = lambda ok: ~F.coalesce(ok, F.lit(False))
    keys = ["material_id", "act", "sequence"]
    of_acts = violations(acts.withColumn("act", F.col("a.act_number")).withColumn("sequence", F.lit(None).cast("int")), keys, {"act_range": bad(inside(F.col("a")))})
    of_sequences = violations(sequences.withColumn("sequence", F.col("s.sequence_number")), keys, {"sequence_range": bad(inside(F.col("s")))})
    of_beats = violations(beats, keys, {"beat_chapter": bad(F.col("b.chapter").between(F.col("chapter_start"), F.col("chapter_end"))), "beat_tension": bad(F.col("b.tension").between(1, 5))})
    return of_acts.union(of_sequences).union(of_beats)


def typed(payload: Column, schema: str) -> Column:
    """A JSON object as a struct of ``schema`` with a field ``bad``: the payload where it is no object or a type differs."""
    return F.from_json(payload, f"{schema}, bad string", {"columnNameOfCorruptRecord": "bad", "mode": "PERMISSIVE"})


def biography_split(payloads: DataFrame, candidates: DataFrame) -> DataFrame:
    """(material_id, name, state, issue): every record of the JSON lists ``payloads`` (material_id, payload) is valid or
    invalid, with its first issue; candidates (material_id, name) that no record names are missing."""
    each = payloads.select("material_id", F.posexplode(F.from_json("payload", "array<string>")).alias("i", "one"))
    read = each.withColumn("r", typed(F.col("one"), "name string, role string, confidence double, habits array<string>"))
    name = F.coalesce(F.nullif(F.trim("r.name"), F.lit("")), F.concat(F.lit("characters["), F.col("i").cast("string"), F.lit("]")))
    known = candidates.select("material_id", "name", F.lit(True).alias("known"))
    named = read.withColumn("name", name).join(known, ["material_id", "name"], "left")
    issue = F.when(F.col("r.bad").isNotNull(), "type").when(F.col("known").isNull(), "name").when(blank(F.col("r.role")), "role").when(F.col("r.confidence").isNull(), "confidence").when(F.col("r.habits").isNull(), "habits")
    records = named.select("material_id", "name", F.when(issue.isNull(), "valid").otherwise("invalid").alias("state"), issue.alias("issue"))
    return records.union(candidates.join(named, ["material_id", "name"], "left_anti").select("material_id", "name", F.lit("missing"), F.lit(None).cast("string")))


def summary_violations(summaries: DataFrame) -> DataFrame:
    """(material_id, rule) of work summaries: an id, a known quality level, a confidence from 0 to 1 and at least one
    reference to a chapter, a character or an entity."""
    n = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    return violations(summaries, ["material_id"], {
        "id": blank(F.col("material_id").cast("string")),
        "quality": ~F.coalesce(F.col("quality_level").isin(*QUALITY_LEVELS), F.lit(False)),
        "confidence": ~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)),
        "evidence": n("evidence.chapters") + n("evidence.characters") + n("evidence.entities") == 0,
    })
