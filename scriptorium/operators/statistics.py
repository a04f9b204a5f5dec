"""Statistics over chapters, appearances and works: every work at once, the work being a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.sources.shared import new_path

SPECIAL_TYPES = ("afterword", "author_note")
#: Rows that a task sorts or counts at once, see ``spread``.
TASK_ROWS = 1 << 19


def regular(chapters: DataFrame) -> DataFrame:
    """Without special chapters; a missing type is normal."""
    return chapters.where(~F.coalesce("type", F.lit("normal")).isin(*SPECIAL_TYPES))


def appearance_counts(appearances: DataFrame) -> DataFrame:
    """(material_id, name, n, first, last) over regular chapters."""
    return regular(appearances).groupBy("material_id", "name").agg(F.count("*").alias("n"), F.min("chapter").alias("first"), F.max("chapter").alias("last"))


def top_tags(tags: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent tags of every work, of (material_id, tag, chapter); ties by first chapter, then tag."""
    counted = tags.groupBy("material_id", "tag").agg(F.count("*").alias("n"), F.min("chapter").alias("first"))
    order = Window.partitionBy("material_id").orderBy(F.desc("n"), "first", "tag")
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def outline_statistics(chapters: DataFrame, hook: str) -> DataFrame:
    """Mean tension (half to even, two places), chapters with the hook, high-tension chapters, histogram."""
    return chapters.groupBy("material_id").agg(
        F.bround(F.avg("tension_level"), 2).alias("mean_tension"),
        F.count_if(F.col("function") == hook).alias("hooks"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("tension_level") >= 4, F.col("chapter")))), ",").alias("high"),
        F.concat_ws(",", *[F.count_if(F.col("tension_level") == t).cast("string") for t in range(1, 6)]).alias("histogram"),
    )


def previous_in_number(chapters: DataFrame, column: str) -> Column:
    """The column of the chapter one number before; null where that number is missing."""
    w = Window.partitionBy("material_id").orderBy("chapter")
    return F.when(F.lag("chapter").over(w) == F.col("chapter") - 1, F.lag(column).over(w))


def next_in_number(chapters: DataFrame, column: str) -> Column:
    w = Window.partitionBy("material_id").orderBy("chapter")
    return F.when(F.lead("chapter").over(w) == F.col("chapter") + 1, F.lead(column).over(w))


# Structural roles.
ROLES = ("inciting_incident", "first_turning_point", "midpoint", "second_turning_point", "climax", "resolution")


def structural_role(position: Column, tension: Column, turning: Column, climax: Column) -> Column:
    """Role of a chapter by its relative position; the first rule that holds wins, null for none."""
    strong = tension >= 4
    rules = (
        (position <= 0.10) & (tension >= 3),
        (position <= 0.25) & strong & turning,
        position.between(0.40, 0.60) & strong,
        position.between(0.60, 0.80) & strong & turning,
        (position >= 0.80) & ((tension == 5) | climax),
        (position >= 0.90) & (tension <= 2),
    )
    return F.coalesce(*[F.when(rule, role) for rule, role in zip(rules, ROLES)])


def even_sample(rows: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    """``n`` rows of each group at even distances, first and last among them; small groups are taken whole."""
    size = F.count("*").over(Window.partitionBy(group))
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1
    numbered = rows.withColumn("_size", size).withColumn("_place", place)
    hit = F.exists(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * (F.col("_size") - 1) / (n - 1)) == F.col("_place"))
    return numbered.where((F.col("_size") <= n) | hit).drop("_size", "_place")


def progressive_batches(rows: DataFrame, group: str, order: list[str], size: int, batches: int = 5) -> DataFrame:
    """An even sample of each group, dealt in order into ``batches`` of ``size`` rows, numbered from 1 in ``batch``: a reader
    can stop after any of them.  Small groups fill the first batches only."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1
    return even_sample(rows, group, order, size * batches).withColumn("batch", F.floor(place / size) + 1)


def spread(rows: DataFrame, key: str, n_rows: int) -> DataFrame:
    """``rows``, about ``n_rows`` of them, by ``key`` in partitions of at most about ``TASK_ROWS``, however well they compress:
    the number is given, so that adaptive execution does not put partitions together by their compressed bytes.  What is
    grouped, numbered or joined by ``key`` next is not shuffled again."""
    return rows.repartition(n_rows // TASK_ROWS + rows.sparkSession.sparkContext.defaultParallelism, key)


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds the place of each row in the order of the whole table: by range, then within it, after those of all before.

    The ranges are written once, so that counts and rows are of the same ranges.
    """
    path = new_path(rows.sparkSession, "numbered")
    rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    ranged = rows.sparkSession.read.parquet(path)
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each range
    offsets = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_offset"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_place", place).join(offsets, "_part").withColumn(name, F.col("_offset") + F.col("_place")).drop("_part", "_place", "_offset")


def numbered_within(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Adds the place of each row in its group, from 1, an int: its place in the whole table less those of earlier groups, so
    that a group of any size lies in many tasks.  ``group`` has no nulls."""
    placed = numbered(rows, [group, *order], name)
    first = placed.groupBy(group).agg((F.min(name) - 1).alias("_before"))
    return placed.join(first, group).withColumn(name, (F.col(name) - F.col("_before")).cast("int")).select(*rows.columns, name)


def within_budget(rows: DataFrame, group: str, order: list[str], cost: Column, budget: int) -> DataFrame:
    """The ordered rows of each group until the budget is spent."""
    spent = F.sum(cost).over(Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("spent", spent).where(F.col("spent") <= budget)


def neighbour_degree(appearances: DataFrame) -> DataFrame:
    """(material_id, name, degree): distinct names met in a chapter.

    A chapter's names meet each other, so that rows grow with the square of a chapter's cast, which is small.
    """
    one = regular(appearances).select("material_id", "chapter", "name").distinct()
    other = one.withColumnRenamed("name", "other")
    return one.join(other, ["material_id", "chapter"]).where("name <> other").groupBy("material_id", "name").agg(F.countDistinct("other").alias("degree"))


def biography_targets(appearances: DataFrame, key_function: str, navigation: DataFrame, most: int = 12, minor: int = 5) -> DataFrame:
    """(material_id, name, score, reasons, role_hint, rank): weighted signals, each relative to the work's maximum, and the
    confidence of navigation candidates (material_id, name, confidence).

    Characters of at least ``minor`` chapters and candidates that appear at all are ranked; ``most`` of a work stay."""
    signals = regular(appearances).groupBy("material_id", "name").agg(
        F.count("*").alias("n"), (F.max("chapter") - F.min("chapter") + 1).alias("span"), F.count_if(F.col("function") == key_function).alias("key")
    ).join(neighbour_degree(appearances), ["material_id", "name"], "left").fillna(0, ["degree"]).join(navigation, ["material_id", "name"], "left")
    work = Window.partitionBy("material_id")
    share = lambda c: F.coalesce(F.col(c) / F.nullif(F.max(c).over(work), F.lit(0)), F.lit(0.0))
    prior = F.coalesce("confidence", F.lit(0.0))
    parts = signals.select("*", *[share(c).alias(f"_{c}") for c in ("n", "span", "key", "degree")])
    score = F.round(0.35 * F.col("_n") + 0.20 * F.col("_span") + 0.20 * F.col("_key") + 0.10 * F.col("_degree") + 0.15 * prior, 6)
    why = lambda when, *text: F.when(when, F.concat(*[F.lit(t) if isinstance(t, str) else t.cast("string") for t in text]))
    reasons = F.array_compact(F.array(
        why(F.col("_n") > 0, "chapters:", F.col("n")), why(F.col("_span") >= 0.5, "long span"), why(F.col("_key") > 0, "key events:", F.col("key")),
        why(F.col("_degree") > 0, "neighbours:", F.col("degree")), why(F.col("confidence").isNotNull(), "candidate:", F.col("confidence").cast("decimal(4,2)")),
    ))
    hint = F.when((prior >= 0.8) | (F.col("n") >= 50), "protagonist").when(F.col("n") >= 10, "supporting").otherwise("minor")
    order = Window.partitionBy("material_id").orderBy(F.desc("score"), F.desc("n"), "name")
    able = parts.where((F.col("n") >= minor) | F.col("confidence").isNotNull())
    ranked = able.select("material_id", "name", "n", score.alias("score"), reasons.alias("reasons"), hint.alias("role_hint")).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= most)


def character_tier(n: Column, core: int = 50, supporting: int = 10, minor: int = 5) -> Column:
    return F.when(n >= core, "core").when(n >= supporting, "supporting").when(n >= minor, "minor").otherwise("background")


def banded_pairs(chapters: DataFrame, text: Column, width: int, least: float) -> DataFrame:
    """Pairs of a work's chapters at most ``width`` places apart whose character sets are at least ``least`` similar.

    The offset is exploded, so that the join is an equality on work and place.
    """
    from scriptorium.functions.text import character_set, set_similarity

    place = F.row_number().over(Window.partitionBy("material_id").orderBy("chapter"))
    rows = chapters.select("material_id", "chapter", place.alias("place"), character_set(text).alias("chars"))
    later = rows.withColumn("place", F.explode(F.sequence(F.col("place") - width, F.col("place") - 1)))
    both = rows.alias("a").join(later.alias("b"), ["material_id", "place"])
    score = set_similarity(F.col("a.chars"), F.col("b.chars"))
    return both.select("material_id", F.col("a.chapter").alias("first"), F.col("b.chapter").alias("second"), F.round(score, 6).alias("similarity")).where(F.col("similarity") > least)


def fallback_parts(counts: DataFrame) -> DataFrame:
    """Three parts of a work of ``n`` chapters, cut at a quarter and three quarters; short works have fewer."""
    a, b = F.greatest(F.floor(F.col("n") * 0.25), F.lit(1)), F.greatest(F.floor(F.col("n") * 0.75), F.lit(2))
    part = lambda i, lo, hi: F.struct(F.lit(i).alias("part"), lo.cast("long").alias("first"), hi.cast("long").alias("last"))
    parts = F.array(part(1, F.lit(1), F.least(a, F.col("n"))), part(2, a + 1, F.least(b, F.col("n"))), part(3, b + 1, F.col("n")))
    return counts.select("material_id", F.inline(F.filter(parts, lambda p: p["first"] <= p["last"])))
