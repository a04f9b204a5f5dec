"""Relevance metrics of rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def metrics_at(ranked: DataFrame, judgments: DataFrame, k: int, groups: DataFrame | None = None) -> DataFrame:
    """Per judged query: recall, precision, reciprocal rank, nDCG and distinct works at ``k``.

    ``ranked`` (query_id, result_id, rank, material_id), ``judgments`` (query_id, result_id, relevance 0..3).  Recall is
    0 where nothing is relevant; a query without results has zeros.  Where queries share their judgments, ``groups``
    (query_id, judged_by) tells whose they are and ``judgments`` has judged_by for query_id, so that they are not repeated.
    """
    key = "query_id" if groups is None else "judged_by"
    judged = judgments.groupBy(key, "result_id").agg(F.max("relevance").alias("relevance"))
    gain = lambda rel, at: (F.pow(F.lit(2.0), rel) - 1) / F.log2(at + 1)
    ideal_rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("relevance"), "result_id"))
    ideal = judged.withColumn("at", ideal_rank).where(F.col("at") <= k).groupBy(key).agg(F.sum(gain(F.col("relevance"), F.col("at"))).alias("ideal"))
    best = judged.groupBy(key).agg(F.count_if(F.col("relevance") > 0).alias("relevant")).join(ideal, key)
    first = ranked.where(F.col("rank") <= k)
    if groups is not None:
        best, first = groups.join(best, key), first.join(groups, "query_id", "left")
    top = first.join(judged, [key, "result_id"], "left").withColumn("relevance", F.coalesce("relevance", F.lit(0)))
    own = top.groupBy("query_id").agg(
        F.count_if(F.col("relevance") > 0).alias("hit"), F.count("*").alias("shown"), F.min(F.when(F.col("relevance") > 0, F.col("rank"))).alias("first"), F.sum(gain(F.col("relevance"), F.col("rank"))).alias("gain"), F.countDistinct("material_id").alias("works")
    )
    both = best.join(own, "query_id", "left")
    ratio = lambda a, b: F.round(F.when(F.coalesce(b, F.lit(0)) > 0, F.coalesce(a, F.lit(0)) / b).otherwise(0.0), 6)
    return both.select(
        "query_id", ratio(F.col("hit"), F.col("relevant")).alias("recall"), ratio(F.col("hit"), F.lit(k)).alias("precision"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"),
        ratio(F.col("gain"), F.col("ideal")).alias("ndcg"), F.coalesce("works", F.lit(0)).alias("works"),
    )


def macro_average(metrics: DataFrame, kind: str) -> DataFrame:
    """Averages by ``kind`` and over all (kind null), in one pass with grouping sets."""
    names = [c for c in metrics.columns if c not in ("query_id", kind)]
    return metrics.rollup(kind).agg(F.count("*").alias("n"), *[F.round(F.avg(c), 5).alias(c) for c in names])


def candidate_gate(recall: Column, ndcg: Column, exact_ndcg: Column, p95_ms: Column, lost: Column) -> Column:
    """Whether approximate candidates are good enough."""
    return (recall >= 0.98) & (exact_ndcg - ndcg <= 0.01 + 1e-12) & (p95_ms <= 180_000) & (lost == 0)


def gated_run(exact: DataFrame, candidate: DataFrame, judgments: DataFrame, latencies: DataFrame, k: int, groups: DataFrame | None = None) -> DataFrame:
    """One row: how a run of candidates compares with the exact run, and whether it passes ``candidate_gate``.

    ``recall`` is the mean share of a query's exact first ``k`` that the candidates' first ``k`` hold, ``ndcg`` and
    ``exact_ndcg`` are means over judged queries, ``lost`` counts queries that have something relevant in the exact run
    only, ``p95`` is over ``latencies`` (ms).  ``groups`` as in ``metrics_at``."""
    first = lambda run: run.where(F.col("rank") <= k).select("query_id", "result_id")
    kept = first(candidate).withColumn("kept", F.lit(1))
    share = first(exact).join(kept, ["query_id", "result_id"], "left").groupBy("query_id").agg((F.count("kept") / F.count("*")).alias("share")).agg(F.avg("share").alias("recall"))
    score = lambda run, name: metrics_at(run.select("query_id", "result_id", "rank", F.lit(0).alias("material_id")), judgments, k, groups).select("query_id", F.col("ndcg").alias(name), (F.col("recall") > 0).alias(f"{name}_found"))
    both = score(exact, "e").join(score(candidate, "c"), "query_id").agg(F.avg("e").alias("exact_ndcg"), F.avg("c").alias("ndcg"), F.count_if(F.col("e_found") & ~F.col("c_found")).alias("lost"))
    one = share.crossJoin(both).crossJoin(latencies.agg(F.percentile("ms", 0.95).alias("p95")))  # single rows
    return one.withColumn("passed", candidate_gate(F.col("recall"), F.col("ndcg"), F.col("exact_ndcg"), F.col("p95"), F.col("lost")))
