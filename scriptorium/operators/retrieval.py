"""Lexical, vector and structured retrieval over batches of queries, rank fusion, diversity and context."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from scriptorium.functions.text import trigram_similarity, word_tokens
from scriptorium.sources.shared import written

#: Bytes of queries, and of vectors, that meet in a task at once, and vectors of a slice that are scored at once.
QUERY_BYTES, VECTOR_BYTES, CHUNK = 8 << 20, 64 << 20, 2048


def postings(docs: DataFrame, *, id: str, text: str) -> DataFrame:
    """(id, term, pos): one row for each word of a document."""
    return docs.select(id, F.posexplode(word_tokens(F.col(text))).alias("pos", "term"))


def rarest(terms: DataFrame, counts: DataFrame) -> DataFrame:
    """(query_id, term): of the words (query_id, term) of every query the one that fewest documents have, by ``counts``
    (term, n_docs); none of a query that has a word without documents."""
    known = terms.join(counts, "term", "left").groupBy("query_id")
    return known.agg(F.min_by("term", F.struct("n_docs", "term")).alias("term"), F.count_if(F.col("n_docs").isNull()).alias("missing")).where("missing = 0").select("query_id", "term")


def with_rarest(docs: DataFrame, terms: DataFrame, *, id: str, text: str) -> DataFrame:
    """(query_id, id): the documents with the rarest word of a query, of its words (query_id, term)."""
    words = docs.select(id, F.explode(F.array_distinct(word_tokens(F.col(text)))).alias("term"))
    counts = words.join(terms.select("term").distinct(), "term").groupBy("term").agg(F.count("*").alias("n_docs"))
    return words.join(written(rarest(terms, counts), "rarest"), "term").select("query_id", id)


def lexical_search(docs: DataFrame, queries: DataFrame, *, id: str, text: str, match: str = "all", limit: int = 200, title: str | None = None, ties: tuple[Column, ...] = ()) -> DataFrame:
    """(query_id, id, rank, score): documents with all (or any) words of the query, by cover density.

    The score is the number of places of query words over the span that they cover.  Ties go to the trigram similarity of
    ``title`` with the query, then to the document type's own order ``ties``, then to the smaller id.  Where all words must
    be there, a query's rarest word names the documents that can match, and only those documents' postings of words that
    some query asks for are shuffled, counted for each document before they meet; titles are compared for matches only.
    """
    terms = written(queries.select("query_id", F.explode(F.array_distinct(word_tokens(F.col("query")))).alias("term")), "terms")
    wanted = terms.groupBy("query_id").agg(F.count("*").alias("n_terms"))
    if match == "all":
        possible = written(with_rarest(docs, terms, id=id, text=text), "possible")
        docs_met, asked = docs.select(id, text).join(possible.select(id).distinct(), id, "left_semi"), possible.join(terms, "query_id")
    else:
        docs_met, asked = docs, terms
    own = postings(docs_met, id=id, text=text).join(terms.select("term").distinct(), "term")
    own = own.groupBy(id, "term").agg(F.count("*").alias("n"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    met = own.join(asked, ["term", id] if match == "all" else ["term"]).groupBy("query_id", id).agg(F.count("*").alias("hit"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    if match == "all":
        met = met.join(wanted, "query_id").where("hit = n_terms")
    scored = met.withColumn("score", F.round(F.col("n") / (F.col("hi") - F.col("lo") + 1), 6))
    order = [F.desc("score")]
    if title or ties:
        scored = scored.select("query_id", id, "score").join(docs.drop(text) if title != text else docs, id)
    if title:
        scored = scored.join(queries.select("query_id", F.col("query").alias("_asked")), "query_id")
        scored = scored.withColumn("_likeness", F.round(trigram_similarity(F.col(title), F.col("_asked")), 6))
        order.append(F.desc("_likeness"))
    return top_k(scored, "query_id", [*order, *ties, F.asc(id)], limit).select("query_id", id, "rank", "score")


def top_k(rows: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of every group with their ``rank``; Spark limits each partition before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


def paired(vectors: DataFrame, queries: DataFrame, *, id: str, vector: str) -> PandasCogroupedOps:
    """Queries (query_id, vector) cogrouped with ``vectors``: a block of about ``QUERY_BYTES`` and a slice of about
    ``VECTOR_BYTES`` in each group, and every block with every slice.  Nothing but two sizes reaches the driver."""
    asked = queries.where(F.col("vector").isNotNull()).select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    known = vectors.where(F.col(vector).isNotNull()).select(id, F.col(vector).cast("array<double>").alias("vector"))
    size = lambda rows: 8 * (rows.agg(F.sum(F.size("vector"))).first()[0] or 0)
    blocks, slices = size(asked) // QUERY_BYTES + 1, size(known) // VECTOR_BYTES + 1
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = asked.select("*", dealt("query_id", blocks).alias("block"), every(slices).alias("slice"))
    right = known.select("*", every(blocks).alias("block"), dealt(id, slices).alias("slice"))
    return left.groupBy("block", "slice").cogroup(right.groupBy("block", "slice"))


def with_norms(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    x = np.array(rows.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(rows), -1)
    return x, np.linalg.norm(x, axis=1, keepdims=True)


def vector_search(vectors: DataFrame, queries: DataFrame, *, id: str, vector: str, k: int) -> DataFrame:
    """(query_id, id, rank, score): exact cosine top k for every query vector.

    ``queries`` (query_id, vector) meet the vectors in tasks, see ``paired``; a pair of a block and a slice keeps k rows for
    each query.  Null and zero vectors take no part.
    """

    def run(q: pa.Table, v: pa.Table) -> pa.Table:
        if not len(q) or not len(v):
            return pa.table({"query_id": pa.array([], pa.int64()), id: pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        names, (asked_x, asked_norm) = q.column("query_id").to_numpy(), with_norms(q)
        asked_x /= np.maximum(asked_norm, 1e-300)
        best_id, best = np.empty((len(names), 0), np.int64), np.empty((len(names), 0))
        for at in range(0, len(v), CHUNK):
            some = v.slice(at, CHUNK)
            x, norm = with_norms(some)
            keep = norm[:, 0] > 0
            ids = some.column(id).to_numpy()[keep]
            score = np.round(asked_x @ (x[keep] / norm[keep]).T, 6)
            score, ids = np.hstack([best, score]), np.hstack([best_id, np.broadcast_to(ids, score.shape)])
            order = np.lexsort((ids, -score), axis=1)[:, :k]
            best, best_id = np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)
        return pa.table({"query_id": np.repeat(names, best.shape[1]), id: best_id.ravel(), "score": best.ravel()})

    pairs = paired(vectors, queries, id=id, vector=vector)
    return top_k(pairs.applyInArrow(run, f"query_id long, {id} long, score double"), "query_id", [F.desc("score"), F.asc(id)], k)


def retriever_ranks(results: DataFrame) -> DataFrame:
    """Of (query_id, retriever, result_id, rank) rows the best of each result; duplicates keep the rank they used up."""
    return results.groupBy("query_id", "retriever", "result_id").agg(F.min("rank").alias("rank"))


def reciprocal_rank_fusion(results: DataFrame, k: int = 60) -> DataFrame:
    """(query_id, result_id, score, retrievers, rank): the sum of 1 / (k + rank) over retrievers, ties by result."""
    one = retriever_ranks(results).groupBy("query_id", "result_id").agg(F.round(F.sum(1 / (k + F.col("rank"))), 9).alias("score"), F.array_join(F.array_sort(F.collect_list("retriever")), ",").alias("retrievers"))
    return one.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "result_id")))


def diversified(ranked: DataFrame, *, cap: int, limit: int) -> DataFrame:
    """At most ``cap`` results of a work first, in rank order, then the others as back-fill; ``limit`` in all."""
    nth = F.row_number().over(Window.partitionBy("query_id", "material_id").orderBy("rank"))
    over = ranked.withColumn("over_cap", (nth > cap).cast("int"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("over_cap", "rank"))
    return over.withColumn("place", place).where(F.col("place") <= limit)


def with_neighbours(hits: DataFrame, chapters: DataFrame, *, text: str) -> DataFrame:
    """Adds ``previous`` and ``next``: the texts of the chapters one number before and after, null across gaps."""
    near = chapters.select("material_id", F.col("chapter"), F.col(text))
    before = near.select("material_id", (F.col("chapter") + 1).alias("chapter"), F.col(text).alias("previous"))
    after = near.select("material_id", (F.col("chapter") - 1).alias("chapter"), F.col(text).alias("next"))
    return hits.join(before, ["material_id", "chapter"], "left").join(after, ["material_id", "chapter"], "left")


def label_pool(cases: DataFrame, tiers: list[tuple[str, DataFrame]], *, limit: int, least: int) -> DataFrame:
    """(query_id, place, result_id, source) for labelling: all hits of the first tier up to ``limit``, then those of later
    ones while the pool has fewer than ``least``; a result counts for its first source.  A case without any has a row of
    the source "none".  Tiers are (name, (query_id, result_id, rank)), each ranked from 1."""
    union = None
    for i, (name, hits) in enumerate(tiers):
        own = hits.where(F.col("rank") <= limit).select("query_id", "result_id", F.lit(i).alias("tier"), "rank", F.lit(name).alias("source"))
        union = own if union is None else union.union(own)
    first = union.groupBy("query_id", "result_id").agg(F.min("tier").alias("tier"), F.min_by("rank", "tier").alias("rank"), F.min_by("source", "tier").alias("source"))
    placed = first.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("tier", "rank")))
    pool = placed.where((F.col("tier") == 0) | (F.col("place") <= least)).select("query_id", "place", "result_id", "source")
    return cases.select("query_id").join(pool, "query_id", "left").withColumn("source", F.coalesce("source", F.lit("none")))
