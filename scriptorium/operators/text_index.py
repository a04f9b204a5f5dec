"""An inverted index of texts on disk, in blocks of postings with their maxima, that takes new and changed documents.

A posting is what the lexical score needs of a word in a document: how often it occurs, and its first and last place.  The
postings of a word are cut into blocks by ranges of documents of like length, the same ranges for all words, and name documents by their places in the range; a block tells
the most occurrences and the shortest span in it.  No document of a range that has all words can score more than the sum
of its blocks' most over the longest of their shortest spans, and one that has any of them no more than the sum of most
over shortest span.  A search reads the blocks' maxima of its words, scores the postings of the
most promising ranges, and then those of other ranges only that could still reach the k-th score found so far.

The texts of a range meet in one task, which makes its blocks; postings are not shuffled one by one.  A search brings the
blocks of a range to one task too, with the queries that ask for them, and scores its documents there.

Blocks lie in folders by the hash of their word, so that a search opens the folders of its words.  An update writes a
segment of its own; the newest segment that names a document is the one that counts for it.  A merge tells
by the places of a range, block by block, what counts.  A segment counts once it is listed, and is listed when it is whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import word_tokens
from scriptorium.operators.retrieval import top_k
from scriptorium.sources.shared import written

#: Folders by hash of the word, and documents and characters of a range, about.
FOLDERS, RANGE, RANGE_CHARS = 64, 1024, 1 << 23
#: Ranges that are scored first for every query; at least as many as documents are asked for, so that there is a k-th score.
FIRST = 4


class TextIndex:
    """The index under ``path``; one writer at a time, and readers see the segments that were listed when they began."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def segments(self) -> list[int]:
        """The listed segments, without those that a merge has replaced."""
        try:
            rows = self.spark.read.schema("segment long, replaces long").json(f"{self.path}/segments").collect()
        except Exception as error:
            if "PATH_NOT_FOUND" in str(error):
                return []
            raise
        gone = max((r["replaces"] for r in rows), default=-1)
        return sorted(r["segment"] for r in rows if r["segment"] > gone)

    def _list(self, segment: int, replaces: int = -1) -> None:
        self.spark.createDataFrame([(segment, replaces)], "segment long, replaces long").coalesce(1).write.mode("append").json(f"{self.path}/segments")

    def _write(self, blocks: DataFrame, documents: DataFrame, segment: int, replaces: int = -1) -> None:
        """Blocks (term, range, entries) and documents (id, range, place) as a segment."""
        e = F.col("entries")
        maxima = [F.size(e).cast("long").alias("n_docs"), F.array_max(e["n"]).alias("most_n"), F.array_min(F.transform(e, lambda x: x["hi"] - x["lo"] + 1)).alias("least_span")]
        placed = blocks.select("term", "range", "entries", F.pmod(F.xxhash64("term"), F.lit(FOLDERS)).cast("int").alias("folder")).hint("rebalance", F.col("folder"))
        placed.select("term", "range", *maxima, "entries", "folder").sortWithinPartitions("folder", "term").write.mode("overwrite").partitionBy("folder").parquet(f"{self.path}/blocks/segment={segment}")
        documents.select("id", F.lit(segment).cast("long").alias("since"), "range", "place").write.mode("overwrite").parquet(f"{self.path}/documents/segment={segment}")
        self._list(segment, replaces)

    def upsert(self, docs: DataFrame, *, id: str, text: str) -> int:
        """Index ``docs``, of distinct ids; what earlier segments hold of them no longer counts.  A null text has no words.
        Returns the segment's number."""
        segment = max(self.segments(), default=-1) + 1
        own = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        own = own.withColumn("length", F.floor(F.log2(F.length("text") + F.lit(1))).cast("long"))
        sizes = own.groupBy("length").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).collect()  # at most 32
        ranges = {r["length"]: max(r["n"] // RANGE, r["chars"] // RANGE_CHARS) + 1 for r in sizes} or {0: 1}
        dealt = F.create_map(*[F.lit(x).cast("long") for pair in ranges.items() for x in pair])[F.col("length")]
        own = own.withColumn("range", F.col("length") * (1 << 32) + F.pmod(F.xxhash64("id"), dealt))
        place = (F.row_number().over(Window.partitionBy("range").orderBy("id")) - 1).alias("place")
        met = lambda *columns: own.select("range", "id", *columns).repartition(sum(ranges.values()), "range").select("*", place)
        words = met("text").select("range", "place", F.posexplode(word_tokens(F.col("text"))).alias("pos", "term"))
        postings = words.groupBy("range", "term", "place").agg(F.count("*").cast("int").alias("n"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
        blocks = postings.groupBy("range", "term").agg(F.collect_list(F.struct("place", "n", "lo", "hi")).alias("entries"))
        self._write(blocks, met(), segment)
        return segment

    def _read(self, kind: str) -> DataFrame:
        listed = self.segments()
        return self.spark.read.option("basePath", f"{self.path}/{kind}").parquet(*[f"{self.path}/{kind}/segment={s}" for s in listed])

    def blocks(self) -> DataFrame:
        """All blocks: (term, range, n_docs, most_n, least_span, entries, folder, segment)."""
        return self._read("blocks")

    def current(self) -> DataFrame | None:
        """(id, since) of documents that a later segment than the first of all names, the newest one; None if there are none."""
        listed = self.segments()
        if len(listed) < 2:
            return None
        newer = self._read("documents").where(F.col("segment") > listed[0])
        return newer.groupBy("id").agg(F.max("since").alias("since"))

    def merge(self) -> int:
        """Write all that counts as one segment, which replaces the others; ranges of one number become one.  Blocks meet the
        new places of their range's documents, and are shuffled by range only."""
        segment = self.segments()[-1] + 1
        counts = F.col("since") == F.max("since").over(Window.partitionBy("id"))
        documents = self._read("documents").select("id", "since", "range", "place", counts.alias("counts"))
        nth = F.row_number().over(Window.partitionBy("range").orderBy(F.desc("counts"), "since", "place")) - 1
        documents = written(documents.withColumn("to", F.when(F.col("counts"), nth)), "documents")
        n_ranges = documents.agg(F.countDistinct("range")).first()[0]
        moves = F.transform(F.array_sort(F.collect_list(F.struct("place", "to"))), lambda x: x["to"])
        moved = documents.groupBy("range", "since").agg(moves.alias("moves")).groupBy("range").agg(F.map_from_entries(F.collect_list(F.struct("since", "moves"))).alias("moved"))
        blocks = self.blocks().select("term", "range", F.col("segment").cast("long").alias("since"), "entries").repartition(max(1, n_ranges), "range")
        to = F.col("moved")[F.col("since")]
        kept = F.filter(F.transform("entries", lambda e: F.struct(to[e["place"]].alias("place"), e["n"].alias("n"), e["lo"].alias("lo"), e["hi"].alias("hi"))), lambda e: e["place"].isNotNull())
        blocks = blocks.join(moved, "range").select("range", "term", kept.alias("entries")).where(F.size("entries") > 0)
        blocks = blocks.groupBy("range", "term").agg(F.flatten(F.collect_list("entries")).alias("entries"))
        self._write(blocks, documents.where("counts").select("id", "range", F.col("to").alias("place")), segment, segment - 1)
        return segment

    def opened(self, terms: DataFrame) -> DataFrame:
        """The blocks in the folders of the words in ``terms`` (term); no other folder is read."""
        folders = terms.select(F.pmod(F.xxhash64("term"), F.lit(FOLDERS)).cast("int").alias("folder")).distinct()
        return self.blocks().where(F.col("folder").isin([r["folder"] for r in folders.collect()]))  # at most FOLDERS

    def asked(self, terms: DataFrame) -> DataFrame:
        """The blocks of the words in ``terms`` (term)."""
        return self.opened(terms).join(terms.select("term").distinct(), "term", "left_semi")

    def search(self, queries: DataFrame, *, match: str = "all", limit: int) -> DataFrame:
        """(query_id, id, rank, score) as ``lexical_search`` has it, ties to the smaller id."""
        return top_k(self.scored(queries, match=match, limit=limit), "query_id", [F.desc("score"), F.asc("id")], limit).select("query_id", "id", "rank", "score")

    def scored(self, queries: DataFrame, *, match: str, limit: int) -> DataFrame:
        """(query_id, id, score) of every document that was scored, the k best of each query among them."""
        terms = written(queries.select("query_id", F.explode(F.array_distinct(word_tokens(F.col("query")))).alias("term")), "terms")
        wanted = terms.groupBy("query_id").agg(F.count("*").alias("n_terms"))
        maxima = self.asked(terms).select("segment", "term", "range", "n_docs", "most_n", "least_span")
        most = F.sum("most_n") / F.max("least_span") if match == "all" else F.sum(F.col("most_n") / F.col("least_span"))
        bound = F.least(F.lit(1.0), F.round(most, 6)).alias("bound")
        ranges = maxima.join(terms, "term").groupBy("query_id", "segment", "range").agg(F.count("*").alias("hit"), bound).join(wanted, "query_id")
        ranges = written(ranges.where("hit = n_terms") if match == "all" else ranges, "ranges")
        first = top_k(ranges, "query_id", [F.desc("bound"), F.asc("segment"), F.asc("range")], max(FIRST, limit)).select("query_id", "segment", "range", "n_terms")
        head = written(self._score(first, terms, match), "scored")
        least = head.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id")))).where(F.col("nth") == limit).select("query_id", F.col("score").alias("least"))
        rest = ranges.join(first, ["query_id", "segment", "range"], "left_anti").join(least, "query_id", "left").where("least is null or bound >= least")
        return head.union(self._score(rest.select("query_id", "segment", "range", "n_terms"), terms, match))

    def _score(self, ranges: DataFrame, terms: DataFrame, match: str) -> DataFrame:
        """Exact scores of the documents in ``ranges`` (query_id, segment, range, n_terms) that count.

        A block goes once to the task of its range, however many queries ask for it, and meets them there."""
        askers = terms.groupBy("term").agg(F.collect_list("query_id").alias("askers"))
        needed = ranges.groupBy("segment", "range").agg(F.map_from_entries(F.collect_list(F.struct("query_id", "n_terms"))).alias("needed"))
        ids = self._read("documents").groupBy(F.col("since").alias("segment"), "range").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]).alias("ids"))
        needed = written(needed.withColumn("segment", F.col("segment").cast("long")).join(ids, ["segment", "range"]), "needed")
        blocks = self.opened(terms).select(F.col("segment").cast("long").alias("segment"), "term", "range", "entries").join(askers, "term")
        blocks = blocks.join(needed.select("segment", "range"), ["segment", "range"], "left_semi").repartition(max(1, needed.count()), "segment", "range").join(needed, ["segment", "range"])
        asking = F.transform(F.array_intersect("askers", F.map_keys("needed")), lambda q: F.struct(q.alias("query_id"), F.col("needed")[q].alias("n_terms")))
        rows = blocks.select("segment", "range", "entries", "ids", F.inline(asking)).select("segment", "range", "query_id", "n_terms", "ids", F.inline("entries"))
        met = rows.groupBy("segment", "range", "query_id", "n_terms", F.col("ids")[F.col("place")].alias("id")).agg(F.count("*").alias("hit"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        if match == "all":
            met = met.where("hit = n_terms")
        current = self.current()
        if current is not None:
            met = met.join(current, "id", "left").where("since is null or segment = since")
        return met.select("query_id", "id", F.round(F.col("n") / (F.col("hi") - F.col("lo") + 1), 6).alias("score"))
