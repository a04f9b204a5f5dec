"""Bulk-synchronous best-fit packing of token sequences.

Pieces of equal length are interchangeable, and so are open sequences of equal room; both are kept as runs, tables of
(size, n, first) whose rows depend on the limit and not on the number of pieces.  A superstep range-sorts the runs of
waiting pieces and of gaps together, from large to small, and sweeps every range at once: a run of pieces takes the
nearest larger gaps, its successors, as a closing bracket takes the nearest open one.  Conflicts are resolved by rank:
piece r of a run gets gap r, and the pieces beyond the gaps go on to the next larger ones.  Gaps are updated as they take
pieces, and come back where the sweep reaches the room that they have left.  What the ranges leave over is swept in wider
ranges.  New sequences are opened when no gap fits what waits, and the supersteps repeat until nothing waits.  Spark then
ranks the pieces of each run across partitions and looks their places up in the table of matches.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache, reduce
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import BOX, boxed, extended, unboxed, with_columns, written
from scriptorium.llm.token_transducer import byte_letters

#: Words whose ids a worker keeps.
MAX_WORDS = 300_000
# The pre-tokens of the word-end vocabulary within Latin-1; white space is dropped.
PRE_TOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^ \t-\r\x85\xa0a-zªµºß-öø-ÿ0-9²³¹¼½¾]+")
ASCII_WORD = re.compile(r"[^ \t-\r]+")


class Recent(dict):
    """A bounded memo: when half of it is full, what was not used since the last time is forgotten."""

    def __init__(self, size: int):
        super().__init__()
        self.half, self.old = size // 2, {}

    def __missing__(self, key):
        self[key] = value = self.old[key]
        return value

    def trim(self) -> None:
        if len(self) > self.half:
            self.old = dict(self)
            self.clear()


class WordIds:
    """Ids of whole texts under a word-end BPE file that drops white space, so that words between ASCII white space
    stand alone.  Words of Latin-1 are split into pre-tokens here and merged by the library's model; others, and texts
    with a special token's string in them, go through the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = byte_letters()
        self.words, self.pieces = Recent(MAX_WORDS), Recent(MAX_WORDS)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, pieces: set[str]) -> None:
        known, old = self.pieces, self.pieces.old
        for piece in pieces:
            if piece not in known and piece not in old:
                mapped = piece if piece.isascii() and piece.isprintable() else "".join(self.letters[b] for b in piece.encode())
                known[piece] = array("I", [t.id for t in self.merge(mapped)]).tobytes()

    def latin(self, text: str) -> bytes:
        pieces = PRE_TOKEN.findall(text.lower())
        try:
            return b"".join(map(self.pieces.__getitem__, pieces))
        except KeyError:
            self.learn({*pieces})
            return b"".join(map(self.pieces.__getitem__, pieces))

    def word(self, word: str) -> bytes:
        try:
            return self.words[word]
        except KeyError:
            self.words[word] = ids = self.latin(word) if max(word) < "\u0100" else self.whole(word)
            return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            self.words.trim()
            self.pieces.trim()
            if any(s in text for s in self.special):
                out.append(self.whole(text))
            elif text.isascii() or max(text) < "\u0100":
                out.append(self.latin(text))
            else:
                out.append(b"".join(map(self.word, ASCII_WORD.findall(text))))
        return out


@lru_cache(2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


GAP, WAITING, MATCH = range(3)
RUNS = "kind int, size long, n long, first long, per long, seq long, room long"
#: Runs of one range, and ranges whose leftovers are swept together next.
RANGE_RUNS = 256
MERGED_RANGES = 8


def sweep(rows: list[tuple[int, int, int, int]]) -> tuple[list[tuple], list[tuple]]:
    """One pass over runs (kind, size, n, first), from large to small and gaps before pieces of the same size.

    Returns matches (length, pieces, first rank, pieces a gap, first sequence, room) and what is left: runs without a
    match, and gaps, whole or with the room that their pieces left them.  A gap takes as many pieces of one run as it
    holds, and takes part again once the pass comes down to its new room."""
    stack, back, matches, waiting = [], [], [], []

    def returned(size: int) -> None:
        while back and -back[0][0] >= size:
            room, seq, n = heappop(back)
            stack.append([-room, n, seq])

    def give(room: int, n: int, seq: int) -> None:
        if room and n:
            heappush(back, (-room, seq, n))

    for kind, size, n, first in rows:
        returned(size)
        if kind == GAP:
            stack.append([size, n, first])
            continue
        while n and stack:
            room, gaps, seq = stack[-1]
            per = room // size
            take = min(gaps, -(-n // per))
            placed = min(n, take * per)
            matches.append((size, placed, first, per, seq, room))
            whole = placed // per
            give(room - per * size, whole, seq)
            if whole < take:
                give(room - (placed - whole * per) * size, 1, seq + whole)
            n, first = n - placed, first + placed
            stack[-1] = [room, gaps - take, seq + take]
            if gaps == take:
                stack.pop()
            returned(size)
        if n:
            waiting.append((WAITING, size, n, first))
    return matches, waiting + [(GAP, *g) for g in stack] + [(GAP, -room, n, seq) for room, seq, n in back]


def from_large_to_small() -> tuple[Column, ...]:
    return F.desc("size"), F.asc("kind"), F.asc("first")


def swept(ranges: DataFrame) -> DataFrame:
    """Sweep the runs of every partition, all partitions side by side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("kind", "size", "n", "first")))]
        matches, rest = sweep(rows)
        out = [(MATCH, *m) for m in matches] + [(*r, None, None, None) for r in rest]
        columns = list(zip(*out)) or [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32())] + [pa.array(c, pa.int64()) for c in columns[1:]], names=["kind", "size", "n", "first", "per", "seq", "room"])

    return ranges.sortWithinPartitions(*from_large_to_small()).mapInArrow(run, RUNS)


def superstep(runs: DataFrame, n_runs: int) -> DataFrame:
    """Matches, and the runs that are left.

    Pieces find their successors within ranges of about ``RANGE_RUNS`` runs first; what the ranges leave over meets
    within ranges ``MERGED_RANGES`` times as wide, and so on up to one."""
    ranges, matched = -(-n_runs // RANGE_RUNS), []
    while ranges > 1:
        runs = written(swept(runs.repartitionByRange(ranges, *from_large_to_small())), "ranges")
        matched.append(runs.where(F.col("kind") == MATCH))
        runs, ranges = runs.where(F.col("kind") != MATCH), -(-ranges // MERGED_RANGES)
    return reduce(DataFrame.union, matched, swept(runs.coalesce(1)))


def best_fit_matches(counts: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """All matches of (length, n) runs, and their number.

    The rows of a superstep are bounded by the limit; the driver sees a few sums of each."""
    spark = counts.sparkSession
    state = written(counts.select(F.lit(WAITING).alias("kind"), F.col("length").cast("long").alias("size"), F.col("n").cast("long").alias("n"), F.lit(0).cast("long").alias("first"), *[F.lit(None).cast("long").alias(c) for c in ("per", "seq", "room")]), "runs")
    opened = 0
    waits, takes = F.col("kind") == WAITING, F.col("kind") == GAP
    while True:
        sums = state.agg(
            F.sum(F.when(waits, F.col("size") * F.col("n"))).alias("tokens"), F.sum(F.when(waits & (2 * F.col("size") > limit), F.col("n"))).alias("alone"),
            F.min(F.when(waits, F.col("size"))).alias("least"), F.max(F.when(takes, F.col("size"))).alias("most"), F.count(F.when(~waits & ~takes, 1)).alias("matches"), F.count(F.when(waits | takes, 1)).alias("runs"),
        ).first()
        if not sums["least"]:
            return state.where(~waits & ~takes), sums["matches"]
        if (sums["most"] or 0) < sums["least"]:  # no gap fits anything that waits
            new = sums["alone"] or -(-sums["tokens"] // limit)  # pieces over half the limit take one each in any case
            state = state.union(spark.range(1).select(F.lit(GAP), F.lit(limit).cast("long"), F.lit(new).cast("long"), F.lit(opened).cast("long"), *[F.lit(None).cast("long")] * 3))
            opened += new
        taking = waits | (takes & (F.col("size") >= sums["least"]))
        state = written(state.where(~taking).union(superstep(state.where(taking), sums["runs"])).coalesce(1), "runs")


def tokenized_pieces(docs: DataFrame, *, tokenizer: str, limit: int, end_id: int = 0) -> DataFrame:
    """Rows (box, piece, start, length, ids_crc32, part, local_rank) of (box, text): documents cut at ``limit``; the rank is
    among the pieces of the same length and partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, end = TaskContext.get().partitionId(), np.zeros(limit + 1, np.int64), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for at in range(0, len(texts), 500):
                row, out = [], []
                for i, ids in enumerate(word_ids(tokenizer).encode(texts[at : at + 500]), at):
                    ids += end
                    for piece, start in enumerate(range(0, len(ids), 4 * limit)):
                        cut = ids[start : start + 4 * limit]
                        n = len(cut) // 4
                        row.append(i)
                        out.append((piece, start // 4, n, zlib.crc32(cut), seen[n]))
                        seen[n] += 1
                piece, start, length, crc, rank = zip(*out)
                yield with_columns(batch.take(pa.array(row)), [BOX], piece=pa.array(piece, pa.int32()), start=pa.array(start, pa.int64()), length=pa.array(length, pa.int64()), ids_crc32=pa.array(crc, pa.int64()), part=pa.array([part] * len(row), pa.int64()), local_rank=pa.array(rank, pa.int64()))

    return docs.mapInArrow(run, extended(docs.select(BOX).schema, "piece int, start long, length long, ids_crc32 long, part long, local_rank long"))


#: Matches that are broadcast at most; more are joined by length.
BROADCAST_MATCHES = 1 << 17


def pack(docs: DataFrame, *, text: str, tokenizer: str, limit: int = 2048, end_id: int = 0) -> DataFrame:
    """Pack all documents into as few sequences of at most ``limit`` tokens as best fit finds.

    Returns the other columns of ``docs`` and piece, start, length, ids_crc32, sequence_id and offset, a row for each
    piece.  A null or empty text is the end token alone; repeated rows are packed each; an empty table gives an empty
    result.  Existing columns of the new names are replaced; columns of any other name pass through.
    """
    new = ("piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    keep = [c for c in docs.columns if c != text and c not in new]
    box = boxed(docs, keep, text=F.col(text))
    pieces = written(tokenized_pieces(box, tokenizer=tokenizer, limit=limit, end_id=end_id), "pieces")
    # Ranks across partitions: a row for each partition and length, summed up before each.
    runs = written(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-runs")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    matches, n_matches = best_fit_matches(runs.groupBy("length").agg(F.sum("n").alias("n")), limit)
    matches = matches.select(F.col("size").alias("length"), F.col("n").alias("placed"), "first", "per", "seq", "room")
    if n_matches <= BROADCAST_MATCHES:
        matches = F.broadcast(matches)
    at = F.col("local_rank") + F.col("before")
    placed = pieces.join(offsets, ["length", "part"]).withColumn("rank", at).join(matches, "length").where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("placed")))
    k = F.col("rank") - F.col("first")
    sequence, offset = F.col("seq") + F.floor(k / F.col("per")), F.lit(limit) - F.col("room") + k % F.col("per") * F.col("length")
    return placed.select(*unboxed(keep, pieces.schema), "piece", "start", "length", "ids_crc32", sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))
