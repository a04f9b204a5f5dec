"""Spelling variants: words within one edit of each other, found in a trie of letter-group counts.

Letters are dealt into a few groups of about equal weight, and a word's path is the number of its letters in every group.
One inserted letter is a surplus of one in one group, one deleted letter a deficit, a replaced one both or neither.  The
words, sorted by path, are the trie in depth-first order; Spark cuts it into sections, and every word is sent to the
sections that it can reach with its budget of one surplus and one deficit, which a walk over the sections' bounds tells.
In a section all words that came go down the trie together: at every node those stay whose budget allows the node's
count, and at a leaf its words are verified letter by letter.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import written

#: Groups of letters, which are the trie's levels.
GROUPS = 16
#: Words of a section, unless the table has more than ``MOST_SECTIONS`` of them: the sections' bounds, which go to every
#: task, are then at most 2 * GROUPS * MOST_SECTIONS bytes.
SECTION_WORDS, MOST_SECTIONS = 8192, 65_536
#: Words that search a section in one task.
SEARCHING = 65_536
#: Words that a worker counts before it passes them on, and pairs that are verified at once.
COUNTED, PAIRS = 400_000, 100_000
#: Letters of a word that are compared in arrays; longer words are compared one by one.
WIDTH = 48


def counted_words(docs: DataFrame, *, id: str, text: str, spoil: int | None, least_length: int) -> DataFrame:
    """(word, n) of whole texts, in parts: maximal runs of Latin-1 letters with A-Z lower-cased, of ``least_length`` or
    more.  Where ``spoil`` divides the crc32 of "id:run", a letter of the run is deleted."""
    run = re.compile(f"[a-z\xc0-\xff]{{{least_length},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = defaultdict(int)

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for key, value in zip(batch.column(0), batch.column(1)):
                if not value.is_valid:
                    continue
                start = zlib.crc32(((key.as_py() or "") + ":").encode())
                # bytes.lower changes A-Z only
                for word, n in Counter(run.findall(value.as_py().encode().lower().decode())).items():
                    if spoil:
                        h = zlib.crc32(word.encode(), start)
                        if h % spoil == 0:
                            word = word[: (at := h % len(word))] + word[at + 1 :]
                            if len(word) < least_length:
                                continue
                    total[word] += n
                if len(total) >= COUNTED:
                    yield flushed()
        yield flushed()

    return docs.select(F.col(id).cast("string").alias("id"), F.col(text).alias("text")).mapInArrow(count, "word string, n long")


def letter_groups(words: DataFrame) -> dict[int, int]:
    """Code point -> group: every letter, from the most frequent on, joins the group with the fewest occurrences so far.
    Of the words' letters, at most 90, only their counts come to the driver."""
    counts = words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").groupBy("c").count().collect()
    weight, group = [0] * GROUPS, {}
    for c, n in sorted(((r["c"], r["count"]) for r in counts), key=lambda x: (-x[1], x[0])):
        group[ord(c)] = lightest = weight.index(min(weight))
        weight[lightest] += n
    return group


def paths_of(words: list[bytes], groups: dict[int, int]) -> np.ndarray:
    """The count of every group's letters, up to 255, for words in Latin-1 bytes; a row each."""
    table = np.full(256, GROUPS, np.int64)
    for c, g in groups.items():
        table[c] = g
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    at = np.repeat(np.arange(len(words)), lengths) * (GROUPS + 1) + table[np.frombuffer(b"".join(words), np.uint8)]
    counts = np.bincount(at, minlength=len(words) * (GROUPS + 1)).reshape(len(words), GROUPS + 1)[:, :GROUPS]
    return np.minimum(counts, 255).astype(np.uint8)


def with_paths(words: DataFrame, groups: dict[int, int]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = paths_of([w.encode("latin-1") for w in batch.column(0).to_pylist()], groups)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([p.tobytes() for p in paths], pa.binary())], names=["word", "n", "path"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, path binary")


class Crown:
    """The sections of a trie by their first and last paths, in order."""

    def __init__(self, bounds: list[tuple[int, bytes, bytes]]):
        self.number, self.first, self.last = zip(*sorted(bounds, key=lambda b: b[1:])) if bounds else ((), (), ())

    def reached(self, path: bytes) -> list[int]:
        """Sections with a path within one surplus and one deficit of ``path``, and perhaps some that only touch it."""
        found: set[int] = set()
        stack = [(b"", 0, len(self.number), 1, 1)]
        while stack:
            head, lo, hi, surplus, deficit = stack.pop()
            lo, hi = bisect_left(self.last, head, lo, hi), bisect_right(self.first, head + b"\xff" * (GROUPS - len(head)), lo, hi)
            if hi - lo <= 1 or len(head) == GROUPS:
                found.update(range(lo, hi))
                continue
            c = path[len(head)]
            stack.append((head + bytes((c,)), lo, hi, surplus, deficit))
            if surplus and c < 255:
                stack.append((head + bytes((c + 1,)), lo, hi, 0, deficit))
            if deficit and c:
                stack.append((head + bytes((c - 1,)), lo, hi, surplus, 0))
        return [self.number[i] for i in found]


def one_edit(a: bytes, b: bytes) -> bool:
    """True if the words differ by exactly one inserted, deleted or replaced letter."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    short, long = sorted((a, b), key=len)
    at = next((i for i, (x, y) in enumerate(zip(short, long)) if x != y), len(short))
    return short[at + (len(a) == len(b)) :] == long[at + 1 :]


class Words:
    """Words in Latin-1, sorted by path: letters in an array, distinct paths, and where the words of each begin."""

    def __init__(self, table: pa.Table):
        paths = np.frombuffer(b"".join(table.column("path").to_pylist()), np.uint8).reshape(len(table), GROUPS)
        order = np.lexsort(paths.T[::-1])
        self.words = [w.encode("latin-1") for w in table.column("word").to_pylist()]
        self.words, self.n = [self.words[i] for i in order], table.column("n").to_numpy()[order]
        self.length = np.fromiter(map(len, self.words), np.int64, len(self.words))
        self.letters = np.frombuffer(b"".join(w[:WIDTH].ljust(WIDTH + 1, b"\0") for w in self.words), np.uint8).reshape(len(self.words), WIDTH + 1)
        paths = paths[order]
        new = np.ones(len(paths), bool)
        new[1:] = (paths[1:] != paths[:-1]).any(axis=1)
        self.paths = paths[new].astype(np.int16)
        self.start = np.append(np.flatnonzero(new), len(paths))


def verified(q: Words, t: Words, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of pairs of words ``q[a]`` and ``t[b]``, which are one edit apart."""
    la, lb = q.length[a], t.length[b]
    x, y = q.letters[a], t.letters[b]
    good = (la == lb) & ((x != y).sum(axis=1) == 1)
    for longer, shorter, one in ((x, y, la == lb + 1), (y, x, lb == la + 1)):
        long, short = longer[one], shorter[one]
        head = np.cumprod(long == short, axis=1).astype(bool)  # the common beginning
        good[one] = (head[:, :-1] | (long[:, 1:] == short[:, :-1])).all(axis=1)
    for i in np.flatnonzero(np.maximum(la, lb) > WIDTH):
        good[i] = one_edit(q.words[a[i]], t.words[b[i]])
    return good


def candidates(q: Words, t: Words) -> Iterator[tuple[int, np.ndarray]]:
    """(path of ``t``, paths of ``q`` within the budget of it): a depth-first walk of the trie with all searching paths."""
    every = np.arange(len(q.paths))
    stack = [(0, len(t.paths), 0, every, np.ones(len(every), np.int16), np.ones(len(every), np.int16))]
    while stack:
        lo, hi, depth, who, surplus, deficit = stack.pop()
        if not len(who):
            continue
        if depth == GROUPS:
            yield lo, who
            continue
        if hi - lo == 1:  # one leaf below: the rest of its path at once
            more = t.paths[lo, depth:] - q.paths[who, depth:]
            keep = (np.maximum(more, 0).sum(axis=1) <= surplus) & (np.maximum(-more, 0).sum(axis=1) <= deficit)
            if keep.any():
                yield lo, who[keep]
            continue
        column, own = t.paths[lo:hi, depth], q.paths[who, depth]
        cuts = np.flatnonzero(column[1:] != column[:-1]) + 1
        for begin, end in zip([0, *cuts], [*cuts, hi - lo]):
            more = column[begin] - own
            up, down = surplus - np.maximum(more, 0), deficit - np.maximum(-more, 0)
            keep = (up >= 0) & (down >= 0)
            stack.append((lo + begin, lo + end, depth + 1, who[keep], up[keep], down[keep]))


def near_words(q: Words, t: Words) -> tuple[np.ndarray, list[tuple[int, bytes] | None]]:
    """For every word of ``q``: how many words of ``t`` are one edit away, and (n, word) of the most frequent of them."""
    n_near, best = np.zeros(len(q.words), np.int64), [None] * len(q.words)

    def settle(pairs: list[tuple[np.ndarray, np.ndarray]]) -> None:
        a, b = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
        good = verified(q, t, a, b)
        a, b = a[good], b[good]
        np.add.at(n_near, a, 1)
        for i, j, n in zip(a.tolist(), b.tolist(), t.n[b].tolist()):
            word, old = t.words[j], best[i]
            if old is None or n > old[0] or n == old[0] and word < old[1]:
                best[i] = (n, word)

    waiting, size = [], 0
    for leaf, who in candidates(q, t):
        targets = np.arange(t.start[leaf], t.start[leaf + 1])
        sizes = q.start[who + 1] - q.start[who]
        searching = np.repeat(q.start[who] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        step = max(1, PAIRS // len(targets))
        for at in range(0, len(searching), step):
            some = searching[at : at + step]
            waiting.append((np.repeat(some, len(targets)), np.tile(targets, len(some))))
            size += len(some) * len(targets)
            if size >= PAIRS:
                settle(waiting)
                waiting, size = [], 0
    if waiting:
        settle(waiting)
    return n_near, best


FOUND = "word string, n_near long, near_n long, near string"


def searched(q: pa.Table, t: pa.Table) -> pa.Table:
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("near_n", pa.int64()), ("near", pa.string())])
    if not len(q) or not len(t):
        return schema.empty_table()
    own = Words(q)
    n_near, best = near_words(own, Words(t))
    hit = np.flatnonzero(n_near)
    text = lambda words: [w.decode("latin-1") for w in words]
    return pa.table([pa.array(text(own.words[i] for i in hit), pa.string()), pa.array(n_near[hit]), pa.array([best[i][0] for i in hit], pa.int64()), pa.array(text(best[i][1] for i in hit), pa.string())], schema=schema)


def near_by_trie(words: DataFrame) -> DataFrame:
    """(word, n_near, near_n, near) of the words (word, n) that have a near one; ``words`` is a written table of distinct
    words in Latin-1."""
    total = words.count()
    sections = min(MOST_SECTIONS, total // SECTION_WORDS + 1)
    ordered = with_paths(words, letter_groups(words)).repartitionByRange(sections, "path", "word")
    placed = written(ordered.withColumn("section", F.spark_partition_id()), "trie")
    crown = Crown([tuple(r) for r in placed.groupBy("section").agg(F.min("path").alias("first"), F.max("path").alias("last")).select("section", "first", "last").collect()])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to = [crown.reached(p) for p in batch.column(2).to_pylist()]
            rows = np.repeat(np.arange(len(to)), np.fromiter(map(len, to), np.int64, len(to)))
            sent = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*sent.columns[:3], pa.array([s for x in to for s in x], pa.int32())], names=["word", "n", "path", "section"])

    searching = written(placed.select("word", "n", "path").mapInArrow(route, "word string, n long, path binary, section int"), "searching")
    # A section that many words reach is searched in several tasks, each with a share of them.
    blocks = searching.groupBy("section").agg((F.count("*") / SEARCHING).cast("int").alias("most"))
    left = searching.join(blocks, "section").withColumn("block", F.pmod(F.xxhash64("word"), F.col("most") + 1)).drop("most")
    right = placed.join(blocks, "section").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("most").cast("long")))).drop("most")
    found = left.groupBy("section", "block").cogroup(right.groupBy("section", "block")).applyInArrow(searched, FOUND)
    # The most frequent near word; of equal ones the first in code-point order.
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("best.less")).alias("near_n"), F.col("best.near").alias("near"))


def rooted(forms: DataFrame) -> DataFrame:
    """Adds ``root`` to (word, form, ...): where following forms ends.  A form is more frequent than its word by a factor, so
    that there are no circles, and every round doubles the length of the ways that are followed."""
    now = written(forms.withColumn("root", F.coalesce("form", "word")), "roots")
    while True:
        onward = now.where("root <> word").select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = written(now.join(onward, "root", "left").withColumn("moved", F.col("next").isNotNull()).withColumn("root", F.coalesce("next", "root")).drop("next"), "roots")
        if after.where("moved").isEmpty():
            return after.drop("moved")
        now = after.drop("moved")


def spelling_variants(docs: DataFrame, *, id: str, text: str, spoil: int | None = None, least_length: int = 6, least_n: int = 5, factor: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``least_length`` code points and ``least_n`` occurrences.

    ``n_near`` counts the words one edit away; ``form`` is the most frequent of them (ties: the first in code-point
    order) if it is at least ``factor`` times as frequent as the word, else null; ``root`` is where the forms end, the
    word itself if it has none.  With ``spoil`` typing errors are planted first, see ``counted_words``.

    Null and empty texts have no words, a null id counts as empty text, repeated rows count as often as they occur, other
    columns are ignored, and an empty table has no words.  A word of any length is compared whole.
    """
    parts = counted_words(docs, id=id, text=text, spoil=spoil, least_length=least_length)
    words = written(parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n), "words")
    near = near_by_trie(words)
    known = words.join(near, "word", "left")
    is_form = F.col("near_n") >= factor * F.col("n")
    forms = known.select("word", F.when(is_form, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("near_n")).alias("form_n"))
    return rooted(forms).select("word", "form", "root", "n", "n_near", "form_n")
