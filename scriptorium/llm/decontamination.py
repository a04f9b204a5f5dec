"""Benchmark decontamination with SimHash windows and a multi-index over Hamming blocks.

Every benchmark item has a SimHash over its word shingles.  Documents are read in windows of an item's size; a window's
SimHash comes from running sums of the bits of its shingles.  The fingerprint is cut into four blocks, of which a
distance within ``RADIUS`` leaves one with ``BLOCK_RADIUS`` bits at most; an item that no block brings within that is not
within the radius.  Blocks of 32 bits let through about a hundredth of unrelated items each.  Candidates are verified
by the weighted similarity of the full shingle multisets.

A window and an item as similar as asked for share so many shingles that windows with fewer shingles of any item at all
are not fingerprinted.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import extended, with_columns
from scriptorium.llm.near_duplicates import PRIME, U64, WIDTH, mixed

#: At a similarity of 0.8 the expected distance is 19.4 bits; the radius lies 4.6 standard deviations above.
BITS, RADIUS = 128, 38
BLOCKS = 4
BLOCK_RADIUS = RADIUS // BLOCKS
#: Benchmark text indexed, and broadcast, at once; a larger benchmark takes several passes over the documents.
INDEX_BYTES = 8 << 20
#: Bytes of text whose words are held at once, and windows that are fingerprinted at once.
SLICE_BYTES, WINDOWS = 1 << 20, 4096
WHITE = re.compile(rb"[ \t-\r]")


def shingle_sequence(text: str | None) -> np.ndarray:
    """Hashes of all word shingles in order, repeated ones too; a shorter text is one shingle.  A long text's words are
    hashed slice by slice, so that eight bytes a word are all that is held of it."""
    data, parts, at = (text or "").encode("utf-8", "replace").lower(), [], 0
    while at < len(data):
        cut = WHITE.search(data, at + SLICE_BYTES) if len(data) - at > SLICE_BYTES else None
        end = cut.start() if cut else len(data)
        words = data[at:end].split()
        parts.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), U64, len(words)))
        at = end
    h = np.concatenate([*parts, np.empty(0, U64)])
    if not len(h):
        return h
    n = min(WIDTH, len(h))
    total = np.full(len(h) - n + 1, n, U64)
    for i in range(n):
        total = total * PRIME + h[i : i + len(total)]
    return mixed(total)


def window_fingerprints(sequence: np.ndarray, size: int) -> np.ndarray:
    """SimHash, as two words, of every run of ``size`` shingles, from running sums of their bits."""
    words = np.stack([sequence, mixed(sequence ^ PRIME)], axis=1)
    bits = np.unpackbits(words.view(np.uint8).reshape(len(sequence), BITS // 8), axis=1, bitorder="little")
    sums = np.zeros((len(bits) + 1, BITS), np.int32)
    np.cumsum(bits, axis=0, out=sums[1:])
    ones = sums[size:] - sums[:-size]
    return np.packbits(2 * ones > size, axis=1, bitorder="little").view(U64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard: shared weight by the weight of both, a shingle weighing as often as it occurs."""
    left, right = Counter(a.tolist()), Counter(b.tolist())
    shared = (left & right).total()
    return shared / (left.total() + right.total() - shared)


class ItemIndex:
    """Fingerprints of the items by size, in blocks, and the set of their shingles."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.ids = np.array([i for i, _ in items], np.int64)
        self.sequences = [s for _, s in items]
        sizes = np.array([len(s) for s in self.sequences], np.int64)
        self.by_size = {int(n): np.flatnonzero(sizes == n) for n in np.unique(sizes)}
        prints = [window_fingerprints(s, len(s))[0] for s in self.sequences]
        self.blocks = np.array(prints, U64).reshape(-1, 2).view(np.uint32)
        self.shingles = np.unique(np.concatenate([*self.sequences, np.empty(0, U64)]))

    def candidates(self, prints: np.ndarray, items: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(window, item, distance) of all pairs within the radius, for the given items.

        Items that some block brings near are told first; only these are compared whole."""
        windows = np.ascontiguousarray(prints).view(np.uint32)
        for at in range(0, len(items), 256):
            own = items[at : at + 256]
            near = np.zeros((len(windows), len(own)), bool)
            for k in range(BLOCKS):
                near |= np.bitwise_count(windows[:, k, None] ^ self.blocks[own, k][None, :]) <= BLOCK_RADIUS
            w, i = np.nonzero(near)
            distance = np.bitwise_count(windows[w] ^ self.blocks[own[i]]).sum(1)
            within = distance <= RADIUS
            yield from zip(w[within].tolist(), own[i[within]].tolist(), distance[within].tolist())

    def matches(self, text: str | None, least: float) -> list[tuple[int, float, int, int, int]]:
        """(item, similarity, first word of the window, its shingles, Hamming distance): the best window of every item
        that reaches ``least``, the first of equal ones."""
        own = shingle_sequence(text)
        if not len(own) or not len(self.shingles):
            return []
        known = np.zeros(len(own) + 1, np.int64)
        for at in range(0, len(own), 1 << 18):
            part = own[at : at + (1 << 18)]
            known[at + 1 : at + 1 + len(part)] = self.shingles[np.minimum(np.searchsorted(self.shingles, part), len(self.shingles) - 1)] == part
        np.cumsum(known, out=known)
        if not known[-1]:
            return []
        best: dict[int, tuple[float, int, int, int]] = {}
        for size, items in self.by_size.items():
            span = min(size, len(own))
            # shared >= least * (size + span - shared)
            need = max(1, math.ceil(least * (size + span) / (1 + least) - 1e-9))
            if need > min(span, known[-1]):
                continue
            starts = np.flatnonzero(known[span:] - known[:-span] >= need)
            for run in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1) if len(starts) else ():
                for first in range(int(run[0]), int(run[-1]) + 1, WINDOWS):
                    last = min(first + WINDOWS - 1, int(run[-1]))
                    prints = window_fingerprints(own[first : last + span], span)
                    for w, item, far in sorted(self.candidates(prints, items), key=lambda c: (c[2], c[0])):
                        start = first + w
                        if item in best and (best[item][0] == 1 and best[item][1] <= start):
                            continue
                        score = similarity(own[start : start + span], self.sequences[item])
                        if score >= least and (item not in best or (score, -start) > (best[item][0], -best[item][1])):
                            best[item] = (score, start, span, far)
        return [(int(self.ids[i]), *best[i]) for i in sorted(best)]


def indexes(benchmark: DataFrame, *, item_id: str, item_text: str) -> Iterator:
    """Broadcast indexes over all items with an id and a text, in blocks of at most ``INDEX_BYTES``."""
    items = benchmark.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t"))
    passes = max(1, math.ceil((items.agg(F.sum(F.octet_length("t"))).first()[0] or 0) / (INDEX_BYTES // 2)))
    for block in range(passes):
        own = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(passes)) == block).orderBy("i").collect()
        yield benchmark.sparkSession.sparkContext.broadcast(ItemIndex([(r["i"], s) for r in own if len(s := shingle_sequence(r["t"]))]))


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, text: str, item_id: str, item_text: str, least: float = 0.8) -> DataFrame:
    """The rows of ``docs`` (without the text) with every benchmark item found in them: ``item_id``, ``similarity``,
    ``first_word``, ``n_shingles``, ``distance``.

    Null and empty texts and items, and items without an id, match nothing; repeated rows are answered each; the best
    window of an item counts, the first of equal ones.  Existing columns of the new names are replaced.  An empty table
    on either side gives an empty result.

    The documents are not shuffled.  The benchmark is indexed in blocks of at most ``INDEX_BYTES`` of text, each a
    broadcast of proven size; there is one pass over the documents for each block.
    """
    new = "item_id long, similarity double, first_word long, n_shingles long, distance int"
    keep = [c for c in docs.columns if c != text and c not in [f.split(" ")[0] for f in new.split(", ")]]
    source = docs.select(*keep, text)
    schema = extended(docs.select(*keep).schema, new)
    found = [source.mapInArrow(leak_scan(index, text, keep, least), schema) for index in indexes(benchmark, item_id=item_id, item_text=item_text)]
    return reduce(DataFrame.union, found)


def leak_scan(index, text: str, keep: list[str], least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            for i, value in enumerate(batch.column(batch.schema.get_field_index(text)).to_pylist()):
                found = index.value.matches(value, least)
                rows += [i] * len(found)
                out += found
            columns = list(zip(*out)) or [()] * 5
            kinds = (pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int32())
            names = ("item_id", "similarity", "first_word", "n_shingles", "distance")
            yield with_columns(batch.take(pa.array(rows, pa.int64())), keep, **{n: pa.array(c, k) for n, c, k in zip(names, columns, kinds)})

    return run


def drop_leaks(docs: DataFrame, benchmark: DataFrame, *, text: str, item_id: str, item_text: str, least: float = 0.8) -> DataFrame:
    """The rows of ``docs`` in whose text no benchmark item is found, with all their columns; a row is judged by its own
    text, whatever its id.  Narrow passes, without a shuffle."""
    column = docs.columns.index(text)
    for index in indexes(benchmark, item_id=item_id, item_text=item_text):
        docs = docs.mapInArrow(clean_scan(index, column, least), docs.schema)
    return docs


def clean_scan(index, column: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not index.value.matches(t, least) for t in batch.column(column).to_pylist()], pa.bool_()))

    return run
