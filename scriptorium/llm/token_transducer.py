"""Token counts by a compiled finite-state tokenizer.

The tokenizer file is compiled into a cascade of two deterministic transducers.

* The *boundary transducer* reads classes of code points with one symbol of look-ahead and marks where each
  pre-token begins.  Every symbol is a map of states to states; the maps that can arise form a small monoid, whose
  multiplication table is compiled once.  Texts are cut into chunks, each chunk's map is the product of its symbols,
  and the maps of all chunks are composed by a parallel prefix scan, so that each chunk then knows the state it is
  entered in and all chunks emit their boundaries at the same time.
* The *word transducer* has one path-compressed transition for each pre-token, annotated with the number of tokens that
  the merge rules emit on it.  Transitions are compiled when first needed and kept within a bounded table.

A document's count is the sum over its transitions.  The count equals that of the library for byte-level BPE files.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from scriptorium.llm.common import blocks, extended, with_columns

LETTER, NUMBER, OTHER, SPACE, WHITE, APOSTROPHE = range(6)
# Input symbols of the boundary transducer, after one symbol of look-ahead.
S_LETTER, S_NUMBER, S_OTHER, S_SHORT, S_LONG, S_JOIN, S_WHITE_LAST, S_WHITE, S_END = range(9)
# States: a pre-token was closed; after a joining space; in letters, numbers, others, white space; in a contraction.
FREE, JOINED, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_WHITE, ONE_MORE, TWO_MORE = range(8)
N_STATES, N_SYMBOLS = 8, 9
CHUNK = 128
#: Transitions that a worker's word transducer holds before it starts anew.
MAX_TRANSITIONS = 400_000
NO_MERGE = 1 << 40
#: Longer pre-tokens are counted with a heap and not kept.
LONG_WORD = 64


@lru_cache(1)
def code_point_classes() -> np.ndarray:
    """The class of every code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    points = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    at = np.frombuffer(points.encode("utf-32-le"), np.uint32)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", WHITE)):
        for m in regex.finditer(pattern, points):
            table[at[m.start() : m.end()]] = kind
    table[0x20], table[0x27] = SPACE, APOSTROPHE
    return table


@lru_cache(1)
def boundary_transducer() -> tuple[np.ndarray, np.ndarray]:
    """Next state and emission (1: a pre-token begins here) by state and symbol."""
    to, emit = np.zeros((N_STATES, N_SYMBOLS), np.uint8), np.ones((N_STATES, N_SYMBOLS), np.uint8)
    begins = {S_LETTER: IN_LETTERS, S_NUMBER: IN_NUMBERS, S_OTHER: IN_OTHERS, S_SHORT: ONE_MORE, S_LONG: TWO_MORE, S_JOIN: JOINED, S_WHITE_LAST: FREE, S_WHITE: IN_WHITE, S_END: FREE}
    for symbol, state in begins.items():
        to[:, symbol] = state
    runs = {IN_LETTERS: (S_LETTER,), IN_NUMBERS: (S_NUMBER,), IN_OTHERS: (S_OTHER, S_SHORT, S_LONG), IN_WHITE: (S_WHITE,)}
    for state, symbols in runs.items():
        for symbol in symbols:
            to[state, symbol], emit[state, symbol] = state, 0
    for symbol in (S_LETTER, S_NUMBER, S_OTHER, S_SHORT, S_LONG):
        to[JOINED, symbol], emit[JOINED, symbol] = begins[symbol] if symbol < S_OTHER else IN_OTHERS, 0
    to[ONE_MORE, S_LETTER], emit[ONE_MORE, S_LETTER] = FREE, 0
    to[TWO_MORE, S_LETTER], emit[TWO_MORE, S_LETTER] = ONE_MORE, 0
    emit[:, S_END] = 0
    return to, emit


@lru_cache(1)
def state_map_monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Generators (element by symbol), multiplication table, and the maps themselves; element 0 is the identity."""
    to, _ = boundary_transducer()
    maps = [tuple(range(N_STATES))]
    index = {maps[0]: 0}
    for m in maps:
        for symbol in range(N_SYMBOLS):
            product = tuple(int(to[s, symbol]) for s in m)
            if product not in index:
                index[product] = len(maps)
                maps.append(product)
    table = np.array(maps, np.uint8)
    product = np.array([[index[tuple(table[b][table[a]].tolist())] for b in range(len(maps))] for a in range(len(maps))], np.uint16)
    generators = np.array([index[tuple(to[:, s].tolist())] for s in range(N_SYMBOLS)], np.uint16)
    return generators, product, table


def symbols_of(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Symbols of code points; ``ends`` marks the separators that stand after each text."""
    kind = code_point_classes()[points]
    kind[ends] = 255
    nxt = np.append(kind[1:], 255)
    white = (kind == SPACE) | (kind == WHITE)
    last = white & ~((nxt == SPACE) | (nxt == WHITE) | (nxt == 255))
    out = np.full(len(points), S_OTHER, np.uint8)
    out[kind == LETTER], out[kind == NUMBER], out[white], out[ends] = S_LETTER, S_NUMBER, S_WHITE, S_END
    out[last] = np.where(kind[last] == SPACE, S_JOIN, S_WHITE_LAST)
    marks = np.flatnonzero(kind == APOSTROPHE)
    if len(marks):
        padded = np.append(points, [0, 0])
        one, two = padded[marks + 1], padded[marks + 2]
        short = np.isin(one, [*map(ord, "stmd")])
        pairs = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        out[marks[short]], out[marks[pairs]] = S_SHORT, S_LONG
    return out


def pre_token_starts(symbols: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin: chunk maps, a prefix scan over them, then all chunks emit at once."""
    generators, product, maps = state_map_monoid()
    to, emit = boundary_transducer()
    chunks = -(-len(symbols) // CHUNK)
    grid = np.full(chunks * CHUNK, S_END, np.uint8)
    grid[: len(symbols)] = symbols
    grid = np.ascontiguousarray(grid.reshape(chunks, CHUNK).T)
    flat, n = product.ravel(), len(maps)
    element = np.zeros(chunks, np.intp)
    for column in grid:
        element = flat[element * n + generators[column]].astype(np.intp)
    step = 1
    while step < chunks:  # inclusive scan: element[i] becomes the product of all chunks up to i
        element[step:] = flat[element[:-step] * n + element[step:]]
        step *= 2
    state = np.zeros(chunks, np.intp)
    state[1:] = maps[element[:-1], FREE]
    out = np.empty_like(grid)
    to_flat, emit_flat = to.ravel().astype(np.intp), emit.ravel()
    for k, column in enumerate(grid):
        at = state * N_SYMBOLS + column
        out[k] = emit_flat[at]
        state = to_flat[at]
    return out.T.reshape(-1)[: len(symbols)].astype(bool)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable bytes stand for
    themselves, the others for the code points from 256 on, in order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class WordTransducer:
    """Tokens emitted for a pre-token, by the merge rules of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in file["model"]["merges"]]
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.letters = byte_letters()
        vocabulary = file["model"]["vocab"]
        self.base = max(vocabulary.values()) + 2
        self.byte_ids = np.array([vocabulary[c] for c in self.letters], np.int64)
        self.result = np.array([vocabulary[a + b] for a, b in merges], np.int64)
        keys = np.array([vocabulary[a] * self.base + vocabulary[b] for a, b in merges], np.int64)
        self.pair_order = np.argsort(keys, kind="stable")
        self.pair_keys = keys[self.pair_order]
        self.special = [t["content"] for t in file["added_tokens"]]
        self.counts: dict[bytes, int] = {}

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, NO_MERGE where no rule joins them."""
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (right >= 0), self.pair_order[at], NO_MERGE)

    def merged(self, words: list[bytes]) -> np.ndarray:
        """Number of pieces of words of similar length: in each step every word makes its first merge of lowest rank."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        width = int(size.max()) + 1
        column = np.arange(width)
        ids = np.full((len(words), width), -1, np.int64)
        ids[column < size[:, None]] = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        rank = np.full((len(words), width), NO_MERGE, np.int64)
        rank[:, :-1] = self.pair_ranks(ids[:, :-1], ids[:, 1:])
        out, at = size.copy(), np.arange(len(words))
        while len(at):
            j = rank.argmin(1)
            row = np.arange(len(at))
            best = rank[row, j]
            going = best < NO_MERGE
            if not going.all():
                at, ids, rank, j, best = at[going], ids[going], rank[going], j[going], best[going]
                row = np.arange(len(at))
                if not len(at):
                    break
            out[at] -= 1
            later = column[:-1] > j[:, None]
            for grid, pad in ((ids, -1), (rank, NO_MERGE)):
                grid[:, :-1][later] = grid[:, 1:][later]
                grid[:, -1] = pad
            ids[row, j] = self.result[best]
            rank[row, j] = self.pair_ranks(ids[row, j], ids[row, j + 1])
            inner = j > 0
            r, k = row[inner], j[inner]
            rank[r, k - 1] = self.pair_ranks(ids[r, k - 1], ids[r, k])
        return out

    def merged_long(self, word: bytes) -> int:
        """The same in n log n steps: a heap of pairs over a linked list."""
        parts = [self.letters[b] for b in word]
        n, rank = len(parts), self.rank
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(rank[p], i, p) for i, p in enumerate(zip(parts, parts[1:])) if p in rank]
        heapq.heapify(heap)
        left = n
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else -1
            if j < 0 or (parts[i], parts[j]) != pair:
                continue
            parts[i], parts[j], after[i] = pair[0] + pair[1], None, after[j]
            left -= 1
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (p := (parts[a], parts[b])) in rank:
                    heapq.heappush(heap, (rank[p], a, p))
        return left

    def emitted(self, words: list[bytes]) -> np.ndarray:
        if len(self.counts) > MAX_TRANSITIONS:
            self.counts.clear()
        counts = self.counts
        new = sorted((w for w in words if w not in counts and len(w) <= LONG_WORD), key=len)
        for most in (8, 12, 16, 24, 32, LONG_WORD):
            run = [w for w in new if len(w) <= most]
            new = new[len(run) :]
            if run:
                counts.update(zip(run, self.merged(run).tolist()))
        return np.fromiter((counts[w] if len(w) <= LONG_WORD else self.merged_long(w) for w in words), np.int64, len(words))


@lru_cache(2)
def word_transducer(path: str) -> WordTransducer:
    return WordTransducer(path)


def count_tokens(texts: list[str], path: str) -> np.ndarray:
    """Tokens of each text.  A special string inside a text counts as the one token that it is for the library."""
    words = word_transducer(path)
    pieces, owner, counts = [], [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        parts = [text]
        for special in words.special:
            if special in text:
                parts = [p for part in parts for p in part.split(special)]
        counts[i] = len(parts) - 1
        pieces += parts
        owner += [i] * len(parts)
    points = np.frombuffer("\0".join([*pieces, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    ends = np.cumsum(lengths + 1) - 1
    starts = np.flatnonzero(pre_token_starts(symbols_of(points, ends)))
    if not len(starts):
        return counts
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    width[ends] = 0
    offset = np.append(0, np.cumsum(width))
    data = "".join(pieces).encode("utf-8")
    words_at = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(offset[starts], offset[-1]).astype(np.int64)), pa.py_buffer(data)])
    coded = words_at.dictionary_encode()
    emitted = words.emitted(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
    np.add.at(counts, np.array(owner)[np.searchsorted(ends, starts)], emitted)
    return counts


def annotate_token_counts(docs: DataFrame, *, text: str, tokenizer: str, limit: int = 512) -> DataFrame:
    """Add ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) to every row.

    ``tokenizer`` is the path of a byte-level BPE file on every worker.  A null or empty text has no bytes and no
    tokens; repeated rows are counted like any other; an empty table gives an empty one.  Existing columns of the new
    names are replaced.  No shuffle: one narrow pass, in blocks of bounded size; a long text is never cut.
    """
    new = ("n_bytes", "n_tokens", "over_limit")
    keep = [c for c in docs.columns if c not in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            n_bytes = np.fromiter((len(t.encode("utf-8")) for t in texts), np.int64, len(texts))
            n_tokens = np.zeros(len(texts), np.int64)
            for start, block in blocks(texts, 1_000_000):
                n_tokens[start : start + len(block)] = count_tokens(block, tokenizer)
            yield with_columns(batch, keep, n_bytes=n_bytes, n_tokens=n_tokens, over_limit=n_tokens > limit)

    kept = docs.select(*keep)
    return kept.mapInArrow(run, extended(kept.schema, "n_bytes long, n_tokens long, over_limit boolean"))
