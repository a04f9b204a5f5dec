"""A gated recurrent language model in numpy, with a class-factored output and an exact tail.

The most frequent words have symbols of their own; every other word shares a symbol with the words of its tail bucket
(a hash of its last letters), within which it is drawn in proportion to its count in the training corpus.  Symbols are
dealt to classes by frequency, and the output is the class's probability times the symbol's within the class.

Counts cover all training documents.  The network is trained in two rounds of truncated back-propagation, the first over
a sixteenth of the training documents, the second over all of them; in each, tasks train copies of their own, which are
averaged by their tokens.  Documents are scored whole: the state is carried from window to window until the end.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scriptorium.llm.common import BOX, boxed, extended, in_share, unboxed, with_columns, written

CLASSES, MEMBERS = 32, 32
SYMBOLS = CLASSES * MEMBERS
TAILS = 64
EMBED, HIDDEN = 12, 16
#: Words between ASCII white space are never empty, so that the empty word can stand for the end.
END = b""
#: Words whose counts are broadcast; those of all others are joined.
LEXICON = 250_000
#: Distinct words that a task counts before it passes them on.
FLUSH = 400_000
#: Model copies that are trained side by side at most.
COPIES = 4096
#: Share of the training documents in the first round, and the documents it has at least, if there are so many.
FIRST_SHARE, FIRST_LEAST = 1 / 16, 1500
#: Tokens that a copy lays out in streams at once, whatever batches they come in.
UNIT = 1 << 21
STREAMS, STEPS, WINDOW = (64, 512), 16, 32
#: Updates that a unit makes at least, if its tokens allow it with the fewest streams.
UPDATES = 200
SLICE = 512
#: How a symbol is stored.
SYMBOL = np.uint16


def words_of(text: str | None) -> list[bytes]:
    """Lower-case (A-Z) words between ASCII white space."""
    return (text or "").encode("utf-8", "replace").lower().split()


def tail_bucket(word: bytes) -> int:
    return int.from_bytes(word[-3:], "big") * 2654435761 % (1 << 32) * TAILS >> 32


def count_words(docs: DataFrame, text: str) -> DataFrame:
    """(word, tail, c) over all rows, the end of each text counted under the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            words = list(seen)
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in words], pa.string()), pa.array([tail_bucket(w) for w in words], pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["word", "tail", "c"])

        for batch in batches:
            for value in batch.column(0).to_pylist():
                seen.update(words_of(value))
                seen[END] += 1
                if len(seen) > FLUSH:
                    yield out()
                    seen.clear()
        yield out()

    return docs.select(text).mapInArrow(run, "word string, tail int, c long").groupBy("word", "tail").agg(F.sum("c").alias("c"))


@dataclass
class Lexicon:
    """Counts and symbols of the frequent words; the masses of the tail buckets."""

    words: dict[bytes, int]
    count: np.ndarray
    symbol: np.ndarray
    tail_log: np.ndarray  # log10 of a word's share of its tail bucket, 0 for words with a symbol of their own
    tail_symbol: np.ndarray
    tail_mass: np.ndarray  # N + 0.5 (V + 1) of each bucket
    end: int
    tokens: int
    types: int

    @property
    def base_mass(self) -> float:
        return self.tokens + 0.5 * (self.types + 1)


def build_lexicon(counts: DataFrame) -> Lexicon:
    """What reaches the driver: ``LEXICON`` words and ``TAILS`` sums."""
    sums = counts.groupBy("tail").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    # Words by frequency band: the lexicon takes whole bands from the top as long as they fit.
    band = F.floor(F.log2("c") * 16).cast("int")
    taken, least = 0, 1 << 30
    for r in counts.groupBy(band.alias("band")).agg(F.count("*").alias("n")).orderBy(F.desc("band")).collect():
        taken += r["n"]
        if taken > LEXICON:
            break
        least = r["band"]
    top = sorted(counts.where(band >= least).select("word", "c").collect(), key=lambda r: (-r["c"], r["word"]))
    n, v = np.zeros(TAILS), np.zeros(TAILS)
    for r in sums:
        n[r["tail"]], v[r["tail"]] = r["n"], r["v"]
    tokens, types = int(n.sum()), int(v.sum())
    words, count = [r["word"].encode() for r in top], np.array([r["c"] for r in top], np.int64)
    if END not in words:
        words, count = [END, *words], np.append(0, count)
    own = SYMBOLS - TAILS
    at_end = words.index(END)
    head = np.zeros(len(words), bool)
    head[: own - 1], head[at_end] = True, True
    tail = np.array([tail_bucket(w) for w in words])
    for k in np.flatnonzero(head).tolist():
        n[tail[k]] -= count[k]
        v[tail[k]] -= count[k] > 0
    # Symbols in order of frequency, tails among them.
    heads = np.flatnonzero(head)
    order = np.argsort(-np.concatenate([count[heads].astype(float), n]), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    tail_symbol, mass = rank[len(heads) :], n + 0.5 * (v + 1)
    symbol = tail_symbol[tail]
    symbol[heads] = rank[: len(heads)]
    tail_log = np.where(head, 0.0, np.log10((count + 0.5) / mass[tail]))
    return Lexicon({w: i for i, w in enumerate(words)}, count, symbol, tail_log, tail_symbol, mass, at_end, tokens, types)


def sigmoid(x: np.ndarray) -> np.ndarray:
    """In the place of ``x``; the exponential is the fastest way there, and its argument is kept from overflowing."""
    np.negative(x, out=x)
    np.minimum(x, 80, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def softmax_logs(x: np.ndarray, pick: np.ndarray, bound: float, scale: float | None) -> np.ndarray:
    """Log softmax of each row at ``pick``; with ``scale``, ``x`` becomes the gradient of the negative sum, scaled.  Rows
    whose values are within a proven bound need no shift against overflow."""
    if bound > 60:
        x -= x.max(1, keepdims=True)
    row = np.arange(len(x))
    out = x[row, pick]
    np.exp(x, out=x)
    total = x @ np.ones(x.shape[1], np.float32)
    if scale is not None:
        x *= (np.float32(scale) / total)[:, None]
        x[row, pick] -= np.float32(scale)
    return out - np.log(total)


class GRU:
    """Gates z, r and candidate n of a state h: h' = (1 - z) n + z h, n = tanh(x_n + r (h U_n))."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None, seed: int = 3):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[-2]), shape).astype(np.float32)
        self.w = weights or {
            "embed": rng.normal(0, 0.3, (SYMBOLS, EMBED)).astype(np.float32), "x": draw(EMBED, 3 * HIDDEN), "b": np.zeros(3 * HIDDEN, np.float32), "u": draw(HIDDEN, 3 * HIDDEN),
            "class": draw(HIDDEN, CLASSES), "class_b": np.zeros(CLASSES, np.float32), "member": draw(CLASSES, HIDDEN, MEMBERS), "member_b": np.zeros((CLASSES, MEMBERS), np.float32),
        }

    def step(self, gates: np.ndarray, h: np.ndarray):
        hu = h @ self.w["u"]
        zr = sigmoid(gates[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
        z, r, hn = zr[:, :HIDDEN], zr[:, HIDDEN:], hu[:, 2 * HIDDEN :]
        n = 2 * sigmoid(2 * (gates[:, 2 * HIDDEN :] + r * hn)) - 1  # tanh
        return n + z * (h - n), (z, r, hn, n)

    def log_probabilities(self, h: np.ndarray, symbols: np.ndarray, grad: dict | None = None):
        """Natural log probability of each symbol after each state; with ``grad`` also adds the gradients of the
        negative mean, and returns that of the states."""
        order = np.argsort(symbols.astype(np.int16), kind="stable")  # so that a class's rows are a slice
        h, cls, member = h[order], symbols[order] // MEMBERS, symbols[order] % MEMBERS
        edges = np.searchsorted(cls, np.arange(CLASSES + 1)).tolist()
        bound = lambda w, b: float((np.abs(w).sum(-2) + np.abs(b)).max())  # noqa: E731  states are within -1 and 1
        scale = None if grad is None else 1 / max(1, len(h))
        by_class = h @ self.w["class"]
        by_class += self.w["class_b"]
        logs = softmax_logs(by_class, cls, bound(self.w["class"], self.w["class_b"]), scale)
        inner = np.empty((len(h), MEMBERS), np.float32)
        slices = [(c, slice(edges[c], edges[c + 1])) for c in range(CLASSES) if edges[c] < edges[c + 1]]
        for c, own in slices:
            np.matmul(h[own], self.w["member"][c], out=inner[own])
            inner[own] += self.w["member_b"][c]
        logs += softmax_logs(inner, member, bound(self.w["member"], self.w["member_b"]), scale)
        out = np.empty(len(h))
        out[order] = logs
        if grad is None:
            return out, None
        grad["class"] += h.T @ by_class
        grad["class_b"] += by_class.sum(0)
        d_h = by_class @ self.w["class"].T
        for c, own in slices:
            grad["member"][c] += h[own].T @ inner[own]
            grad["member_b"][c] += inner[own].sum(0)
            d_h[own] += inner[own] @ self.w["member"][c].T
        back = np.empty_like(d_h)
        back[order] = d_h
        return out, back

    def truncated(self, given: np.ndarray, target: np.ndarray, h: np.ndarray, end: int):
        """Gradients of the mean loss over one window, and the state after it.  The end of a text clears the state."""
        gates = (self.w["embed"] @ self.w["x"] + self.w["b"])[given]
        fresh = (given != end).astype(np.float32)[:, :, None]
        before, states, z, r, hn, n = (np.empty((*given.shape, HIDDEN), np.float32) for _ in range(6))
        for t in range(len(given)):
            np.multiply(h, fresh[t], out=before[t])
            h, (z[t], r[t], hn[t], n[t]) = self.step(gates[t], before[t])
            states[t] = h
        grad = {k: np.zeros_like(v) for k, v in self.w.items()}
        _, d_out = self.log_probabilities(states.reshape(-1, HIDDEN), target.ravel(), grad)
        d_out = d_out.reshape(states.shape)
        # What the loop over steps needs of each step, for the whole window at once.
        to_n, to_z, to_r = (1 - z) * (1 - n * n), (before - n) * z * (1 - z), hn * r * (1 - r)
        d_gates, d_hu, d_next, back = np.empty_like(gates), np.empty_like(gates), np.zeros_like(h), self.w["u"].T.copy()
        for t in range(len(given) - 1, -1, -1):
            d, own = d_out[t] + d_next, d_hu[t]
            d_n = d * to_n[t]
            np.multiply(d, to_z[t], out=own[:, :HIDDEN])
            np.multiply(d_n, to_r[t], out=own[:, HIDDEN : 2 * HIDDEN])
            np.multiply(d_n, r[t], out=own[:, 2 * HIDDEN :])
            d_gates[t, :, 2 * HIDDEN :] = d_n
            d *= z[t]
            d += own @ back
            d_next = d * fresh[t]
        d_gates[:, :, : 2 * HIDDEN] = d_hu[:, :, : 2 * HIDDEN]
        grad["u"] += before.reshape(-1, HIDDEN).T @ d_hu.reshape(-1, 3 * HIDDEN)
        flat = d_gates.reshape(-1, 3 * HIDDEN)
        order = np.argsort(given.astype(np.int16), axis=None, kind="stable")
        inputs, starts = np.unique(given.ravel()[order], return_index=True)
        d_table = np.zeros((SYMBOLS, 3 * HIDDEN), np.float32)
        d_table[inputs] = np.add.reduceat(flat[order], starts)
        grad["embed"] += d_table @ self.w["x"].T
        grad["x"] += self.w["embed"].T @ d_table
        grad["b"] += d_table.sum(0)
        return grad, h

    def score(self, texts: list[np.ndarray], end: int) -> np.ndarray:
        """Natural log probability of each whole symbol sequence.

        Sequences stand one after the other in streams of about equal length, longer ones in streams of their own; the
        state is carried through a stream from window to window, and the end of a text clears it."""
        out = np.zeros(len(texts))
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        if not size.sum():
            return out
        table = self.w["embed"] @ self.w["x"] + self.w["b"]
        share = max(1, int(size.sum()) // STREAMS[1])
        alone, short = np.flatnonzero(2 * size > share), np.flatnonzero(2 * size <= share)
        begins = np.cumsum(size[short]) - size[short]
        order = np.concatenate([alone, short])
        stream = np.concatenate([np.arange(len(alone)), len(alone) + begins // share])
        flat = np.concatenate([texts[i] for i in order.tolist()])
        whose = np.repeat(order, size[order])
        before = np.append(end, flat[:-1])
        before[np.cumsum(size[order])[:-1][size[order][1:] > 0]] = end
        names, at = np.unique(stream, return_index=True)
        starts = (np.cumsum(size[order]) - size[order])[at]
        length = np.diff(np.append(starts, len(flat)))
        longest = np.argsort(-length, kind="stable")
        starts, length = starts[longest], length[longest]
        h = np.zeros((len(starts), HIDDEN), np.float32)
        for at in range(0, int(length[0]), WINDOW):
            active = int((length > at).sum())
            steps = np.arange(at, min(at + WINDOW, int(length[0])))[:, None]
            places = np.minimum(starts[:active] + steps, len(flat) - 1)
            given, h, states = before[places], h[:active], np.empty((*places.shape, HIDDEN), np.float32)
            fresh, gates = (given != end).astype(np.float32)[:, :, None], table[given]
            for t in range(len(steps)):
                h, _ = self.step(gates[t], h * fresh[t])
                states[t] = h
            real = steps < length[:active]
            own = places[real]
            out += np.bincount(whose[own], self.log_probabilities(states[real], flat[own])[0], len(texts))
        return out


class Trainer:
    """Truncated back-propagation over parallel streams of whole documents, Adam, gradients clipped.

    Documents are laid out when a unit of tokens is full, so that training does not depend on the batches that they come
    in; the optimiser goes on from unit to unit."""

    def __init__(self, model: GRU, end: int, rate: float):
        self.model, self.end, self.rate = model, end, rate
        self.first, self.second = ({k: np.zeros_like(v) for k, v in model.w.items()} for _ in range(2))
        self.updates, self.tokens, self.held, self.size = 0, 0, [], 0

    def add(self, symbols: np.ndarray) -> None:
        self.held.append(symbols)
        self.size += len(symbols)
        if self.size >= UNIT:
            self.flush()

    def flush(self) -> None:
        if self.size >= 2:
            self.unit(np.concatenate(self.held))
        self.tokens += self.size
        self.held, self.size = [], 0

    def unit(self, symbols: np.ndarray) -> None:
        streams = max(1, min(max(STREAMS[0], min(STREAMS[1], len(symbols) // (STEPS * UPDATES))), len(symbols) // (2 * STEPS)))
        length = -(-len(symbols) // streams)
        grid = np.full(streams * length, self.end, np.int64)
        grid[: len(symbols)] = symbols
        target = grid.reshape(streams, length).T
        given = np.full_like(target, self.end)
        given[1:] = target[:-1]
        h, w = np.zeros((streams, HIDDEN), np.float32), self.model.w
        for at in range(0, length, STEPS):
            self.updates += 1
            n = self.updates
            grad, h = self.model.truncated(given[at : at + STEPS], target[at : at + STEPS], h, self.end)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            speed = self.rate * min(1.0, n / 10) / (1 + n / 200)
            for k, g in grad.items():
                g *= min(1.0, 1.0 / (norm + 1e-9))
                self.first[k] += 0.1 * (g - self.first[k])
                self.second[k] += 0.005 * (g * g - self.second[k])
                w[k] -= speed * self.first[k] / (1 - 0.9**n) / (np.sqrt(self.second[k] / (1 - 0.995**n)) + 1e-8)


def symbols_of(words: list[bytes], lex: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Entries of the lexicon (-1: none) and symbols of a text's words and its end."""
    at = np.fromiter(map(lex.words.get, words, repeat(-1)), np.int64, len(words))
    symbol = lex.symbol[at]
    missing = np.flatnonzero(at < 0)
    if len(missing):
        symbol[missing] = lex.tail_symbol[[tail_bucket(words[i]) for i in missing.tolist()]]
    return np.append(at, lex.end), np.append(symbol, lex.symbol[lex.end])


def train_round(coded: DataFrame, start: GRU, *, end: int, rate: float, copies: int) -> GRU:
    """The average, by tokens, of the copies that at most ``copies`` tasks train on all rows (symbols)."""
    names = list(start.w)
    weights = coded.sparkSession.sparkContext.broadcast(start.w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Trainer(GRU({k: v.copy() for k, v in weights.value.items()}), end, rate)
        for batch in batches:
            for value in batch.column(0):
                own.add(np.frombuffer(value.as_buffer(), SYMBOL).astype(np.int64))
        own.flush()
        if own.tokens:
            flat = np.concatenate([own.model.w[k].ravel() for k in names]).astype(np.float64) * own.tokens
            flat = np.append(flat, np.zeros(-len(flat) % SLICE)).reshape(-1, SLICE)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array([own.tokens] * len(flat), pa.int64()), pa.array(flat.tolist(), pa.list_(pa.float64()))], names=["i", "tokens", "v"])

    trained = coded.coalesce(copies).mapInArrow(run, "i int, tokens long, v array<double>")
    rows = trained.groupBy("i").agg(F.sum("tokens").alias("tokens"), F.array(*[F.sum(F.col("v")[j]) for j in range(SLICE)]).alias("v")).orderBy("i").collect()
    if not rows:
        return start
    flat, at, averaged = np.concatenate([np.array(r["v"]) / r["tokens"] for r in rows]), 0, {}
    for k in names:
        n = start.w[k].size
        averaged[k] = flat[at : at + n].reshape(start.w[k].shape).astype(np.float32)
        at += n
    return GRU(averaged)


def train(coded: DataFrame, lex: Lexicon) -> GRU:
    """Two rounds: over a share of all documents, by the hash of their ids, with a copy for each unit of its tokens, and
    over all documents with a copy for each partition.  Both grow with the corpus."""
    few, end = max(1, min(COPIES, round(lex.tokens * first_share(lex) / UNIT))), int(lex.symbol[lex.end])
    model = train_round(coded.where("first").select("symbols"), GRU(), end=end, rate=0.01, copies=few)
    return train_round(coded.where("learn").select("symbols"), model, end=end, rate=0.002, copies=COPIES)


def first_share(lex: Lexicon) -> float:
    return min(1.0, max(FIRST_SHARE, FIRST_LEAST / max(1, int(lex.count[lex.end]))))


CODED = "learn boolean, first boolean, part long, row long, n long, known long, base double, tail double, symbols binary, rare array<struct<word:string,tail:int,n:bigint>>"


def coded_texts(boxes: DataFrame, lexicon) -> DataFrame:
    """The boxed rows (caller, text, learn, first) with their text as symbols, and what its score has besides the model's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, part, row = lexicon.value, TaskContext.get().partitionId(), 0
        seen_log = np.log10((lex.count + 0.5) / lex.base_mass)
        for batch in batches:
            told, symbols, rare_words, rare_counts, offsets = [], [], [], [], [0]
            for value in batch.column(1).to_pylist():
                words = words_of(value)
                at, symbol = symbols_of(words, lex)
                symbols.append(symbol.astype(SYMBOL).tobytes())
                own = at[at >= 0]
                rare = Counter([words[i] for i in np.flatnonzero(at < 0).tolist()])
                rare_words += rare
                rare_counts += rare.values()
                offsets.append(len(rare_words))
                told.append((len(at), int((lex.count[own] > 0).sum()), float(seen_log[own].sum()), float(lex.tail_log[own].sum())))
            parts = [pa.array(rare_words, pa.binary()).cast(pa.string()), pa.array(list(map(tail_bucket, rare_words)), pa.int32()), pa.array(rare_counts, pa.int64())]
            rare = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(parts, names=["word", "tail", "n"]))
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
            n, known, base, tail = (pa.array(c, kind) for c, kind in zip(zip(*told) if told else ((),) * 4, kinds))
            yield with_columns(batch, [BOX, "learn", "first"], part=pa.array([part] * len(batch), pa.int64()), row=pa.array(range(row, row + len(batch)), pa.int64()), n=n, known=known, base=base, tail=tail, symbols=pa.array(symbols, pa.binary()), rare=rare)
            row += len(batch)

    return boxes.mapInArrow(run, extended(StructType([boxes.schema[BOX]]), CODED))


def language_model_scores(docs: DataFrame, *, id: str, text: str, where: Column) -> DataFrame:
    """Learn from the rows of ``where`` and score every row.

    Adds ``n_tokens`` (words and the end), ``n_known`` (those that occur in training), ``train_tokens``, ``base_score``
    (the smoothed unigram log10 probability) and ``score`` (the model's log10 probability of the whole text).  A null or
    empty text is its end alone; repeated rows are scored alike; without any training row every word is unseen.
    Existing columns of the new names are replaced, all others are kept whatever their names; an empty table gives an
    empty one.
    """
    spark = docs.sparkSession
    new = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    keep = [c for c in docs.columns if c != text and c not in new]
    learn = F.coalesce(where, F.lit(False))
    counts = written(count_words(docs.where(learn).select(F.col(text).alias("text")), "text"), "word-counts")
    lex = build_lexicon(counts)
    first = learn & in_share(F.col(id), first_share(lex))
    boxes = boxed(docs, keep, text=F.col(text), learn=learn, first=first)
    # Texts are read as symbols once, for training and for scores.
    coded = written(coded_texts(boxes, spark.sparkContext.broadcast(lex)), "coded")
    model, end = spark.sparkContext.broadcast(train(coded, lex).w), int(lex.symbol[lex.end])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gru = GRU(model.value)
        for batch in batches:
            symbols = [np.frombuffer(value.as_buffer(), SYMBOL).astype(np.int64) for value in batch.column(batch.num_columns - 1)]
            score = gru.score(symbols, end) / np.log(10) + batch.column(batch.num_columns - 2).to_numpy()
            yield with_columns(batch, given, score=pa.array(score))

    given = [BOX, "part", "row", "n", "known", "base", "rare"]
    scored = written(coded.select(*given, "tail", "symbols").mapInArrow(run, extended(coded.select(*given).schema, "score double")), "scored")
    rare = scored.select("part", "row", F.explode("rare").alias("r")).select("part", "row", "r.*")
    c = F.coalesce("c", F.lit(0)) + 0.5
    mass = F.element_at(F.array(*[F.lit(float(m)) for m in lex.tail_mass]), F.col("tail") + 1)
    added = rare.join(counts.select("word", "c"), "word", "left").groupBy("part", "row").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("k"), F.sum(F.col("n") * F.log10(c / lex.base_mass)).alias("b"), F.sum(F.col("n") * F.log10(c / mass)).alias("s")
    )
    out = scored.drop("rare").join(added, ["part", "row"], "left")
    zero = lambda name: F.coalesce(name, F.lit(0))
    return out.select(*unboxed(keep, boxes.schema), F.col("n").alias("n_tokens"), (F.col("known") + zero("k")).alias("n_known"), F.lit(lex.tokens).cast("long").alias("train_tokens"), (F.col("base") + zero("b")).alias("base_score"), (F.col("score") + zero("s")).alias("score"))
