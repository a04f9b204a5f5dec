"""A byte-level convolutional quality classifier in numpy.

A text's bytes are embedded and cut into overlapping chunks that cover all of it.  Learned filters run over every chunk
and are max-pooled within it; a small layer turns a chunk's maxima into features, which are pooled over the chunks of
the document (maximum and mean) and combined into one probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import extended, fitted, sampled, with_columns

EMBED, FILTER_BYTES, STRIDE, FILTERS, HIDDEN = 8, 8, 2, 32, 16
CHUNK, STEP = 192, 176
PAD = 256
PLACES = (CHUNK - FILTER_BYTES) // STRIDE + 1
#: Documents of an update of the weights.
BATCH = 32
#: Chunks whose windows are held at once.
CHUNK_BLOCK = 128


def chunks_of(text: bytes) -> np.ndarray:
    """Overlapping chunks that cover the text, padded; an empty text is one chunk of padding."""
    n = max(1, -(-(len(text) - CHUNK) // STEP) + 1)
    padded = np.full((n - 1) * STEP + CHUNK, PAD, np.int16)
    padded[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STEP]


@dataclass
class ByteCNN:
    seed: int = 2
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self):
        if not self.weights:
            rng = np.random.default_rng(self.seed)
            draw = lambda *shape: rng.normal(0, (2 / shape[0]) ** 0.5, shape).astype(np.float32)
            self.weights = {
                "embed": rng.normal(0, 0.5, (PAD + 1, EMBED)).astype(np.float32), "filter": draw(FILTER_BYTES * EMBED, FILTERS), "filter_bias": np.zeros(FILTERS, np.float32),
                "hidden": draw(FILTERS, HIDDEN), "hidden_bias": np.zeros(HIDDEN, np.float32), "out": draw(2 * HIDDEN, 1)[:, 0], "out_bias": np.zeros(1, np.float32),
            }
            self.weights["embed"][PAD] = 0

    def windows(self, chunks: np.ndarray) -> np.ndarray:
        embedded = self.weights["embed"][chunks].reshape(len(chunks), CHUNK * EMBED)
        return np.lib.stride_tricks.sliding_window_view(embedded, FILTER_BYTES * EMBED, axis=1)[:, :: STRIDE * EMBED]

    def pooled(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maxima of the filters over each chunk, and where they are."""
        top, where = np.empty((len(chunks), FILTERS), np.float32), np.empty((len(chunks), FILTERS), np.int64)
        for at in range(0, len(chunks), CHUNK_BLOCK):
            part = chunks[at : at + CHUNK_BLOCK]
            flat = np.ascontiguousarray(self.windows(part)).reshape(-1, FILTER_BYTES * EMBED)
            value = (flat @ self.weights["filter"]).reshape(len(part), PLACES, FILTERS)
            where[at : at + len(part)] = value.argmax(1) if self.training else 0
            top[at : at + len(part)] = value.max(1)
        return np.maximum(top + self.weights["filter_bias"], 0), where

    training = False

    def forward(self, chunks: np.ndarray, doc: np.ndarray, n_docs: int):
        top, where = self.pooled(chunks)
        hidden = np.tanh(top @ self.weights["hidden"] + self.weights["hidden_bias"])
        starts = np.searchsorted(doc, np.arange(n_docs))
        most = np.maximum.reduceat(hidden, starts)
        count = np.diff(np.append(starts, len(doc)))[:, None]
        mean = np.add.reduceat(hidden, starts) / count
        features = np.concatenate([most, mean], 1)
        logit = features @ self.weights["out"] + self.weights["out_bias"]
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30))), (top, where, hidden, most, count, features)

    def gradients(self, chunks: np.ndarray, doc: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss, by back-propagation through the maxima."""
        p, (top, where, hidden, most, count, features) = self.forward(chunks, doc, len(labels))
        w = self.weights
        d_logit = ((p - labels) / len(labels)).astype(np.float32)
        d_features = d_logit[:, None] * w["out"]
        is_most = (hidden == most[doc]).astype(np.float32)
        is_most /= np.add.reduceat(is_most, np.searchsorted(doc, np.arange(len(labels))))[doc]  # equal maxima share
        d_hidden = d_features[doc, :HIDDEN] * is_most + (d_features[:, HIDDEN:] / count)[doc]
        d_pre = d_hidden * (1 - hidden**2)
        d_top = (d_pre @ w["hidden"].T) * (top > 0)
        row, f = np.nonzero(d_top)
        at = where[row, f] * STRIDE
        own = chunks[row[:, None], at[:, None] + np.arange(FILTER_BYTES)]
        seen = w["embed"][own].reshape(len(row), -1)
        grad = {"out": features.T @ d_logit, "out_bias": d_logit.sum(keepdims=True), "hidden": top.T @ d_pre, "hidden_bias": d_pre.sum(0), "filter_bias": d_top.sum(0)}
        value = d_top[row, f]
        grad["filter"] = np.stack([value[f == k] @ seen[f == k] for k in range(FILTERS)], 1)
        d_seen = (value[:, None] * w["filter"].T[f]).reshape(-1, EMBED)
        grad["embed"] = np.stack([np.bincount(own.ravel(), d_seen[:, e], PAD + 1) for e in range(EMBED)], 1)
        grad["embed"][PAD] = 0
        return {k: g.astype(np.float32) for k, g in grad.items()}

    def fit(self, texts: list[bytes], labels: np.ndarray, *, epochs: int, batch: int = BATCH, rate: float = 0.004) -> ByteCNN:
        rng, step = np.random.default_rng(self.seed), 0
        first, second = ({k: np.zeros_like(v) for k, v in self.weights.items()} for _ in range(2))
        cut = [chunks_of(t) for t in texts]
        total = max(1, epochs * -(-len(texts) // batch))
        self.training = True
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), batch):
                own = order[at : at + batch]
                doc = np.repeat(np.arange(len(own)), [len(cut[i]) for i in own])
                step += 1
                speed = rate * min(1, step / 20) * (1 - 0.95 * step / total)
                for k, g in self.gradients(np.concatenate([cut[i] for i in own]), doc, labels[own]).items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    self.weights[k] -= speed * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
        self.training = False
        return self

    def score(self, texts: list[bytes]) -> np.ndarray:
        out, held, size = np.empty(len(texts)), [], 0
        for i, text in enumerate(texts):
            held.append(chunks_of(text))
            size += len(held[-1])
            if size >= 512 or len(held) >= 512 or i == len(texts) - 1:
                doc = np.repeat(np.arange(len(held)), [len(c) for c in held])
                out[i + 1 - len(held) : i + 1] = self.forward(np.concatenate(held), doc, len(held))[0]
                held, size = [], 0
        return out


def as_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def learn_quality(docs: DataFrame, labels: DataFrame, *, id: str, text: str, label: str, where: Column, most: int = 7500, longest: int = 1 << 15, updates: int = 900) -> ByteCNN:
    """Fit on a bounded sample of labelled rows of ``where``: as many ids as ``most`` by their hash, give or take the
    chance of a hash, of texts of at most ``longest`` bytes.  Both bounds only concern the fit, which is one task; only
    the sample's texts are shuffled, and only the weights reach the driver.

    Rows without a label or text are not learned from.  Without any row, the network stays as drawn.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id).isNotNull())
    share = most / max(1, known.count())
    known = sampled(known, id, share).groupBy(id).agg(F.max(label).cast("double").alias("_y"))
    rows = sampled(docs.where(where & F.col(text).isNotNull() & (F.octet_length(text) <= longest)), id, share)

    def fit(sample: list[tuple]) -> dict:
        texts, y = [as_bytes(t) for t, _ in sample], np.array([y for _, y in sample], np.float32)
        return ByteCNN().fit(texts, y, epochs=-(-updates // -(-len(sample) // BATCH))).weights

    return ByteCNN(weights=fitted(rows.select(id, text).join(known, id).select(text, "_y"), fit) or {})


def score_quality(docs: DataFrame, model: ByteCNN, *, text: str, threshold: float = 0.3) -> DataFrame:
    """Add ``score`` (0 to 1, the probability of label 1) and ``predicted`` (1 from ``threshold`` on) to every row.

    A null or empty text is a chunk of padding and is scored like any other; repeated rows are scored alike; existing
    columns of the new names are replaced; an empty table gives an empty one.  One narrow pass over whole texts.
    """
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    weights = model.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ByteCNN(weights=weights)
        for batch in batches:
            score = own.score([as_bytes(t) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()])
            yield with_columns(batch, keep, score=score.astype(np.float64), predicted=pa.array((score >= threshold).astype(np.int32)))

    kept = docs.select(*keep)
    return kept.mapInArrow(run, extended(kept.schema, "score double, predicted int"))
