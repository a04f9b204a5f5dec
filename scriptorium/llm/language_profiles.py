"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  A trigram's vector binds the vectors of its letters, each permuted by
its place; a document's vector bundles (adds) those of all its trigrams; a language's prototype bundles the unit
vectors of its training documents.  A document gets the language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import blocks, extended, with_columns

DIMENSIONS = 512
#: Letters share this many vectors; 0 stands for a run of anything that is no letter.
LETTER_VECTORS = 256
#: Trigrams whose vectors are held at once.
GRAM_BLOCK = 4096
BLOCK_CHARS = 300_000
UNDETERMINED = "und"


@lru_cache(1)
def letter_vectors() -> np.ndarray:
    """The vectors for each place in a trigram: one table, rolled by the place."""
    base = np.random.default_rng(5).choice(np.array([-1, 1], np.int8), (LETTER_VECTORS, DIMENSIONS))
    return np.stack([np.roll(base, place, axis=1) for place in range(3)])


@lru_cache(1)
def letter_numbers() -> np.ndarray:
    """Number of the vector of each code point, 0 for all but letters."""
    table = np.zeros(0x110000, np.int64)
    for point in range(0x110000):
        if not 0xD800 <= point < 0xE000 and chr(point).isalpha():
            table[point] = 1 + point % (LETTER_VECTORS - 1)
    return table


def document_vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bundled vectors of whole texts, and which texts have a letter at all."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer("\0".join(["", *lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    numbers = letter_numbers()[points]
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in lowered])
    owner = np.append(0, owner)[: len(points)]
    keep = (numbers > 0) | np.append(True, numbers[:-1] > 0)  # a run of other characters becomes one
    keep[0] = True
    numbers, owner = numbers[keep], owner[keep]
    has_letter = np.zeros(len(texts), bool)
    has_letter[owner[numbers > 0]] = True
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    if not has_letter.any():
        return out, has_letter
    a, b, c = numbers[:-2], numbers[1:-1], numbers[2:]
    inside = b > 0  # the middle letter is the document's own; runs at both ends are borders
    present = np.flatnonzero(np.bincount(numbers, minlength=LETTER_VECTORS))
    n = len(present)  # codes of trigrams run over the letters of this block only
    compact = np.zeros(LETTER_VECTORS, np.int64)
    compact[present] = np.arange(n)
    code = ((compact[a] * n + compact[b]) * n + compact[c])[inside]
    doc = owner[1:-1][inside]
    if n**3 <= 1 << 21:
        seen = np.flatnonzero(np.bincount(code, minlength=n**3))
        place = np.zeros(n**3, np.int64)
        place[seen] = np.arange(len(seen))
        column = place[code]
    else:
        seen, column = np.unique(code, return_inverse=True)
    first, second, third = letter_vectors()
    for at in range(0, len(seen), GRAM_BLOCK):
        g = seen[at : at + GRAM_BLOCK]
        bound = first[present[g // (n * n)]] * second[present[g // n % n]] * third[present[g % n]]
        here = (column >= at) & (column < at + GRAM_BLOCK)
        count = np.bincount(doc[here] * len(g) + column[here] - at, minlength=len(texts) * len(g))
        out += count.reshape(len(texts), len(g)).astype(np.float32) @ bound.astype(np.float32)
    return out, has_letter


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)


def learn_prototypes(docs: DataFrame, *, text: str, lang: str, where: Column) -> dict[str, np.ndarray]:
    """The prototype of every language, from all rows of ``where`` with text and a language.

    Partitions bundle what they hold; Spark adds up the bundles by language, so that what reaches the driver is one
    vector for each language.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), object)
            for start, block in blocks(texts, BLOCK_CHARS, 512):
                vectors = unit(document_vectors(block)[0])
                own = langs[start : start + len(block)]
                for name in set(own):
                    sums[name] = sums.get(name, 0) + vectors[own == name].sum(0, dtype=np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "bundle"])

    rows = docs.where(where & F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text), F.col(lang))
    bundles = rows.mapInArrow(run, "lang string, bundle array<double>")
    summed = bundles.groupBy("lang").agg(F.array(*[F.sum(F.col("bundle")[i]) for i in range(DIMENSIONS)]).alias("bundle"))
    return {r["lang"]: np.array(r["bundle"]) for r in summed.orderBy("lang").collect()}


def identify_language(docs: DataFrame, prototypes: dict[str, np.ndarray], *, text: str) -> DataFrame:
    """Add ``lang_pred`` and ``score`` (the cosine, at least 0) to every row.

    Null texts, texts without a letter, and every text when no language was learned get ``und`` with score 0.  Equal
    cosines go to the first language by name.  Repeated rows are answered alike; existing columns of the new names are
    replaced.  One narrow pass over whole texts.
    """
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    names = np.array([*sorted(prototypes), UNDETERMINED], object)
    table = unit(np.array([prototypes[k] for k in sorted(prototypes)]).reshape(-1, DIMENSIONS)).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            pick, score = np.full(len(texts), len(names) - 1), np.zeros(len(texts))
            for start, block in blocks(texts, BLOCK_CHARS, 512):
                vectors, known = document_vectors(block)
                if len(table):
                    cosine = unit(vectors) @ table.T
                    at = start + np.flatnonzero(known)
                    pick[at] = cosine.argmax(1)[known]
                    score[at] = np.clip(cosine.max(1)[known], 0, 1)
            yield with_columns(batch, keep, lang_pred=pa.array(names[pick].tolist(), pa.string()), score=score)

    kept = docs.select(*keep)
    return kept.mapInArrow(run, extended(kept.schema, "lang_pred string, score double"))
