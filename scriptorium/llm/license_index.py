"""Licence scans with a positional index of rare words.

Templates are word sequences: base phrases, notices, and the passages of whole licence texts between the places where
holders and years stand.  The inverse document frequency of every licence word is counted over the whole corpus.  Each
template is indexed by its words of highest IDF, with their positions in it.  In a text, every indexed word votes with its
weight for the starts that its postings imply.  A template may miss a share of its weight, and its indexed words weigh
more than that share; so a start with less than the difference cannot match, and no match goes without enough votes.
Starts with enough are verified: the mandatory phrases must stand at their places, and enough of the template's weight
must match.  All words of a base phrase are mandatory.  A licence text counts where all its passages follow one another.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import extended, with_columns

# Base phrases and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Notices by label.  The words between brackets are the mandatory phrases.
TEMPLATES = {
    "notice:gpl": "licensed under the [gnu general public license] version",
    "notice:gpl-text": "this program is [free software] you can redistribute it and or modify it under the terms of the [gnu general public license] as published by the free software foundation",
    "notice:lgpl": "under the terms of the [gnu lesser general public license] as published by the free software foundation",
    "notice:apache": "licensed under the [apache license version]",
    "notice:apache-text": "you may not use this file except in [compliance with the license] you may obtain a copy of the license at",
    "notice:mit": "released under the [mit license]",
    "notice:mit-text": "[permission is hereby granted free of charge] to any person obtaining a copy of this software and associated documentation files",
    "notice:bsd": "[redistribution and use in source and binary forms] with or without modification are permitted provided that the following conditions are met",
    "notice:mpl": "this source code form is subject to the terms of the [mozilla public license]",
    "notice:cc-by": "licensed under [cc by]",
    "notice:cc-by-nc": "licensed under [cc by nc]",
    "notice:cc-text": "this work is licensed under a [creative commons attribution] license",
    "notice:reserved": "[all rights reserved]",
}

# Passages of licence texts by label, in their order.  The words between brackets are the mandatory phrases.
LICENCE_TEXTS = {
    "text:mit": (
        "[permission is hereby granted free of charge] to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
        "the above copyright notice and this permission notice [shall be included in all copies] or substantial portions of the software",
        "[the software is provided as is without warranty of any kind] express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    ),
    "text:bsd": (
        "[redistribution and use in source and binary forms] with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code [must retain the above copyright notice] this list of conditions and the following disclaimer",
        "redistributions in binary form [must reproduce the above copyright notice] this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "any express or implied warranties including but not limited to [the implied warranties of merchantability and fitness for a particular purpose are disclaimed]",
    ),
    "text:isc": (
        "permission to use copy modify and or distribute this software [for any purpose with or without fee is hereby granted] provided that the above copyright notice and this permission notice appear in all copies",
        "the software is provided as is and the author [disclaims all warranties with regard to this software] including all implied warranties of merchantability and fitness",
    ),
    "text:zlib": (
        "this software is provided as is [without any express or implied warranty] in no event will the authors be held liable for any damages arising from the use of this software",
        "[the origin of this software must not be misrepresented] you must not claim that you wrote the original software",
        "[altered source versions must be plainly marked as such] and must not be misrepresented as being the original software",
    ),
    "text:apache": (
        "you may not use this file except in [compliance with the license] you may obtain a copy of the license at",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis [without warranties or conditions of any kind] either express or implied",
        "see the license for the [specific language governing permissions and limitations] under the license",
    ),
    "text:gpl": (
        "this program is [free software] you can redistribute it and or modify it under the terms of the [gnu general public license] as published by the free software foundation",
        "distributed in the hope that it will be useful but [without any warranty] without even the implied warranty of merchantability or fitness for a particular purpose",
        "you should have received a copy of the [gnu general public license] along with this program",
    ),
}

#: Words of a template that index it at least.
RARE_WORDS = 3
#: Share of a notice's words that must stand at their places.
LEAST_MATCH = 0.7

_LETTERS = bytes(b if b in b"0123456789abcdefghijklmnopqrstuvwxyz" or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words: runs of ASCII letters, digits and anything beyond ASCII."""
    return (text or "").encode("utf-8", "replace").translate(_LETTERS).split()


class Template:
    def __init__(self, label: str, text: str, base: str | None = None, passage: int | None = None):
        self.label, self.base, self.passage = label, base, passage
        self.words, self.mandatory, inside = [], [], False
        for word in text.replace("[", " [ ").replace("]", " ] ").split():
            if word in "[]":
                inside = word == "["
                continue
            if inside or base:
                self.mandatory.append(len(self.words))
            self.words.append(word.encode())


def templates(phrases: dict[str, str] = BASE_PHRASES, notices: dict[str, str] = TEMPLATES, texts: dict[str, tuple[str, ...]] = LICENCE_TEXTS) -> list[Template]:
    whole = [Template(label, text, passage=i) for label, passages in texts.items() for i, text in enumerate(passages)]
    return [Template(label, phrase, phrase) for phrase, label in phrases.items()] + [Template(label, text) for label, text in notices.items()] + whole


def document_frequencies(docs: DataFrame, *, text: str, known: list[Template]) -> tuple[int, dict[bytes, int]]:
    """Documents in all, and those that hold each licence word.  What reaches the driver is bounded by the templates."""
    lexicon = {w for t in known for w in t.words}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for value in batch.column(0).to_pylist():
                found.update(lexicon.intersection(words_of(value)))
                found[b""] += 1
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    counted = docs.select(F.col(text)).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    rows = {r["word"].encode(): r["n"] for r in counted.collect()}
    return rows.pop(b"", 0), rows


class RareWordIndex:
    """Postings of the rare words of templates."""

    def __init__(self, known: list[Template], n_docs: int, frequency: dict[bytes, int]):
        self.known = known
        self.idf = {w: math.log((1 + n_docs) / (1 + frequency.get(w, 0))) for t in known for w in t.words}
        self.number = {w: i for i, w in enumerate(sorted(self.idf))}
        self.ids = [np.array([self.number[w] for w in t.words]) for t in known]
        self.weights = [np.array([self.idf[w] + 1e-9 for w in t.words]) for t in known]
        self.needed, self.postings = [], defaultdict(list)
        for k, t in enumerate(known):
            own, must = self.weights[k], np.zeros(len(t.words), bool)
            must[t.mandatory] = True
            missing = min((1 - LEAST_MATCH) * own.sum(), own[~must].sum())  # all that a match can lack
            order = np.argsort(-own, kind="stable")
            enough = np.searchsorted(np.cumsum(own[order]), min(2 * missing, own.sum()) * (1 + 1e-9))
            rare = order[: max(RARE_WORDS, enough + 1)].tolist()
            self.needed.append((own[rare].sum() - missing) * (1 - 1e-9))
            for i in rare:
                self.postings[self.number[t.words[i]]].append((k, i))
        self.indexed = np.zeros(len(self.number) + 1, bool)
        self.indexed[list(self.postings)] = True

    def scan(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """Verified places: template, first word, share of its weight that matches."""
        ids = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        hits = np.flatnonzero(self.indexed[ids])
        if not len(hits):
            return []
        starts = defaultdict(list)
        for word in np.unique(ids[hits]).tolist():
            at = hits[ids[hits] == word]
            for k, i in self.postings[word]:
                starts[k].append((at - i, self.weights[k][i]))
        out = []
        for k, votes in starts.items():
            if sum(weight for _, weight in votes) < self.needed[k]:
                continue  # not even all indexed words that the text has would do
            places, which = np.unique(np.concatenate([at for at, _ in votes]), return_inverse=True)
            weight = np.bincount(which, np.concatenate([np.full(len(at), weight) for at, weight in votes]))
            places = places[weight >= self.needed[k]]
            own, weights, must = self.ids[k], self.weights[k], self.known[k].mandatory
            for start in places.tolist():
                at = start + np.arange(len(own))
                inside = (at >= 0) & (at < len(ids))
                same = inside & (ids[np.where(inside, at, 0)] == own)
                share = float(weights[same].sum() / weights.sum())
                if same[must].all() and (self.known[k].base or share >= LEAST_MATCH):
                    out.append((k, max(start, 0), share))
        return out


def whole_texts(found: list[tuple[int, int, float]], known: list[Template]) -> list[tuple[int, int, float]]:
    """What was found, less the passages of licence texts that are not there as a whole.

    A text is there if its passages follow one another from its first place on; it counts at that place, with its
    least matched passage's share."""
    out, passages = [], defaultdict(lambda: defaultdict(list))
    for k, at, share in sorted(found, key=lambda f: (f[1], f[0])):
        if known[k].passage is None:
            out.append((k, at, share))
        else:
            passages[known[k].label][known[k].passage].append((at, share, k))
    for label, places in passages.items():
        at, chain = -1, []
        for passage in range(sum(t.label == label for t in known)):
            after = next((p for p in places[passage] if p[0] > at), None)
            if after is None:
                break
            at = after[0]
            chain.append(after)
        else:
            out.append((chain[0][2], chain[0][0], min(share for _, share, _ in chain)))
    return out


def scan_licenses(docs: DataFrame, *, text: str, known: list[Template] | None = None) -> DataFrame:
    """Add the licence findings of every whole text to each row.

    ``n_words``; ``n_base``, ``first_word``, ``last_word`` and ``base_labels``: places of base phrases; ``labels``:
    the base labels and those of verified notices and whole licence texts; ``score``: the best matched share of weight;
    ``places``: array of (label, word, share).  A null or empty text has no words, null places and empty labels;
    repeated rows are answered alike; existing columns of the new names are replaced; an empty table gives an empty
    one.  Two narrow passes, the first for document frequencies over all rows.
    """
    known = templates() if known is None else known
    index = RareWordIndex(known, *document_frequencies(docs, text=text, known=known))
    new = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, places array<struct<label:string,word:long,share:double>>"
    names = [c.strip().split(" ")[0] for c in new.split(", ")]
    keep = [c for c in docs.columns if c not in names]
    kept = docs.select(*keep)
    place_type = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("share", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in names}
            for value in batch.column(batch.schema.get_field_index(text)).to_pylist():
                words = words_of(value)
                found = whole_texts(index.scan(words), known)
                base = [at for k, at, _ in found if known[k].base]
                for key, item in zip(names, (
                    len(words), len(base), min(base, default=None), max(base, default=None),
                    ",".join(sorted({known[k].label for k, _, _ in found if known[k].base})),
                    ",".join(sorted({known[k].label for k, _, _ in found})),
                    min(1.0, max((share for _, _, share in found), default=0.0)),
                    [{"label": known[k].label, "word": at, "share": share} for k, at, share in sorted(found, key=lambda f: (f[1], f[0]))],
                )):
                    out[key].append(item)
            kinds = (pa.int64(),) * 4 + (pa.string(),) * 2 + (pa.float64(), place_type)
            yield with_columns(batch, keep, **{k: pa.array(v, kind) for (k, v), kind in zip(out.items(), kinds)})

    return kept.mapInArrow(run, extended(kept.schema, new))
