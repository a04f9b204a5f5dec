"""Line-first quality rules: lines that break a rule go first, then documents that lost too much text with them.

Every line with a word is held against three kinds of rules.  Punctuation: it ends in a mark that closes a sentence, and
few of its words carry runs of marks or symbols.  Navigation: it is no row of links or table cells.  Boilerplate: it holds
no stock phrase of a page's frame and is no copy of an earlier line.  What is left is the cleaned text; a document is kept
if enough of its characters are in it.  A text is settled where it lies: nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from scriptorium.llm.common import BOX, blocks, boxed, extended, unboxed

# What separates words, symbols, the end of a sentence with what may close it, runs of marks, cells.
WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
SENTENCE_END = r"[.!?…。！？][)\"'\]”’»）」』]*[ \t\x0b\x0c\r]*$"
MARK_RUN = r"[!?#*$%&|<>]{2,}"
SENTENCE_INSIDE = r"[.!?…。！？][)\"'\]”’»）」』]*[ \t]"
CELL_MARKS = "|»›•·>"
CELL = rf"(?:^|[ \t])[{CELL_MARKS}](?:[ \t]|$)"
# Phrases of a page's frame, in lower case.
STOCK_PHRASES = (
    "all rights reserved", "click here", "cookie policy", "follow us on", "javascript is disabled", "log in to", "lorem ipsum", "privacy policy",
    "read more", "share this", "sign in to", "sign up for", "skip to content", "subscribe to our", "terms of service", "terms of use",
)


@dataclass(frozen=True)
class Rules:
    """Limits: cells of a line from which it is navigation, share of words with runs of marks from which its punctuation
    fails, words from which an open line is a paragraph, the least words and the largest share of repeated ones of a text,
    and the least share of characters left."""

    cells: int = 2
    marked_share: float = 0.3
    paragraph_words: int = 20
    least_words: int = 50
    repeated_share: float = 0.5
    least_left: float = 0.5


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three that occurs twice or more in the text."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    pairs = ids[:-1] * len(number) + ids[1:]
    if len(number) > 2_000_000:  # then three numbers do not fit one long
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * len(number) + ids[2:]
    ordered = np.sort(windows)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    again, inside = np.isin(windows, twice), np.zeros(len(words), bool)
    for at in range(3):
        inside[at : at + len(again)] |= again
    return int(inside.sum())


def failed_rule(line: str, n_words: int, seen: set[str], rules: Rules) -> str | None:
    """The kind of rule that a line with a word breaks, the first of navigation, boilerplate and punctuation; None for none."""
    if sum(map(line.count, CELL_MARKS)) >= rules.cells and len(re.findall(CELL, line)) >= rules.cells:
        return "navigation"
    low = line.lower()
    if line in seen or any(phrase in low for phrase in STOCK_PHRASES):
        return "boilerplate"
    # A long line that only its last sentence leaves open is a paragraph that was cut off.
    closed = re.search(SENTENCE_END, line) or n_words >= rules.paragraph_words and re.search(SENTENCE_INSIDE, line)
    if not closed or len(re.findall(MARK_RUN, line)) > rules.marked_share * n_words:
        return "punctuation"
    return None


def settled(text: str, rules: Rules) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed lines by kind, cleaned text)."""
    words = text.encode("utf-8", "surrogatepass").split()
    chars = lambda s: len(s) - sum(map(s.count, WHITE))
    total, again = chars(text), repeated_words(words)
    seen, left, repeats, failed = set(), [], 0, {"navigation": 0, "boilerplate": 0, "punctuation": 0}
    for line in text.split("\n"):
        n_words = len(line.encode("utf-8", "surrogatepass").split())
        if not n_words:
            left.append(line)
            continue
        repeats += line in seen
        rule = failed_rule(line, n_words, seen, rules)
        seen.add(line)
        if rule:
            failed[rule] += 1
        else:
            left.append(line)
    cleaned = "\n".join(left)
    base_failed = len(words) < rules.least_words or again > rules.repeated_share * len(words)
    kept = not base_failed and chars(cleaned) >= rules.least_left * total
    return len(words), total, sum(map(text.count, SYMBOLS)), repeats, again, base_failed, kept, *failed.values(), cleaned


FOUND = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, navigation_lines long, boilerplate_lines long, punctuation_lines long, cleaned string"


def clean_lines(docs: DataFrame, *, text: str, rules: Rules = Rules()) -> DataFrame:
    """Adds to every row the measures of its whole text, whether it is kept, lines failed by kind and the cleaned text.

    A null text counts as empty: it has no words, fails the base rules and its cleaned text is empty.  Equal lines and
    repeated rows are settled alike; a text may have any length, each is held by itself; existing columns of the new names
    are replaced, all others are kept whatever their names; an empty table gives an empty one.
    """
    names, kinds = zip(*[part.split() for part in FOUND.split(", ")])
    arrow = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
    keep = [c for c in docs.columns if c not in names]
    kept = boxed(docs, keep, text=docs[text])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in blocks([t or "" for t in batch.column(1).to_pylist()]):
                columns = zip(*[settled(t, rules) for t in texts])
                found = [pa.array(values, arrow[kind]) for values, kind in zip(columns, kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *found], names=[BOX, *names])

    schema = extended(StructType([kept.schema[BOX]]), FOUND)
    return kept.mapInArrow(run, schema).select(*unboxed(keep, kept.schema), *names)
