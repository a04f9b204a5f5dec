"""Near words, forms and roots against all pairs, over one section and over many, and odd rows."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from scriptorium.llm import spelling_trie as st
from scriptorium.llm.registry import op11_spelling_variants

SF = "/root/testdata/sf0.001"


def counted(rows, spoil, least_length):
    n = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if spoil and h % spoil == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= least_length
    return n


def near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def expected(rows, spoil=None, least_length=6, least_n=5, factor=5) -> set:
    n = {w: k for w, k in counted(rows, spoil, least_length).items() if k >= least_n}
    by_length = defaultdict(list)
    for w in n:
        by_length[len(w)].append(w)
    links = {w: [x for k in (-1, 0, 1) for x in by_length[len(w) + k] if near(w, x)] for w in n}
    form = {}
    for w, found in links.items():
        best = min(found, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= factor * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n[w], len(links[w]), n[form[w]] if form[w] else None) for w in n}


def test_query_against_all_pairs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = expected(rows, spoil=199)
    assert {tuple(r) for r in op11_spelling_variants(spark, SF).collect()} == want and any(w[1] for w in want)


@pytest.mark.parametrize("size, searching", [(40, 25), (10_000, 65_536)])
def test_many_sections_and_blocks_of_searching_words(spark, monkeypatch, size, searching):
    monkeypatch.setattr(st, "SECTION_WORDS", size)
    monkeypatch.setattr(st, "SEARCHING", searching)
    r = random.Random(5)
    long = "abcdefgh" * 9
    words = {"".join(r.choice("abcé") for _ in range(r.randrange(2, 7))) for _ in range(400)} | {long, long + "x", long[:-1], "y" + long, "ÿ" * 300, "ÿ" * 299}
    rows = [(i, " ".join([w] * r.choice([1, 2, 9, 60]))) for i, w in enumerate(sorted(words))]
    df = spark.createDataFrame(rows, "k long, t string")
    got = st.spelling_variants(df, id="k", text="t", least_length=2, least_n=1, factor=3)
    want = expected(rows, None, 2, 1, 3)
    assert {tuple(x) for x in got.collect()} == want
    assert any(w[1] and w[1] != w[2] for w in want)


def test_odd_rows(spark):
    rows = [(None, "Straße, STRASSE!"), (1, None), (2, ""), (3, "ÀÉÎÕÜß àéîõüß Ÿabcdef"), (3, "ÀÉÎÕÜß àéîõüß Ÿabcdef"), (4, "x" * 50_000)]
    df = spark.createDataFrame([(k, t, "z", 1, 2) for k, t in rows], "word long, n string, path string, section int, root int")
    got = st.spelling_variants(df, id="word", text="n", spoil=2, least_n=1)
    assert {tuple(r) for r in got.collect()} == expected(rows, 2, 6, 1)
    empty = st.spelling_variants(df.limit(0), id="word", text="n")
    assert empty.isEmpty() and empty.columns == ["word", "form", "root", "n", "n_near", "form_n"]
