"""Queries over whole tables against brute force."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

from scriptorium import registry
from scriptorium.functions import text as tx
from scriptorium.operators import retrieval as rt

registry.load()
SF = "/root/testdata/sf0.001"
table = lambda name: pd.read_parquet(f"{SF}/{name}.parquet")


def nearest(k):
    v = table("embeddings").sort_values("vec_id")
    x = np.array(v["embedding"].tolist(), np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, out = v["vec_id"].to_numpy(), {}
    for i in np.flatnonzero(ids % 50 == 0):
        score = np.round(x @ x[i], 6)
        out[int(ids[i]) // 50] = ids[np.lexsort((ids, -score))[:k]].tolist()
    return out


def matching(k):
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    docs, out = [(d, words(t)) for d, t in table("documents")[["doc_id", "text"]].itertuples(index=False)], {}
    for item, text in table("benchmark")[["item_id", "text"]].itertuples(index=False):
        asked, hits = set(words(text)), []
        for d, t in docs:
            at = [i for i, w in enumerate(t) if w in asked]
            if at and {t[i] for i in at} == asked:
                hits.append((-round(len(at) / (at[-1] - at[0] + 1), 6), d))
        if hits:
            out[item] = [d for _, d in sorted(hits)[:k]]
    return out


def test_vector_search_in_blocks_and_slices(spark, monkeypatch):
    for name, n in (("QUERY_BYTES", 3 * 512), ("VECTOR_BYTES", 100 * 512), ("CHUNK", 32)):
        monkeypatch.setattr(rt, name, n)
    got = registry.QUERIES["vector_top_k"](spark, SF).toPandas().sort_values(["query_id", "rank"])
    assert got.groupby("query_id")["vec_id"].agg(list).to_dict() == nearest(20)


def test_fusion_of_the_whole_benchmark(spark):
    score = defaultdict(float)
    for found in (matching(200), nearest(200)):
        for q, ids in found.items():
            for rank, i in enumerate(ids, 1):
                score[q, i] += 1 / (60 + rank)
    got = registry.QUERIES["rank_fusion"](spark, SF).toPandas()
    assert {(q, r): s for q, r, s in got[["query_id", "result_id", "score"]].itertuples(index=False)} == {k: round(s, 9) for k, s in score.items()}


def test_metrics_and_candidates_of_more_than_five_queries(spark):
    asked = set(matching(1)) | set(nearest(1))
    assert set(registry.QUERIES["relevance_metrics"](spark, SF).toPandas()["query_id"]) == asked
    assert set(registry.QUERIES["approximate_candidates"](spark, SF).toPandas()["query_id"]) == set(nearest(1))


def read_numeral(word):
    """Recursively: what stands before the last myriad times it, plus the rest."""
    if word.isascii():
        return str(int(word)) if int(word) < 1 << 63 else "?"

    def below(w):
        at = next((i for i, c in enumerate(w) if c in tx.UNITS), None)
        if at is None:
            return tx.DIGITS[w[-1]] if w else 0
        return max(1, below(w[:at])) * tx.UNITS[w[at]] + below(w[at + 1 :])

    def value(w):
        at = max((i for i, c in enumerate(w) if c in tx.MYRIADS), default=None)
        return below(w) if at is None else value(w[:at]) * tx.MYRIADS[w[at]] + below(w[at + 1 :])

    return str(value(word))


@pytest.mark.parametrize("given", [False, True])
def test_whitespace_of_all_texts(spark, tmp_path, given):
    texts = ["第十二章\n\n\n\n\u3000\u3000三亿零七 \n  end  ", "  \n", "", "一万二千 42 " + "9" * 25, None]
    docs = table("documents")[["doc_id", "text"]] if given else pd.DataFrame({"doc_id": range(5), "text": texts})
    docs.to_parquet(tmp_path / "documents.parquet")
    want = []
    for i, t in docs.itertuples(index=False):
        if t is None:
            want.append((i, None, None, None))
            continue
        lines = [x.strip(" ") for x in t.replace("\u3000", " ").replace("\xa0", " ").split("\n")]
        clean = re.sub("\n{3,}", "\n\n", "\n".join(lines)).strip(" ")
        want.append((i, len(clean), hashlib.md5(clean.encode()).hexdigest(), ",".join(map(read_numeral, re.findall(f"[{tx.NUMERAL}]+|[0-9]+", t)))))
    got = [tuple(r) for r in registry.QUERIES["whitespace_whole"](spark, str(tmp_path)).orderBy("doc_id").collect()]
    assert got == sorted(want)
