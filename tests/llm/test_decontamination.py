import random
from collections import Counter

import numpy as np

from scriptorium.llm import decontamination as dc


def words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def brute(text, items, least):
    """Every window of every item's size, on word tuples."""
    out = {}
    cut = lambda w: [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []
    own = cut((text or "").lower().split())
    for i, t in items:
        item = cut((t or "").lower().split())
        span = min(len(item), len(own))
        for at in range(len(own) - span + 1) if span else ():
            a, b = Counter(own[at : at + span]), Counter(item)
            score = (a & b).total() / (a | b).total()
            if score >= least and score > out.get(i, (0, 0))[0]:
                out[i] = (score, at)
    return {i: (round(s, 9), at) for i, (s, at) in out.items()}


def test_equals_brute_force(spark):
    rng = random.Random(2)
    items = [(i, " ".join(words(rng, rng.choice([6, 14, 30, 59])))) for i in range(25)] + [(30, "a b"), (31, "rep " * 12), (32, ""), (33, None)]
    docs = [(0, None), (1, ""), (2, "A  b"), (3, "rep " * 20), (4, " ".join(words(rng, 300)))]
    for k in range(60):
        passage = (rng.choice(items[:25])[1]).split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            passage[rng.randrange(len(passage))] = rng.choice(["changed", "other word"])
        docs.append((10 + k, " ".join([*words(rng, rng.choice([0, 3, 200])), *passage, *words(rng, rng.choice([0, 50]))]).upper()))
    docs.append(docs[-1])
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, similarity int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = dc.find_leaks(frame, bench, text="text", item_id="item_id", item_text="text").collect()
    got = Counter((r.doc_id, r.item_id, round(r.similarity, 9), r.first_word) for r in found)
    want = Counter((d, i, *v) for d, t in docs for i, v in brute(t, items, 0.8).items())
    assert got == want and len(got) > 40
    kept = dc.drop_leaks(frame, bench, text="text", item_id="item_id", item_text="text").count()
    assert kept == sum(d not in {g[0] for g in got} for d, _ in docs)
    assert dc.find_leaks(frame.limit(0), bench, text="text", item_id="item_id", item_text="text").count() == 0
    assert dc.find_leaks(frame, bench.limit(0), text="text", item_id="item_id", item_text="text").count() == 0


def test_a_large_benchmark_takes_several_passes(spark, monkeypatch):
    monkeypatch.setattr(dc, "INDEX_BYTES", 200)
    rng = random.Random(3)
    bench = spark.createDataFrame([(i, " ".join(words(rng, 20))) for i in range(12)], "item_id long, text string")
    docs = bench.selectExpr("item_id as doc_id", "text")
    found = dc.find_leaks(docs, bench, text="text", item_id="item_id", item_text="text").collect()
    assert sorted((r.doc_id, r.item_id, r.similarity) for r in found) == [(i, i, 1.0) for i in range(12)]


def test_the_blocks_find_every_fingerprint_within_the_radius():
    rng = np.random.default_rng(1)
    index = dc.ItemIndex([(i, rng.integers(0, 2**63, 12, np.uint64)) for i in range(30)])
    whole = lambda words: int.from_bytes(words.tobytes(), "little")
    prints = [whole(b) for b in index.blocks]
    for far in (0, 5, 25, 38):
        for i, value in enumerate(prints):
            for bit in rng.choice(128, far, replace=False).tolist():
                value ^= 1 << bit
            asked = np.frombuffer(value.to_bytes(16, "little"), np.uint64)[None, :]
            found = {item for _, item, _ in index.candidates(asked, np.arange(30))}
            assert i in found and found == {j for j, p in enumerate(prints) if (p ^ value).bit_count() <= dc.RADIUS}


def test_fingerprints_of_windows_at_the_threshold_are_within_the_radius():
    rng, caught, unrelated = np.random.default_rng(4), 0, 0
    for _ in range(3000):
        size = int(rng.integers(9, 120))
        a = rng.integers(0, 2**63, size, np.uint64)
        b = a.copy()
        own = rng.choice(size, int(size / 9), replace=False)  # shared / all = 0.8 at least
        b[own] = rng.integers(0, 2**63, len(own), np.uint64)
        near, far = (dc.window_fingerprints(x, size)[0] for x in (b, rng.integers(0, 2**63, size, np.uint64)))
        mine = dc.window_fingerprints(a, size)[0]
        assert dc.similarity(a, b) >= 0.8
        caught += np.bitwise_count(mine ^ near).sum() <= dc.RADIUS
        unrelated += np.bitwise_count(mine ^ far).sum() <= dc.RADIUS
    assert caught >= 0.999 * 3000 and unrelated <= 3


def test_a_long_text_is_read_in_slices(monkeypatch):
    rng = random.Random(6)
    item = words(rng, 40)
    text = " ".join([*words(rng, 30_000), *item, *words(rng, 500), *item, *words(rng, 9000), *["rep"] * 2000])
    index = dc.ItemIndex([(1, dc.shingle_sequence(" ".join(item))), (2, dc.shingle_sequence("rep " * 30))])
    want = index.matches(text, 0.8)
    monkeypatch.setattr(dc, "SLICE_BYTES", 1000)
    monkeypatch.setattr(dc, "WINDOWS", 64)
    assert index.matches(text, 0.8) == want == [(1, 1.0, 30_000, 36, 0), (2, 1.0, 39_580, 26, 0)]


def test_rows_of_null_ids_are_judged_by_their_own_text(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string")
    docs = spark.createDataFrame([(None, "x a b c d e f g h"), (None, "clean words only"), (7, "clean"), (7, "a b c d e f g h")], "doc_id long, text string")
    kept = dc.drop_leaks(docs, bench, text="text", item_id="item_id", item_text="text").collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == [("7", "clean"), ("None", "clean words only")]
