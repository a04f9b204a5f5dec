import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from scriptorium.llm import best_fit as bf

PATH = public_tokenizers.path("word_bpe_49k.json")
PARTS = ["a", "B", "'", "'s", " ", "  ", "\n", " ", "1", "²", "é", "!", "<|endoftext|>", "À", "µ", "中文", "😀", "\x1c", "\x85", "́", "Σ", "İ", "\x0b"]


def test_ids_equal_library():
    random.seed(4)
    texts = ["".join(random.choice(PARTS) for _ in range(random.randrange(20))) for _ in range(3000)]
    want = [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    assert bf.WordIds(PATH).encode(texts) == want


def decreasing(lengths: list[int], limit: int) -> int:
    """Sequences of best fit decreasing, piece by piece."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else limit) - n)
    return len(rooms)


def test_sweep_gives_every_piece_its_successor_gap():
    random.seed(7)
    for _ in range(300):
        gaps, pieces = ([random.randrange(1, 40) for _ in range(random.randrange(15))] for _ in range(2))
        gap_runs, rows = Counter(gaps), Counter(pieces)
        sizes = sorted({*gaps, *pieces}, reverse=True)
        runs = []
        for s in sizes:
            if gap_runs[s]:
                runs.append((bf.GAP, s, gap_runs[s], 100 * s))
            if rows[s]:
                runs.append((bf.WAITING, s, rows[s], 0))
        matches, rest = bf.sweep(runs)
        free, want = sorted(gaps), []
        for n in sorted(pieces, reverse=True):
            fits = [g for g in free if g >= n]
            if fits:  # the nearest larger gap, also one that has taken pieces
                free.remove(min(fits))
                free.append(min(fits) - n)
                want.append((n, min(fits)))
        got = [(length, room - i % per * length) for length, n, _, per, _, room in matches for i in range(n)]
        assert sorted(got) == sorted(want)
        assert sum(n for k, _, n, _ in rest if k == bf.WAITING) == len(pieces) - len(want)
        assert sorted(s for k, s, n, _ in rest if k == bf.GAP for _ in range(n)) == sorted(g for g in free if g)


def test_supersteps_are_near_best_fit_decreasing(spark, monkeypatch):
    monkeypatch.setattr(bf, "RANGE_RUNS", 3)
    monkeypatch.setattr(bf, "MERGED_RANGES", 2)
    random.seed(5)
    for choice in ([1, 2, 3, 7, 20, 33, 50, 64], range(20, 45), [5]):
        lengths = [random.choice(choice) for _ in range(400)]
        runs = spark.createDataFrame(list(Counter(lengths).items()), "length long, n long")
        matches, n = bf.best_fit_matches(runs, 64)
        used, ranks = {}, Counter()
        for r in matches.collect():
            n -= 1
            for i in range(r.n):
                used.setdefault(r.seq + i // r.per, []).append((64 - r.room + i % r.per * r.size, r.size))
                ranks[r.size, r["first"] + i] += 1
        assert n == 0 and set(ranks.values()) == {1} and Counter(s for s, _ in ranks) == Counter(lengths)
        for places in used.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= 64
        assert len(used) <= decreasing(lengths, 64) + 2


def test_ranges_are_swept_side_by_side_at_the_production_limit(spark, monkeypatch):
    random.seed(6)
    lengths = [random.randrange(1, 2049) for _ in range(6000)]
    seen, plain = [], bf.swept

    def spied(ranges):
        seen.append(ranges.rdd.getNumPartitions())
        return plain(ranges)

    monkeypatch.setattr(bf, "swept", spied)
    runs = spark.createDataFrame(list(Counter(lengths).items()), "length long, n long")
    matches, _ = bf.best_fit_matches(runs, 2048)
    rows = matches.collect()
    assert max(seen) >= 6 and sum(n > 1 for n in seen) >= len(seen) / 3
    assert Counter(r.size for r in rows for _ in range(r.n)) == Counter(lengths)
    assert max(r.seq + -(-r.n // r.per) for r in rows) <= decreasing(lengths, 2048) * 1.001 + 1


def test_rows(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "hello world " * 30, 0), (3, "hello world " * 30, 0), (4, "a", 0)], "doc_id long, text string, piece int")
    got = bf.pack(docs, text="text", tokenizer=PATH, limit=16).orderBy("doc_id", "piece").collect()
    assert Counter(r.doc_id for r in got) == {1: 1, 2: 1, 3: 8, 4: 1}
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 16
    assert len(by) == 8
    ids = [*Tokenizer.from_file(PATH).encode("hello world " * 30, add_special_tokens=False).ids, 0]
    first = [r for r in got if r.doc_id == 3 and r.piece == 1]
    assert {r.ids_crc32 for r in first} == {zlib.crc32(np.array(ids[16:32], "<u4").tobytes())}
    assert bf.pack(docs.limit(0), text="text", tokenizer=PATH).count() == 0


def test_columns_of_any_name_pass_through(spark):
    names = ["rank", "before", "part", "local_rank", "caller", "seq", "room", "n", "first", "per", "box", "kind"]
    docs = spark.createDataFrame([(*range(len(names)), "a b c", {"k": 1})] * 3, [*names, "text", "m"])
    got = bf.pack(docs, text="text", tokenizer=PATH, limit=16).collect()
    assert len(got) == 3 and all([r[c] for c in names] == [*range(len(names))] and r.m == {"k": 1} for r in got)
