import random
import re

import numpy as np
import pytest

from scriptorium.llm import near_duplicates as nd


def brute(texts: dict[int, str | None], percent: int) -> dict[int, tuple[int, int]]:
    """All pairs, on sets of word tuples."""
    sets = {}
    for i, t in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)) and find(i) != find(j):
                common = len(a & b)
                if 100 * common >= percent * (len(a) + len(b) - common):
                    root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: (len(sets[i]), find(i)) for i in ids}


def run(spark, texts, percent):
    docs = spark.createDataFrame([(i, t, 1.5) for i, t in texts.items()], "doc_id long, text string, sig double")
    got = nd.near_duplicates(docs, id="doc_id", text="text", sim=nd.Similarity(percent=percent)).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in got}


@pytest.mark.parametrize("percent", [80, 85])
def test_given_documents(spark, percent):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert run(spark, texts, percent) == brute(texts, percent)


def test_group_of_near_copies_with_unlinked_members(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK_ROWS", 16)
    rng = random.Random(1)
    words = [f"w{i}" for i in range(60)]
    texts = {}
    for i in range(80):
        own = words[:]
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3])):
            own[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        texts[i] = " ".join(own)
    # two that are linked with each other but not with the group
    far = words[:]
    for k in (3, 20, 40):
        far[k] = f"y{k}"
    texts[90], texts[91] = " ".join(far), " ".join([*far[:-1], "z"])
    assert run(spark, texts, 80) == brute(texts, 80)


def of_rows(rows: list[tuple[int, str]], percent: int) -> dict[int, int]:
    """Component by id where ids may repeat: texts are compared, and a text's ids are one document each."""
    whole = brute(dict(enumerate(t for _, t in rows)), percent)
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, _) in enumerate(rows):
        j = rows[whole[k][1]][0]
        if find(i) != find(j):
            root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in root}


def test_repeated_ids_keep_the_links_of_all_their_texts(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(1, a), (1, b), (2, b + " e"), (3, a + " e")]
    for own in (rows, [rows[1], rows[0], *rows[2:]], rows[::-1]):
        got = nd.near_duplicates(spark.createDataFrame(own, "id long, text string"), id="id", text="text", sim=nd.Similarity()).collect()
        assert {r.component_id for r in got} == {1} and len(got) == 4
    rng = random.Random(8)
    rows = []
    for _ in range(150):
        base = rng.randrange(25)
        own = [f"g{base}-{i}" for i in range(40)]
        for _ in range(rng.choice([0, 1, 1, 2])):
            own[rng.randrange(40)] = f"x{rng.randrange(1000)}"
        rows.append((rng.randrange(60), " ".join(own)))
    got = nd.near_duplicates(spark.createDataFrame(rows, "id long, text string").repartition(3), id="id", text="text", sim=nd.Similarity()).collect()
    assert {r.id: r.component_id for r in got} == of_rows(rows, 80)


def test_ten_thousand_near_copies_cost_a_row_each(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*words[:-1], f"end{i}"])) for i in range(10_000)]
    for i in range(10_000, 10_100):  # strays: an own edit in the middle, near the whole group all the same
        own = words[:]
        own[rng.randrange(20, 40)] = f"x{i}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "id long, text string")
    got = nd.near_duplicates(docs, id="id", text="text", sim=nd.Similarity())
    assert got.groupBy("component_id").count().collect() == [(0, 10_100)]
    # of one group with 100 strays, the rows sent to blocks are far from the group's square
    members = spark.range(10_000).selectExpr("0L as grp", "0 as band", "id as nid", "if(id < 100, id, 100) as comp", "10000L as n", "100L as main", "100L as strays")
    assert nd.meetings(members).count() == 10_000 + 100 * -(-10_000 // nd.BLOCK_ROWS)


def test_edge_cases(spark):
    texts = {1: None, 2: "", 3: " \t\n", 4: "a b", 5: "A  b", 6: "a b c", 7: "b a", 8: "x " * 4000, 9: "x y " * 3000}
    want = brute(texts, 85)
    assert run(spark, texts, 85) == want and want[5] == (1, 4) and want[2] == (0, 2)
    docs = spark.createDataFrame([(1, "p q r s t u"), (1, "p q r s t u"), (1, "k l m"), (2, "k l m"), (None, "k l m")], "doc_id long, text string")
    got = nd.near_duplicates(docs, id="doc_id", text="text", sim=nd.Similarity()).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == [("1", "1", True)] * 3 + [("2", "1", False), ("None", "None", True)]
    assert nd.near_duplicates(docs.limit(0), id="doc_id", text="text", sim=nd.Similarity()).count() == 0


def test_pruning_bounds_keep_the_miss_probability():
    sim = nd.Similarity(percent=85)
    rng = np.random.default_rng(0)
    matches = rng.random((20000, sim.values)) < 0.85
    for n, least in sim.least_matches():
        assert (matches[:, :n].sum(1) < least).mean() < 1e-3
    assert (1 - 0.85**sim.rows) ** sim.bands <= sim.miss
