import re
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as cp
from scriptorium.llm.common import written

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_every_stage_against_brute_force(spark):
    source = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10_001, None, "en", "src0", 0), (10_002, " 123 ...", "en", "src0", 8), (None, "It is the thing that was in the one and of the other.", None, None, None)], source.schema)
    docs, kept = written(source.union(extra), "test"), {}
    stages = dict(cp.STAGES)
    assert list(stages) == ["language_id", "quality", "near_duplicates", "decontamination", "packing"]
    for name, stage in cp.STAGES[:-1]:
        out = written(stage(spark, docs, SF), name)
        assert out.columns == docs.columns
        before, after = ({r.doc_id: r.text for r in d.collect()} for d in (docs, out))
        assert after.items() <= before.items()
        kept[name] = (before, after)
        docs = out
    before, after = kept["language_id"]
    assert {i for i in before if i not in after} == {i for i, t in before.items() if not re.search(r"[^\W\d_]", t or "")}

    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, after = kept["quality"]
    good = [i in after for i in before if labels.get(i) == 1]
    bad = [i in after for i in before if labels.get(i) == 0]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.4

    before, after = kept["near_duplicates"]
    sets, root = {i: shingles(t) for i, t in before.items() if i is not None}, {i: i for i in before}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if j < i and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    assert {*after} == {i for i in before if find(i) == i}

    before, after = kept["decontamination"]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    whole = {i for i, t in before.items() if any(" ".join(x.lower().split()) in " ".join(t.lower().split()) for x in items)}
    shared = {i for i, t in before.items() if any(shingles(t) & shingles(x) for x in items)}
    assert whole <= {i for i in before if i not in after} <= shared

    packed = cp.packing(spark, docs, SF).collect()
    tokens, room, n = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), defaultdict(int), defaultdict(int)
    for r in packed:
        room[r.sequence_id] += r.length
        n[r.doc_id] += r.length
    assert max(room.values()) <= 2048
    assert dict(n) == {i: len(tokens.encode(t, add_special_tokens=False).ids) + 1 for i, t in after.items()}
    assert len(room) <= 1.1 * sum(n.values()) / 2048 + 1
