import random
import re

from scriptorium.llm import license_index as li

TEXTS = [
    (1, None), (2, ""), (3, "Licensed under the Apache License, Version 2.0. Apache\nlicense"), (4, "MIT license MIT LICENSE cc-by, cc by nc"),
    (5, "the gnu general public licence; GNU general-public license"), (6, "All rights reserved."), (7, "mit licenses, éapache license"), (3, "Apache license"), (8, "x " * 5000 + "apache license"),
]


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for p, label in li.BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), len(places), min([i for i, _ in places], default=None), max([i for i, _ in places], default=None), ",".join(sorted({x for _, x in places}))


def test_equals_brute_force(spark):
    docs = spark.createDataFrame(TEXTS, "labels long, text string").withColumnRenamed("labels", "doc_id")
    got = li.scan_licenses(docs, text="text").collect()
    assert sorted((r.doc_id, r.n_words, r.n_base, str(r.first_word), str(r.last_word), r.base_labels) for r in got) == sorted((i, *[str(x) if k in (2, 3) else x for k, x in enumerate(brute(t))]) for i, t in TEXTS)
    by = {r.doc_id: r for r in got if r.doc_id != 3}
    assert by[6].labels == "notice:reserved" and by[2].labels == "" and by[2].score == 0 and 0 < by[8].score <= 1
    assert li.scan_licenses(docs.limit(0), text="text").count() == 0


def plain_places(words, template, weights):
    """Every start is compared in full, without an index."""
    own, out = template.words, []
    for start in range(-len(own) + 1, len(words)):
        same = [0 <= start + i < len(words) and words[start + i] == w for i, w in enumerate(own)]
        share = sum(w for w, s in zip(weights, same) if s) / sum(weights)
        if all(same[i] for i in template.mandatory) and (template.base or share >= li.LEAST_MATCH):
            out.append((max(start, 0), round(share, 9)))
    return out


def test_the_index_loses_no_place():
    random.seed(9)
    known = li.templates()
    lexicon = sorted({w for t in known for w in t.words})
    frequency = {w: random.randrange(0, 1000) for w in lexicon}
    index = li.RareWordIndex(known, 1000, frequency)
    met = 0
    for _ in range(300):
        words = []
        for _ in range(4):
            t = random.choice(known)
            words += [random.choice(lexicon) if random.random() < 0.15 else w for w in t.words[random.randrange(2) :]]
        got = sorted((k, at, round(share, 9)) for k, at, share in index.scan(words))
        want = sorted((k, *place) for k, t in enumerate(known) for place in plain_places(words, t, index.weights[k].tolist()))
        assert got == want
        met += len(got)
    assert met > 300


def test_whole_licence_texts(spark):
    passages = [p.replace("[", "").replace("]", "") for p in li.LICENCE_TEXTS["text:mit"]]
    rows = [(1, " Copyright 2020 someone. ".join(passages)), (2, " ".join(passages[:2])), (3, " ".join(reversed(passages))), (4, "y " * 3000 + " x ".join(passages).replace("merge", "MERGED")), (4, None)]
    got = li.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), text="text").collect()
    assert [("text:mit" in r.labels.split(","), "notice:mit-text" in r.labels.split(",")) for r in sorted(got, key=lambda r: (r.doc_id, -r.n_words))] == [(True, True), (False, True), (False, True), (True, True), (False, False)]


def test_columns_of_any_name_pass_through(spark):
    docs = spark.createDataFrame([(1, "MIT license", 7, 8, "a")], "doc_id long, text string, word int, n int, score string")
    (row,) = li.scan_licenses(docs, text="text").collect()
    assert (row.doc_id, row.word, row.n, row.base_labels) == (1, 7, 8, "mit") and row.score > 0


def test_given_tables(spark):
    from scriptorium.llm.registry import op9_license_scan

    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in op9_license_scan(spark, "/root/testdata/sf0.001").collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(docs[r.doc_id])
