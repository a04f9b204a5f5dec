import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import gru_language_model as g

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def check(rows, texts, train):
    counts = Counter(w for t in train for w in [*words(t), ""])
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        tokens = [*words(texts[r.doc_id]), ""]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(counts[w] > 0 for w in tokens), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens))
        assert r.score < 0


@pytest.mark.parametrize("lexicon", [120_000, 700])
def test_base_scores_equal_brute_force_and_the_model_beats_them(spark, monkeypatch, lexicon):
    monkeypatch.setattr(g, "LEXICON", lexicon)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", (F.col("doc_id") % 5 == 1).alias("held"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = g.language_model_scores(docs, id="doc_id", text="text", where=~F.col("held")).collect()
    assert len(rows) == len(texts)
    check(rows, texts, [t for i, t in texts.items() if i % 5 != 1])
    assert sum(r.score for r in rows if r.held) > sum(r.base_score for r in rows if r.held)


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    model, given, target = g.GRU(), rng.integers(0, g.SYMBOLS, (4, 3)), rng.integers(0, g.SYMBOLS, (4, 3))
    start = rng.uniform(-1, 1, (3, g.HIDDEN)).astype(np.float32)
    grad, _ = model.truncated(given, target, start, 7)

    def loss():
        table, h, states = model.w["embed"] @ model.w["x"] + model.w["b"], start, []
        for x in given:
            h, _ = model.step(table[x], h * (x != 7)[:, None])
            states.append(h)
        return -model.log_probabilities(np.concatenate(states), target.ravel())[0].mean()

    for name, w in model.w.items():
        i = np.unravel_index(np.abs(grad[name]).argmax(), w.shape)
        old, ends = w[i], []
        for e in (0.01, -0.01):
            w[i] = old + e
            ends.append(loss())
        w[i] = old
        assert abs((ends[0] - ends[1]) / 0.02 - grad[name][i]) < 1e-3


def test_the_output_is_a_distribution_and_windows_carry_the_state():
    model = g.GRU(seed=9)
    h = np.random.default_rng(1).uniform(-1, 1, (1, g.HIDDEN)).astype(np.float32)
    logs, _ = model.log_probabilities(np.repeat(h, g.SYMBOLS, 0), np.arange(g.SYMBOLS))
    assert np.exp(logs).sum() == pytest.approx(1, abs=1e-4)
    texts = [np.random.default_rng(n).integers(0, g.SYMBOLS, n) for n in (1, 31, 32, 33, 200)]
    texts = [np.append(t[t != 5], 5) for t in texts]  # the end stands last and nowhere else
    for text, got in zip(texts, model.score(texts, 5)):
        table, h, want = model.w["embed"] @ model.w["x"] + model.w["b"], np.zeros((1, g.HIDDEN), np.float32), 0.0
        for x, y in zip([5, *text[:-1]], text):
            h, _ = model.step(table[[x]], h)
            want += model.log_probabilities(h, np.array([y]))[0][0]
        assert got == pytest.approx(want, rel=1e-4)


def test_odd_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "a B a", 0), (3, "a B a", 0), (4, "new", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    texts = {i: t for i, t, _ in rows}
    got = g.language_model_scores(docs, id="doc_id", text="text", where=F.col("doc_id") < 4).collect()
    assert len(got) == 5
    check(got, texts, [t for i, t, _ in rows if i < 4])
    assert g.language_model_scores(docs.limit(0), id="doc_id", text="text", where=F.lit(True)).count() == 0
    assert {r.n_known for r in g.language_model_scores(docs, id="doc_id", text="text", where=F.lit(False)).collect()} == {0}


def test_columns_of_any_name_pass_through(spark):
    names = ["s", "b", "k", "_n", "_part", "_row", "_known", "_base", "_score", "_rare", "word", "c", "caller", "id", "score"]
    docs = spark.createDataFrame([(1, "a b a", *range(15)), (2, "c", *range(15))], ["doc_id", "text", *names])
    rows = g.language_model_scores(docs, id="doc_id", text="text", where=F.col("doc_id") == 1).collect()
    plain = g.language_model_scores(docs.select("doc_id", "text"), id="doc_id", text="text", where=F.col("doc_id") == 1).collect()
    assert all([r[n] for n in names[:-1]] == list(range(14)) for r in rows)
    assert {(r.doc_id, r.n_known, r.score) for r in rows} == {(r.doc_id, r.n_known, r.score) for r in plain}


def test_scores_do_not_depend_on_the_batches_that_documents_come_in(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    found = []
    for rows in (10_000, 7):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
        try:
            found.append({r.doc_id: r.score for r in g.language_model_scores(docs, id="doc_id", text="text", where=F.lit(True)).collect()})
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found[0].keys() == found[1].keys() and all(found[1][i] == pytest.approx(x, rel=1e-5) for i, x in found[0].items())


def test_units_carry_the_optimiser_on(monkeypatch):
    monkeypatch.setattr(g, "UNIT", 4000)
    rng, sizes = np.random.default_rng(2), []
    unit = g.Trainer.unit
    monkeypatch.setattr(g.Trainer, "unit", lambda self, symbols: sizes.append((len(symbols), self.updates)) or unit(self, symbols))
    own = g.Trainer(g.GRU(), 5, 0.01)
    for _ in range(100):
        own.add(rng.integers(0, g.SYMBOLS, 90))
    own.flush()
    assert own.tokens == 9000 and [n for n, _ in sizes] == [4050, 4050, 900] and sizes[0][1] == 0 and 0 < sizes[1][1] < sizes[2][1] < own.updates
