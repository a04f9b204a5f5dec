import numpy as np

from scriptorium.llm import gru_language_model as g


def test_a_fit_trains_on_every_prediction(monkeypatch):
    asked, trained = [], []
    truncated, log_probabilities = g.GRU.truncated, g.GRU.log_probabilities
    monkeypatch.setattr(g.GRU, "truncated", lambda self, x, y, *a, **k: asked.append(y.size) or truncated(self, x, y, *a, **k))
    monkeypatch.setattr(g.GRU, "log_probabilities", lambda self, h, symbols, *a, **k: trained.append(symbols.size) or log_probabilities(self, h, symbols, *a, **k))
    own = g.Trainer(g.GRU(), 7, 0.01)
    own.add(np.random.default_rng(0).integers(0, g.SYMBOLS, 5000))
    own.flush()
    assert sum(asked) and sum(trained) == sum(asked)
    assert g.SYMBOLS - g.TAILS == 960
