import numpy as np
from pyspark.sql import functions as F

from scriptorium.llm import byte_cnn as bc


def test_chunks_cover_every_byte_and_overlap():
    for n in (0, 1, bc.CHUNK, bc.CHUNK + 1, 5000):
        text = bytes(i % 251 for i in range(n))
        chunks = bc.chunks_of(text)
        seen = {i * bc.STEP + k for i in range(len(chunks)) for k in range(bc.CHUNK)}
        assert set(range(n)) <= seen and (n == 0) == (chunks == bc.PAD).all()


def test_gradients_equal_differences():
    model = bc.ByteCNN()
    model.training = True
    cut = [bc.chunks_of(t) for t in (b"hello world this is", b"abc" * 300, b"")]
    doc, chunks, y = np.repeat([0, 1, 2], [len(c) for c in cut]), np.concatenate(cut), np.array([1, 0, 1.0])
    grad = model.gradients(chunks, doc, y)

    def loss():
        p, _ = model.forward(chunks, doc, 3)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for name in ("embed", "filter", "hidden", "hidden_bias", "out", "out_bias"):
        w = model.weights[name]
        i = np.unravel_index(np.abs(grad[name]).argmax(), w.shape)
        old, ends = w[i], []
        for e in (0.001, -0.001):
            w[i] = old + e
            ends.append(loss())
        w[i] = old
        assert abs((ends[0] - ends[1]) / 0.002 - grad[name][i]) < 2e-3


def test_scores_do_not_depend_on_the_batch():
    model, texts = bc.ByteCNN(), [b"", b"a", b"xyz " * 2000, b"\xff\xfe"]
    assert np.allclose(model.score(texts), [model.score([t])[0] for t in texts], atol=1e-6)


def test_held_out_accuracy_and_odd_rows(spark):
    from scriptorium.llm.registry import op2_quality_classifier

    sf = "/root/testdata/sf0.01"
    got = op2_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) >= 0.85
    docs = spark.createDataFrame([(1, None, 3), (2, "", 3), (3, "a" * 100_000, 3), (3, "a" * 100_000, 3)], "doc_id long, text string, score int")
    out = bc.score_quality(docs, bc.ByteCNN(), text="text").orderBy("doc_id").collect()
    assert len(out) == 4 and all(0 <= r.score <= 1 for r in out) and out[0].score == out[1].score and out[2] == out[3]
    labels = spark.createDataFrame([(9, None)], "doc_id long, quality int")
    assert bc.learn_quality(docs, labels, id="doc_id", text="text", label="quality", where=F.lit(True)).weights["out"].shape == (32,)
    assert bc.score_quality(docs.limit(0), bc.ByteCNN(), text="text").count() == 0
