import numpy as np
from pyspark.sql import functions as F

from scriptorium.llm import language_profiles as lp

ROWS = [(i, t, l) for i, (t, l) in enumerate([("the thing that is there with them", "en"), ("der die das und nicht ein schön", "de"), ("une élève avec les mentions eaux", "fr")] * 20)]


def slow_vector(text):
    """Brute force: bind and bundle a trigram at a time."""
    numbers, out = [0], np.zeros(lp.DIMENSIONS)
    for c in text.lower():
        n = int(lp.letter_numbers()[ord(c)])
        if n or numbers[-1]:
            numbers.append(n)
    if numbers[-1]:
        numbers.append(0)
    v = lp.letter_vectors().astype(int)
    for a, b, c in zip(numbers, numbers[1:], numbers[2:]):
        if b:
            out += v[0][a] * v[1][b] * v[2][c]
    return out


def test_vectors_equal_brute_force():
    texts = ["Hello, wörld!  x", "", "123 ...", "a", "éa  b", "中文 text"]
    vectors, known = lp.document_vectors(texts)
    assert known.tolist() == [True, False, False, True, True, True]
    for text, vector in zip(texts, vectors):
        assert np.allclose(vector, slow_vector(text))


def test_rows(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    prototypes = lp.learn_prototypes(docs, text="text", lang="lang", where=F.lit(True))
    asked = spark.createDataFrame([(1, None, 5.0), (2, " 12 !", 5.0), (3, "the thing with that", 5.0), (4, "die nicht und das", 5.0), (4, "die nicht und das", 5.0)], "doc_id long, text string, score double")
    got = [(r.doc_id, r.lang_pred) for r in lp.identify_language(asked, prototypes, text="text").orderBy("doc_id").collect()]
    assert got == [(1, "und"), (2, "und"), (3, "en"), (4, "de"), (4, "de")]
    assert {r.lang_pred for r in lp.identify_language(asked, {}, text="text").collect()} == {"und"}
    assert lp.identify_language(asked.limit(0), prototypes, text="text").count() == 0
    assert lp.learn_prototypes(docs.limit(0), text="text", lang="lang", where=F.lit(True)) == {}


def test_held_out_accuracy(spark):
    from scriptorium.llm.registry import op5_language_id

    got = op5_language_id(spark, "/root/testdata/sf0.001").join(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() >= 0.95 * got.count()
