import random

import public_tokenizers
from tokenizers import Tokenizer

from scriptorium.llm import token_transducer as tt

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b", "'", "'s", "'re", "'ll", "'t", " ", "  ", "\n", "\t", "1", "²", "é", "!", "<|endoftext|>", "中文", "😀", "the", "\x1c", "\x85", " ", "I'", "́"]


def library(texts):
    return [len(e.ids) for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


def test_equals_library_on_random_and_long_texts():
    random.seed(3)
    texts = ["".join(random.choice(PARTS) for _ in range(random.randrange(40))) for _ in range(3000)]
    texts += ["", "a" * 3000, " " * 400 + "x", "''''s", "ab" * 2000, "x" * 65, "x" * 64]
    assert tt.count_tokens(texts, PATH).tolist() == library(texts)


def test_state_maps_compose_over_chunk_edges():
    for n in (127, 128, 129, 257, 1025):
        text = ("it's we've  x\n" * n)[:n]
        assert tt.count_tokens([text], PATH).tolist() == library([text])


def test_rows_with_nulls_clashing_names_and_repeats(spark):
    rows = [(1, None, 7), (2, "", 7), (3, "Hello  world", 7), (3, "Hello  world", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = [tuple(r) for r in tt.annotate_token_counts(docs, text="text", tokenizer=PATH, limit=2).select("doc_id", "n_bytes", "n_tokens", "over_limit").orderBy("doc_id").collect()]
    assert got == [(1, 0, 0, False), (2, 0, 0, False), (3, 12, 3, True), (3, 12, 3, True)]
    assert tt.annotate_token_counts(docs.limit(0), text="text", tokenizer=PATH).count() == 0
