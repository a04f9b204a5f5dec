import hashlib

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import text as tx
from scriptorium.operators.cleaning import cleaned
from scriptorium.sources import tables as tb


def apply(spark, f, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


def test_numerals(spark):
    assert apply(spark, tx.numeral_value, "一百二十三", "一千零五", "十", "二十", "一万二千", "三亿零七", "42", "两百", "拾贰") == [123, 1005, 10, 20, 12000, 300_000_007, 42, 200, 12]


def test_headings(spark):
    lines = ["第一百二十三章 雨夜", "第12章 告别", "楔子", "第3节课", "1、重生", "1、2、3", "12 第二章", "普通的一行", None]
    assert apply(spark, tx.is_heading, *lines) == [False, True, True, False, True, False, False, False, None]
    assert apply(spark, tx.arabic_headings, "第一百二十三章 雨夜\n见第二 回和第十章", "第三卷", None) == ["第123章 雨夜\n见第2 回和第10章", "第三卷", None]


def test_chapter_types(spark):
    assert apply(spark, tx.chapter_type, "后记", "完本感言", "番外 一", "PS：请假", "第一章 后记之谜", "雨夜") == ["afterword", "afterword", "extra", "author_note", "normal", "normal"]


def clean(spark, *texts):
    rows = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "n int, t string, line string, paragraph int")
    return [r["t"] for r in cleaned(rows, id="n", text="t").orderBy("n").collect()]


def test_cleaning_is_idempotent_and_drops_boilerplate(spark):
    text = "第一章 开始\r\n=====\r\n  正文一　\r\r\n\n\n\n（本章完）\n请记住本站网址\nhttp://abc.example\n正文二本章完\n第二章 结束"
    once = clean(spark, text)[0]
    assert once == "第1章 开始\n正文一\n\n正文二\n第2章 结束"
    assert clean(spark, once)[0] == once
    fish = ["鱼在水里游。", "他钓到一条大鱼\n鱼很大", "plain\r\n text \n\n\n\nend", None, "", " \n\n", "=====\n本章完"]
    assert clean(spark, *fish) == [*fish[:2], "plain\ntext\n\nend", "", "", "", ""]
    assert clean(spark, "a 鼱鼱 b\n锞 line") == ["a  b"]
    assert clean(spark) == []


def test_cleaning_of_indented_texts_and_repeated_paragraphs(spark):
    assert clean(spark, "　　本书来自某站\n　　推荐收藏\n　正文。", "第１２章 风起", "第　十二　章 风起") == ["正文。", "第１２章 风起", "第 12 章 风起"]
    assert apply(spark, tx.is_heading, "第１２章 风起", "第 12 章 风起", "１２　风起云涌") == [True, True, True]
    assert apply(spark, tx.non_blank_length, "　　本书 来自\u00a0某站") == [6]
    long = "这是一段足够长的文字，" * 3
    assert clean(spark, f"{long}\n\nshort\n\n　{long}　\n\nshort\n\n\n{long}\nmore") == [f"{long}\n\nshort\n\nshort\n\n{long}\nmore"]
    assert clean(spark, "e\u0301te\u0301 " * 9 + "\n\n" + "été " * 9) == [("été " * 9).strip()]


def test_tokens_and_similarity(spark):
    assert apply(spark, tx.search_tokens, "雨夜告别 Rain") == [["雨夜告别 rain", "雨夜告别", "rain", "雨夜", "夜告", "告别"]]
    assert apply(spark, tx.query_terms, "雨夜 in Rain") == [["雨夜 in Rain", "雨夜", "in", "Rain"]]
    assert apply(spark, lambda c: tx.trigram_similarity(c, F.lit("rain")), "rain", "train", "", "zzz") == pytest.approx([1.0, 3 / 8, 0.0, 0.0])
    slugs = apply(spark, lambda c: tx.slug(F.lit("org"), c), "Red Moon!", "红月")
    assert slugs == ["org_red_moon", "org_" + hashlib.sha1("红月".encode()).hexdigest()[:8]]


def test_redaction(spark):
    got = apply(spark, tx.redact, "Bearer abc.def x", "my sk-12345678", "postgresql://u:p@h/db", "password = hunter2; ok", "a\nb\x1b")
    assert got == ["Bearer [REDACTED] x", "my [REDACTED]", "postgresql://[REDACTED]@h/db", "password=[REDACTED]; ok", "a b"]
    keyed = apply(spark, lambda c: F.map_values(tx.redact_map(F.create_map(F.lit("api_key"), c, F.lit("my_secret"), c, F.lit("note"), c))), "x")
    assert keyed == [["[REDACTED]", "[REDACTED]", "x"]]


def test_raw_files_in_several_encodings(spark, tmp_path):
    for name, data in (("a", "雨夜".encode()), ("b", "雨夜".encode("gb18030"))):
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: r.text for r in tb.read_raw(spark, str(tmp_path)).collect()}
    assert got == {"a": "雨夜", "b": "雨夜"}


def test_composition(spark):
    assert apply(spark, tb.composed, "é", None) == ["é", None]
