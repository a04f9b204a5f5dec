"""Line rules on texts made for them, base measures against a plain version, and odd rows."""

import re
from collections import Counter

from scriptorium.llm.line_cleaning import Rules, clean_lines, settled
from scriptorium.llm.registry import op13_quality_rules

SF = "/root/testdata/sf0.001"
PROSE = "\n".join(" ".join(f"w{i}x{j}" for j in range(9)) + "." for i in range(8))


def base(text: str | None) -> tuple:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    inside = {i + j for i, w in enumerate(windows) if n[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    again = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(inside), len(words) < 50 or 100 * len(inside) > 50 * len(words)


def test_base_measures_of_the_query_and_labelled_texts(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = op13_quality_rules(spark, SF).collect()
    assert {r["doc_id"]: tuple(r[1:7]) for r in got} == {i: base(t) for i, t in texts.items()}
    judged = [(r["kept"], label[r["doc_id"]]) for r in got if r["doc_id"] in label and not r["base_failed"]]
    assert judged and all(kept == bool(quality) for kept, quality in judged)
    assert not any(r["kept"] for r in got if r["base_failed"])


def test_every_kind_of_rule():
    kinds = lambda text: settled(text, Rules())[7:10]
    assert kinds(PROSE) == (0, 0, 0) and settled(PROSE, Rules())[6]
    assert kinds("Home | News | Sport.\nHome » News » Sport") == (2, 0, 0)
    assert kinds("All Rights Reserved.\nAs before.\nAs before.") == (0, 2, 0)
    assert kinds("No end\nBUY!! NOW!! AND!! HERE!!\nA quoted end.”\n好的。") == (0, 0, 2)
    cut = " ".join(["Word"] * 10 + ["end."] + ["more"] * 15)
    assert kinds(cut) == (0, 0, 0)


def test_a_document_that_loses_too_much_goes_and_its_cleaned_text_is_told(spark):
    menu = "\n".join(" | ".join(f"link{i}to{j}" for j in range(9)) for i in range(12))
    df = spark.createDataFrame([("little", f"{PROSE}\n\nRead more\nHome | Help | About"), ("much", f"{PROSE}\n{menu}")], "name string, text string")
    got = {r["name"]: r for r in clean_lines(df, text="text").collect()}
    assert got["little"]["kept"] and got["little"]["cleaned"] == f"{PROSE}\n"
    assert not got["much"]["kept"] and not got["much"]["base_failed"] and got["much"]["cleaned"] == PROSE


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(60_000)) + "."
    rows = [(1, None, "a"), (2, "", "b"), (3, " \n\t\n", "c"), (4, long, "d"), (4, long, "d"), (None, "a b c a b c", None)]
    df = spark.createDataFrame(rows, "caller long, text string, kept string").withColumnRenamed("caller", "n")
    got = clean_lines(df.selectExpr("n as caller", "text", "kept", "1 as n_words"), text="text")
    assert len(set(got.columns)) == len(got.columns) and got.columns[:2] == ["caller", "text"]
    assert sorted((tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in got.collect())) == sorted(base(t) for _, t, _ in rows)
    assert all(r["kept"] == (r["n_words"] == 60_000) for r in got.collect())
    assert clean_lines(df.limit(0), text="text").isEmpty()
