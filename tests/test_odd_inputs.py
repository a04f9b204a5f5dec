"""Queries on rows that the given tables lack, against their SQL."""

import duckdb
import pandas as pd

from scriptorium import registry

registry.load()

LONG = "the same line of more than twenty characters"
TEXTS = [
    None, "", " \n　\n", f"{LONG}\nshort\n{LONG} \nshort\n\t{LONG}", f"{LONG}\r\n{LONG}\rtail\n\n{LONG}\x85",
    "第一百章 雨夜\n第二章", "-----\n本书来自某站\nhttp://abc.example\n（本章完）tail\nQQ 12345", "café é　x y 한 Å\n  end ", "\n\n1234567890123456789\n1234567890123456789\n12345678901234567890\n12345678901234567890",
    "́\n😀" + "😀" * 19 + "\n" + "😀" * 20, "a\x00b\n\x0b\x0c\x1c\n \x1f ",
]


def test_paragraphs_are_deduplicated_and_not_cleaned(spark, tmp_path):
    pd.DataFrame({"doc_id": [*range(len(TEXTS))], "text": TEXTS}).to_parquet(tmp_path / "documents.parquet")
    got = registry.QUERIES["deduplicated_paragraphs"](spark, str(tmp_path)).collect()
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{tmp_path}/documents.parquet'")
    want = db.sql(registry.ORACLES["deduplicated_paragraphs"]).fetchall()
    assert len(want) == len(TEXTS) - 3 and sorted((r["doc_id"], r["digest"]) for r in got) == sorted(want)
