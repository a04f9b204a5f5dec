"""The cleaning chain of raw texts, line by line and paragraph by paragraph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as tx
from scriptorium.sources.tables import composed

#: Characters from which a paragraph that was seen before is left out.
LEAST_REPEATED = 20


def joined(key: str, value: str, when: Column, by: str) -> Column:
    """The values of the rows that ``when`` holds for, in the order of ``key``."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(when, F.struct(key, value)))), lambda x: x[value]), by)


def without_repeats(paragraphs: DataFrame) -> DataFrame:
    """(id, text): the paragraphs (id, paragraph, body) of a text in their order, one blank line apart, without blank ones; of
    those with ``LEAST_REPEATED`` characters or more the first of each stays."""
    nth = F.row_number().over(Window.partitionBy("id", "body").orderBy("paragraph"))
    stays = (F.col("body") != "") & ((F.col("nth") == 1) | (F.length("body") < LEAST_REPEATED))
    return paragraphs.withColumn("nth", nth).groupBy("id").agg(joined("paragraph", "body", stays, "\n\n").alias("text"))


def cleaned(texts: DataFrame, *, id: str, text: str) -> DataFrame:
    """(id, text): line endings, NFC, boilerplate lines and parts, repeated paragraphs, headings in digits, white space.

    A paragraph is a run of lines that are not blank; of those with ``LEAST_REPEATED`` characters or more the first of each
    stays.  Paragraphs of the result are one blank line apart, lines have no white space at their ends, and there are no
    blank lines at the ends of a text.  Null texts are empty, a null id is an id, texts of a repeated id are cleaned as one
    in an arbitrary order, other columns are left out.  The rows of a text meet once, at its id.
    """
    plain = tx.normalize_line_endings(F.coalesce(F.col(text), F.lit("")))
    lines = texts.select(F.col(id).alias("id"), plain.alias("plain")).select("id", F.posexplode(F.split("plain", "\n")).alias("i", "line"))
    lines = lines.select("id", "i", composed(F.col("line")).alias("line"))  # nothing composes with a line's end
    # A boilerplate line goes without a trace; one whose parts are cut out may be blank afterwards.
    lines = lines.select("id", "i", F.when(~tx.is_boilerplate(F.col("line")), F.col("line")).alias("line"))
    lines = lines.select("id", "i", tx.stripped(F.translate(tx.strip_boilerplate(F.col("line")), "　", " ")).alias("line"))
    by_place = Window.partitionBy("id").orderBy("i")
    lines = lines.withColumn("paragraph", F.sum(F.coalesce((F.col("line") == "").cast("int"), F.lit(0))).over(by_place))
    paragraphs = lines.groupBy("id", "paragraph").agg(joined("i", "line", F.col("line") != "", "\n").alias("body"))
    whole = without_repeats(paragraphs)
    return whole.select(F.col("id").alias(id), tx.arabic_headings(F.col("text")).alias(text))
