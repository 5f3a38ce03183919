"""The document cleaner: repeated headers and footers, page numbers and markup out of every line, twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parlance.functions.text import edge_numbers, keep_safely, page_line, squeeze, strip_html, strip_latex
from parlance.operators import segment

PASSES, SHARE, WORDS = 2, 0.55, 20
_DASHES = "[-\u2013\u2014:]*"


def _literal(c: Column) -> Column:
    """A text as a pattern that matches just it."""
    return F.regexp_replace(c, r"([^\p{L}\p{N}\s_])", r"\\$1")


def _without(line: Column, edge: Column, inside: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(line, edge, F.lit("")), inside, F.lit(""))


def repeated_ends(lines: DataFrame, share: float = SHARE, words: int = WORDS) -> DataFrame:
    """doc_id, header and footer of documents that have either, found on lines without markup and page numbers.

    Of more than two lines the first is left out.  ``lines``: doc_id, pos, line."""
    plain = lines.select("doc_id", "pos", strip_html(F.col("line")).alias("line"))
    bare = plain.select("doc_id", "pos", F.when(page_line(F.col("line")), "").otherwise(F.trim(edge_numbers(F.col("line")))).alias("line"), F.monotonically_increasing_id().alias("_row"))
    bare = bare.where("line <> '' and _row >= 0")
    by_doc = Window.partitionBy("doc_id")
    bare = bare.withColumns({"n": F.count(F.lit(1)).over(by_doc), "first": F.min("pos").over(by_doc)}).where("n <= 2 or pos > first").select("doc_id", "pos", "line")
    head, foot = segment.header(bare, share, words).select("doc_id", "header"), segment.footer(bare, share, words).select("doc_id", "footer")
    return head.join(foot, "doc_id", "full")


def clean_pass(rows: DataFrame) -> DataFrame:
    """One pass over lines (doc_id, pos, line, header, footer); each step is a column of its own, so that it is computed once."""
    steps = rows.withColumn("_cut", strip_latex(strip_html(F.col("line"))))
    ends = (("header", lambda m: F.concat(F.lit(r"(?i)^\s*"), m, F.lit(rf"\s*{_DASHES}\s*"))), ("footer", lambda m: F.concat(F.lit(rf"(?i)\s*{_DASHES}\s*"), m, F.lit(r"\s*$"))))
    for name, edge in ends:
        own = _literal(F.col(name))
        steps = steps.withColumn("_cut", F.when(F.col(name).isNotNull(), _without(F.col("_cut"), edge(own), F.concat(F.lit(r"(?i)\b"), own, F.lit(r"\b")))).otherwise(F.col("_cut")))
    steps = steps.withColumn("_cut", edge_numbers(F.col("_cut"))).withColumn("_cut", squeeze(F.col("_cut")))
    kept = keep_safely(F.col("line"), F.lit(""))
    gone = page_line(F.col("_cut")) | (F.col("_cut") == "")
    # The row number keeps Catalyst from copying all steps into a filter below them.
    out = steps.withColumns({"_kept": F.when(gone, kept).otherwise(F.col("_cut")), "_row": F.monotonically_increasing_id()}).where("_kept <> '' and _row >= 0")
    return out.select("doc_id", "pos", F.col("_kept").alias("line"), "header", "footer")


def clean(lines: DataFrame, passes: int = PASSES) -> DataFrame:
    """doc_id, pos and line of what remains; ``lines``: doc_id, pos, line.  Null lines go."""
    out = lines.select("doc_id", "pos", "line").join(repeated_ends(lines), "doc_id", "left")
    for _ in range(passes):
        out = clean_pass(out)
    return out.select("doc_id", "pos", "line")


def joined(lines: DataFrame) -> DataFrame:
    """doc_id and text: a document's own lines in order."""
    rows = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))  # one document
    return rows.select("doc_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))
