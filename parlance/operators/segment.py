"""Clauses from sentences, and repeated headers and footers of a document's lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The markers that begin a new clause, in the order in which they are tried.
MARKERS = ["however,", "furthermore,", "moreover,", "in addition,", "additionally,", "in contrast,", "as a result,", "therefore,", "nevertheless", "nonetheless", "hence", "thus", "but", "meanwhile,", "similarly,", "likewise,", "rather,", "on the other hand,", "on the contrary,", "in conclusion,", "in summary,", "for example,", "for instance,", "in other words,", "provided that", "assuming that", "given that", "whereas", "even though", "although,"]
LEAST_WORDS = 3


def split_clauses(c: Column, markers: list[str] | None = None) -> Column:
    """Each marker may cut once, at its first place, if enough words are on both sides; the rest goes on."""
    from parlance.functions.text import word_count

    strip = lambda x: F.regexp_replace(x, r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$", "")
    start = F.struct(F.array().cast("array<string>").alias("out"), c.alias("rest"))

    def step(s: Column, m: Column) -> Column:
        rest = s["rest"]
        at = F.position(m, F.lower(rest))
        before, after = strip(F.substr(rest, F.lit(1), at - 1)), strip(F.substr(rest, at + F.length(m)))
        cut = (at > 1) & (word_count(before) >= LEAST_WORDS) & (word_count(after) >= LEAST_WORDS)
        return F.struct(F.when(cut, F.concat(s["out"], F.array(before))).otherwise(s["out"]).alias("out"), F.when(cut, strip(F.substr(rest, at))).otherwise(rest).alias("rest"))

    marks = F.array(*[F.lit(m) for m in (MARKERS if markers is None else markers)])
    return F.aggregate(marks, start, step, lambda s: F.concat(s["out"], F.array(strip(s["rest"]))))


def header(rows: DataFrame, share: float = 0.55, words: int = 20) -> DataFrame:
    """The words that most non-blank lines of a document begin with; ``rows``: doc_id, pos, line."""
    kept = rows.where(F.trim("line") != "")
    total = kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"))
    at = kept.select("doc_id", "pos", F.posexplode(F.slice(F.filter(F.split("line", r"[ \t\n\x0B\f\r]+"), lambda w: w != ""), 1, words)).alias("i", "word"))
    at = at.where(~F.lower("word").isin("page", "pages"))
    n = at.groupBy("doc_id", "i", "word").agg(F.count(F.lit(1)).alias("c"), F.min("pos").alias("first"))
    best = n.withColumn("r", F.row_number().over(Window.partitionBy("doc_id", "i").orderBy(F.desc("c"), "first"))).where("r = 1").join(total, "doc_id")
    ok = best.withColumn("ok", (F.col("c") / F.col("lines") >= share).cast("int"))
    run = ok.withColumn("run", F.min("ok").over(Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))).where((F.col("run") == 1))
    return run.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("header"), F.count(F.lit(1)).alias("n_words"))


def footer(rows: DataFrame, share: float = 0.55, words: int = 20) -> DataFrame:
    """The longest words that enough lines end with; then the most frequent, then the first seen."""
    kept = rows.where(F.trim("line") != "")
    total = kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"))
    w = kept.select("doc_id", "pos", F.filter(F.split("line", r"[ \t\n\x0B\f\r]+"), lambda x: x != "").alias("w"))
    tails = w.select("doc_id", "pos", "w", F.explode(F.sequence(F.lit(1), F.least(F.lit(words), F.size("w")))).alias("k"))
    tails = tails.select("doc_id", "pos", "k", F.array_join(F.slice("w", -F.col("k"), F.col("k")), " ").alias("tail"))
    n = tails.groupBy("doc_id", "k", "tail").agg(F.count(F.lit(1)).alias("c"), F.min("pos").alias("first")).join(total, "doc_id").where(F.col("c") / F.col("lines") >= share)
    return n.groupBy("doc_id").agg(F.max_by(F.struct("tail", "k", "c"), F.struct("k", "c", -F.col("first"))).alias("b")).select("doc_id", F.col("b.tail").alias("footer"), F.col("b.k").alias("n_words"), F.col("b.c").alias("n_lines"))
