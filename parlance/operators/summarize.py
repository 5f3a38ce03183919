"""Summaries from selected clauses; the rewriting model is a plug-in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import cites_precedent, guard, minimal_cleanup

LEADS = {"Fundamental Rights": "This is a Fundamental Rights application.", "Civil Appeal": "This is a civil appeal."}


def first_words(c: Column, n: int = 30) -> Column:
    """The stand-in for a rewriting model: the first words."""
    return F.array_join(F.slice(F.split(F.trim(c), r"\s+"), 1, n), " ")


def safe_rewrite(rows: DataFrame, model=first_words) -> DataFrame:
    """Clauses that cite precedents stay; others are rewritten where no guard refuses it."""
    t = F.trim(F.coalesce("text", F.lit("")))
    out = rows.withColumn("rewritten", model(t))
    why = F.when(cites_precedent(t), "precedent").otherwise(guard(t, F.col("rewritten")))
    out = out.withColumn("reason", F.coalesce(why, F.lit("accepted")))
    used = F.col("reason") == "accepted"
    return out.withColumns({"used_model": used, "final": F.when(used, minimal_cleanup(F.col("rewritten"))).otherwise(t)}).drop("rewritten")


def structured(rows: DataFrame) -> DataFrame:
    """One text for each document: a lead, numbered reasons in order, the holding; ``rows``: doc_id, case_type, doc_order, final, holding."""
    agg = rows.groupBy("doc_id", "case_type").agg(F.array_sort(F.collect_list(F.when(~F.col("holding"), F.struct("doc_order", "final")))).alias("bullets"), F.max_by("final", F.when(F.col("holding"), F.col("doc_order"))).alias("held"))  # k clauses at most
    lead = F.lit(None).cast("string")
    for k, v in LEADS.items():
        lead = F.when(F.col("case_type") == k, v).otherwise(lead)
    body = F.array_join(F.transform("bullets", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["final"])), "\n")
    held = F.when(F.col("held").isNotNull(), F.concat(F.lit("\nHolding: "), F.col("held"))).otherwise("")
    return agg.select("doc_id", F.concat(lead, F.lit("\n"), body, held).alias("summary"), F.size("bullets").alias("n_bullets"))
