"""Clause context, label distributions, splits and balancing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parlance.runtime import checkpointed
from parlance.sources.tables import LABELS


def with_context(rows: DataFrame, key: str = "doc_id", order: str = "clause_id") -> DataFrame:
    """The texts one and two before and one after; null at the edges."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumns({"prev_text": F.lag("text", 1).over(w), "prev_text_1": F.lag("text", 2).over(w), "next_text": F.lead("text", 1).over(w)})


def context_string(rows: DataFrame) -> DataFrame:
    """The classifier's input: marked context, blank parts left out."""
    part = lambda mark, c: F.when(F.trim(c) != "", F.concat(F.lit(mark), F.trim(c)))
    return rows.withColumn("input", F.concat_ws(" ", part("[PREV_1] ", "prev_text_1"), part("[PREV] ", "prev_text"), part("[CURRENT] ", "text")))


def label_distribution(rows: DataFrame, domain: tuple[str, ...] = LABELS) -> DataFrame:
    """Count and percent of every label of the domain, absent ones too."""
    spark = rows.sparkSession
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    every = spark.createDataFrame([(x,) for x in domain], "label string")
    out = F.broadcast(every).join(counts, "label", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("percent", F.round(100 * F.col("n") / F.nullif(F.sum("n").over(Window.partitionBy()), F.lit(0)), 2))


def corpus_rollup(rows: DataFrame) -> DataFrame:
    return rows.rollup("label").agg(F.count(F.lit(1)).alias("clauses"), F.countDistinct("doc_id").alias("documents"))


def class_weights(rows: DataFrame, domain: tuple[str, ...] = LABELS) -> DataFrame:
    """total / (classes * count); 1.0 for an absent class."""
    n = label_distribution(rows, domain)
    return n.select("label", "n", F.round(F.when(F.col("n") > 0, F.sum("n").over(Window.partitionBy()) / (len(domain) * F.col("n"))).otherwise(1.0), 6).alias("weight"))


def split_documents(docs: DataFrame, train: float = 0.7, val: float = 0.15, seed: int = 42) -> DataFrame:
    """Train, val or test for each distinct document by the order of a hash; no document is in two."""
    ids = docs.select("doc_id").distinct().withColumn("h", F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(f"-{seed}"))))
    ranked = ranks(ids, "h")
    n = F.col("n")
    at = F.when(F.col("rank") <= F.floor(n * train), "train").when(F.col("rank") <= F.floor(n * train) + F.floor(n * val), "val").otherwise("test")
    return ranked.select("doc_id", at.alias("part"))


def ranks(rows: DataFrame, key: str, buckets: int = 4096) -> DataFrame:
    """Global ranks from 1 by a hex hash, without putting all rows into one task.

    Rows are ranked inside the ranges of the hash's first digits; the ranges' counts give
    where each begins."""
    bucketed = rows.withColumn("bucket", F.substring(key, 1, 3))
    starts = bucketed.groupBy("bucket").agg(F.count(F.lit(1)).alias("c"))
    total = Window.partitionBy().orderBy("bucket")  # at most 4096 rows
    starts = starts.select("bucket", (F.sum("c").over(total) - F.col("c")).alias("start"), F.sum("c").over(Window.partitionBy()).alias("n"))
    inside = F.row_number().over(Window.partitionBy("bucket").orderBy(key))
    return bucketed.withColumn("r", inside).join(F.broadcast(starts), "bucket").withColumn("rank", F.col("start") + F.col("r")).drop("bucket", "r", "start")


def ordered_ranks(rows: DataFrame, key: str) -> DataFrame:
    """Global ranks from 1 in the order of any key, without putting all rows into one task.

    Rows are sorted inside ranges of the key, which are kept; the ranges' counts give where
    each begins."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The high bits of the id are the range, the low 33 bits the place in it.
    kept = checkpointed(rows.repartitionByRange(n, key).sortWithinPartitions(key).withColumn("at", F.monotonically_increasing_id()))
    kept = kept.withColumns({"bucket": F.shiftright("at", 33), "r": F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1})
    counts = kept.groupBy("bucket").agg(F.count(F.lit(1)).alias("c"))
    starts = counts.select("bucket", (F.sum("c").over(Window.partitionBy().orderBy("bucket")) - F.col("c")).alias("start"))  # a row for each range
    return kept.join(F.broadcast(starts), "bucket").withColumn("rank", F.col("start") + F.col("r")).drop("bucket", "at", "r", "start")


def upsample(rows: DataFrame) -> DataFrame:
    """Every label repeated to the count of the largest: whole repeats, then the first rows by hash."""
    h = F.md5(F.concat_ws("-", F.col("doc_id").cast("string"), F.col("clause_id").cast("string")))
    hashed = rows.withColumn("h", h).withColumn("bucket", F.substring("h", 1, 3))
    # Ranks inside the ranges of the hash's first digits, as in ``ranks``: 4096 rows a label at most.
    starts = hashed.groupBy("label", "bucket").agg(F.count(F.lit(1)).alias("b"))
    by_label = Window.partitionBy("label")
    starts = starts.select("label", "bucket", (F.sum("b").over(by_label.orderBy("bucket")) - F.col("b")).alias("start"), F.sum("b").over(by_label).alias("c"))
    starts = starts.withColumn("most", F.max("c").over(Window.partitionBy()))
    inside = F.row_number().over(Window.partitionBy("label", "bucket").orderBy("h"))
    joined = hashed.withColumn("r", inside).join(F.broadcast(starts), ["label", "bucket"]).withColumn("r", F.col("start") + F.col("r"))
    times = F.floor(F.col("most") / F.col("c")) + F.when(F.col("r") <= F.col("most") % F.col("c"), 1).otherwise(0)
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1), times.cast("int")))).drop("h", "bucket", "start", "c", "most", "r")


def undone(candidates: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return candidates.join(done, key, "left_anti")
