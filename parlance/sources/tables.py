"""Input tables, and the stand-ins that turn them into clauses, labels and fixtures.

Labels and embeddings of clauses come from models that are not part of this library; the
stand-ins here are deterministic and named as such.  No quality claim follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LABELS = ("Premise", "None", "Opposition", "Claim")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, pos (from 1) and line of every line of every text."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("pos", F.col("pos") + 1)


def numbered(rows: DataFrame, order: str = "pos") -> DataFrame:
    """Clauses numbered from 1 in document order; blank lines are dropped."""
    w = Window.partitionBy("doc_id").orderBy(order)
    return rows.where(F.trim("line") != "").select("doc_id", F.row_number().over(w).alias("clause_id"), F.trim("line").alias("text"))


def stand_in_label() -> Column:
    """The stand-in classifier: a label by arithmetic on document and clause."""
    return F.element_at(F.array(*[F.lit(x) for x in LABELS]), ((F.col("doc_id") * 7 + F.col("clause_id")) % 4 + 1).cast("int"))


def clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(lines(table(spark, sf_dir, "documents"))).withColumn("label", stand_in_label())


def labelled_nodes(rows: DataFrame) -> DataFrame:
    """Graph nodes: clauses with a label other than None (a missing one counts as None), ``idx`` from 0 in document order."""
    kept = rows.where(F.coalesce("label", F.lit("None")) != "None")
    return kept.withColumn("idx", F.row_number().over(Window.partitionBy("doc_id").orderBy("clause_id")) - 1)


def stand_in_embeddings(nodes: DataFrame, vectors: DataFrame) -> DataFrame:
    """The stand-in encoder: a row of the ``embeddings`` table by arithmetic on document and clause."""
    n = vectors.select(F.count(F.lit(1)).alias("n_vec"))
    keyed = nodes.crossJoin(F.broadcast(n)).withColumn("vec_id", (F.col("doc_id") * 31 + F.col("clause_id")) % F.col("n_vec"))  # one row
    return keyed.join(vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")), "vec_id").drop("n_vec", "vec_id")


def case_id() -> Column:
    """Stand-in document names that carry a case type."""
    return F.concat(F.when(F.col("doc_id") % 2 == 0, "SC_FR_").otherwise("SC_CA_"), F.col("doc_id").cast("string"), F.lit("_2010"))


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)
