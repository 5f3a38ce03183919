"""Files between stages: texts, clause records, graphs, rankings, pairs and vectors.

Every sink writes one record for each document with Spark's own writers, so a stage can be run
again and read from any node; every source has an explicit schema and drops what it cannot read."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions.text import BODY_MARK
from parlance.runtime import checkpoint_folder

CLAUSE = "struct<clause_id:int,text:string,prev_text:string,next_text:string,prev_text_1:string>"
LABELLED = "struct<clause_id:int,text:string,label:string>"
CLAUSE_FILE = f"doc_id bigint, clauses array<{CLAUSE}>"
LABELLED_FILE = f"doc_id bigint, clauses array<{LABELLED}>"
GRAPH_FILE = "doc_id bigint, nodes array<struct<id:int,text:string,label:string,idx:int>>, edges array<struct<source:int,target:int,relation:string,score:double>>"
OCR_PAGES = "map<string,array<struct<text_lines:array<struct<text:string>>>>>"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder beside the session's checkpoints, which all executors share."""
    checkpoint_folder(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def ocr_text(c: Column) -> Column:
    """The lines of an OCR result (pages of samples of lines) joined by spaces, blank ones left out."""
    samples = F.flatten(F.map_values(F.from_json(c, OCR_PAGES)))
    lines = F.flatten(F.transform(samples, lambda s: F.coalesce(s["text_lines"], F.array().cast("array<struct<text:string>>"))))
    return F.array_join(F.filter(F.transform(lines, lambda x: F.trim(x["text"])), lambda x: x != ""), " ")


def stem(path: Column) -> Column:
    """The file name without folders and its last suffix."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def next_name(path: Column, old: str, new: str) -> Column:
    """A path for the next stage: suffix ``old`` becomes ``new``; others get ``new`` in place of their last suffix."""
    quoted = "".join(f"\\{x}" if x in ".[](){}*+?^$|" else x for x in old)
    return F.when(path.endswith(old), F.regexp_replace(path, f"{quoted}$", new)).otherwise(F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit(new)))


def write_texts(docs: DataFrame, path: str) -> None:
    """One folder for each bucket of documents, a JSON line for each text."""
    docs.select("doc_id", "text").write.json(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole texts of all files below a folder: path and text."""
    rows = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def annotation_parts(c: Column) -> Column:
    """metadata and body lines of an annotation file; the mark counts without spaces and case, without it everything is body."""
    lines = F.split(c, "\n")
    mark = BODY_MARK.replace(" ", "").lower()
    at = F.array_position(F.transform(lines, lambda x: F.lower(F.regexp_replace(x, r"\s", ""))), F.lit(mark))
    kept = lambda x: F.filter(F.transform(x, lambda y: F.trim(y)), lambda y: y != "")
    none = F.array().cast("array<string>")
    meta = F.when(at > 1, F.slice(lines, 1, F.greatest(F.lit(0), at.cast("int") - 1))).otherwise(none)
    body = F.slice(lines, at.cast("int") + 1, F.greatest(F.lit(0), F.size(lines)))
    return F.struct(kept(meta).alias("meta"), kept(body).alias("body"))


def clause_records(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One record for each document with its clauses in order; documents without clauses have none."""
    one = F.array_sort(F.collect_list(F.struct("clause_id", *[c for c in columns if c != "clause_id"])))  # one document
    return rows.groupBy("doc_id").agg(one.alias("clauses"))


def read_annotated(spark: SparkSession, path: str) -> DataFrame:
    """Clauses of annotated records; undecodable records and clauses without text or label are dropped."""
    rows = spark.read.schema(LABELLED_FILE).option("mode", "DROPMALFORMED").json(path)
    return rows.select("doc_id", F.explode("clauses").alias("c")).select("doc_id", "c.*").where("text is not null and trim(text) <> '' and label is not null")


def graph_records(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes and edges of a document as one record."""
    n = nodes.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("clause_id").alias("id"), "text", "label", "idx"))).alias("nodes"))  # one document
    e = edges.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("source", "target", "relation", "score"))).alias("edges"))
    return n.join(e, "doc_id", "left").withColumn("edges", F.coalesce("edges", F.array().cast("array<struct<source:int,target:int,relation:string,score:double>>")))


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    rows = spark.read.schema(GRAPH_FILE).json(path)
    return rows.select("doc_id", F.explode("nodes").alias("n")).select("doc_id", "n.*"), rows.select("doc_id", F.explode("edges").alias("e")).select("doc_id", "e.*")


def preferred(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Rows of ``first``, and those of ``second`` whose key it lacks."""
    return first.unionByName(second.join(first.select(key).distinct(), key, "left_anti"))


def by_hash(key: Column, share: float = 0.2, seed: int = 42) -> Column:
    """test or train by a hash of the key: the same rows in every run and engine."""
    digit = F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f"-{seed}"))), 1, 6), 16, 10).cast("long")
    return F.when(digit < int(share * (1 << 24)), "test").otherwise("train")
