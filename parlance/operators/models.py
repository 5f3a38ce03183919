"""Hooks for models: each takes a function over a batch of rows, loaded once in a worker.

The stand-ins are deterministic and make no claim of quality."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.sources.tables import LABELS

Loader = Callable[[], Callable]


def classify(text: Column, previous: Column, before: Column, load: Loader) -> Column:
    """Labels of clauses; ``load`` gives a function of three lists (texts, one before, two before) to labels."""

    @F.pandas_udf("string")
    def run(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for a, b, c in parts:
            yield pd.Series(model(a.tolist(), b.tolist(), c.tolist()), dtype=object)

    return run(text, previous, before)


def embed(text: Column, load: Loader) -> Column:
    """Vectors of texts; ``load`` gives a function of a list of texts to vectors."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for part in parts:
            yield pd.Series([[float(x) for x in v] for v in model(part.tolist())], dtype=object)

    return run(text)


def rewrite(text: Column, load: Loader) -> Column:
    """Texts rewritten in batches: a translator or a summariser."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for part in parts:
            yield pd.Series(model(part.tolist()), dtype=object)

    return run(text)


def mean_pooled(vectors: Column, mask: Column) -> Column:
    """The mean of the vectors whose mask is 1, as a plug-in encoder pools its tokens; zeros where none is."""
    kept = F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda x: x["m"] == 1)
    zero = F.transform(F.element_at(vectors, 1), lambda x: x.cast("double") * 0)
    total = F.aggregate(kept, zero, lambda a, x: F.zip_with(a, x["v"], lambda p, q: p + q.cast("double")))
    return F.transform(total, lambda x: x / F.greatest(F.lit(1e-9), F.size(kept).cast("double")))


def graph_vectors(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The stand-in graph encoder: a clause's vector averaged with those of its neighbours, all documents in one join."""
    ends = pairs.select("doc_id", F.col("source").alias("clause_id"), F.col("target").alias("near")).union(pairs.select("doc_id", "target", "source")).distinct()
    own = nodes.select("doc_id", "clause_id", F.col("clause_id").alias("near"))
    near = ends.unionByName(own).distinct().join(nodes.select("doc_id", F.col("clause_id").alias("near"), "embedding"), ["doc_id", "near"])
    at = near.select("doc_id", "clause_id", F.posexplode("embedding").alias("i", "x")).groupBy("doc_id", "clause_id", "i").agg(F.avg("x").alias("x"))
    return at.groupBy("doc_id", "clause_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vector"))  # one vector


def stand_in_classifier() -> Callable[[Sequence, Sequence, Sequence], list[str]]:
    return lambda texts, *_: [LABELS[int(hashlib.md5((t or "").encode()).hexdigest()[0], 16) % len(LABELS)] for t in texts]


def stand_in_encoder() -> Callable[[Sequence], list[list[float]]]:
    return lambda texts: [[float(len(t or "")), float((t or "").count(" ")), float((t or "").count("e"))] for t in texts]


def stand_in_translator() -> Callable[[Sequence], list[str]]:
    return lambda texts: [None if t is None else t.replace("e", "3") for t in texts]
