"""Centrality in the graphs of many documents at once."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parlance.runtime import checkpointed

ALPHA = 0.85


def by_max(c: str, key: str = "doc_id"):
    """Divided by the greatest of the document; 0 where that is 0."""
    top = F.max(c).over(Window.partitionBy(key))
    return F.when(top > 0, F.col(c) / top).otherwise(0.0)


def degrees(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """In, out and total degree in the simple digraph, each divided by the document's greatest."""
    out = pairs.groupBy("doc_id", F.col("source").alias("clause_id")).agg(F.count(F.lit(1)).alias("out_degree"))
    into = pairs.groupBy("doc_id", F.col("target").alias("clause_id")).agg(F.count(F.lit(1)).alias("in_degree"))
    d = nodes.select("doc_id", "clause_id").join(out, ["doc_id", "clause_id"], "left").join(into, ["doc_id", "clause_id"], "left").na.fill(0)
    d = d.withColumn("degree", F.col("in_degree") + F.col("out_degree"))
    return d.select("doc_id", "clause_id", *[F.round(by_max(c), 6).alias(c) for c in ("in_degree", "out_degree", "degree")])


def support(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Incoming supporting and opposing edges of the multigraph, and s / (s + o + 1)."""
    c = edges.groupBy("doc_id", F.col("target").alias("clause_id")).agg(F.count_if(F.col("relation") == "green_support").alias("support_in"), F.count_if(F.col("relation") == "red_opposes").alias("opposition_in"))
    d = nodes.select("doc_id", "clause_id").join(c, ["doc_id", "clause_id"], "left").na.fill(0)
    return d.withColumn("support_ratio", F.round(F.col("support_in") / (F.col("support_in") + F.col("opposition_in") + 1), 6))


def premise_support(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Supporting edges from a Premise to a Claim by their source, divided by the document's greatest."""
    label = lambda end: nodes.select("doc_id", F.col("clause_id").alias(end), F.col("label").alias(f"l_{end}"))
    found = edges.where("relation = 'green_support'").join(label("source"), ["doc_id", "source"]).join(label("target"), ["doc_id", "target"])
    c = found.where("l_source = 'Premise' and l_target = 'Claim'").groupBy("doc_id", F.col("source").alias("clause_id")).agg(F.count(F.lit(1)).alias("premise_support"))
    d = nodes.select("doc_id", "clause_id").join(c, ["doc_id", "clause_id"], "left").na.fill(0)
    return d.select("doc_id", "clause_id", F.round(by_max("premise_support"), 6).alias("premise_support"))


def pagerank(nodes: DataFrame, pairs: DataFrame, iterations: int, alpha: float = ALPHA) -> DataFrame:
    """Weighted PageRank of every document's graph, all documents in one join per iteration, checkpointed.

    Dangling nodes give their rank to all nodes of the document."""
    ids = nodes.select("doc_id", "clause_id").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("doc_id")))
    share = pairs.withColumn("p", F.col("weight") / F.sum("weight").over(Window.partitionBy("doc_id", "source"))).select("doc_id", "source", "target", "p")
    share = checkpointed(share)
    ids = ids.join(share.select("doc_id", F.col("source").alias("clause_id"), F.lit(False).alias("dangling")).distinct(), ["doc_id", "clause_id"], "left").withColumn("dangling", F.coalesce("dangling", F.lit(True)))
    ranks = ids.withColumn("rank", 1 / F.col("n"))
    for _ in range(iterations):
        ranks = checkpointed(ranks)
        sent = share.join(ranks.select("doc_id", F.col("clause_id").alias("source"), "rank"), ["doc_id", "source"]).groupBy("doc_id", F.col("target").alias("clause_id")).agg(F.sum(F.col("rank") * F.col("p")).alias("got"))
        lost = F.sum(F.when(F.col("dangling"), F.col("rank")).otherwise(0.0)).over(Window.partitionBy("doc_id"))
        ranks = ranks.withColumn("lost", lost).join(sent, ["doc_id", "clause_id"], "left").select("doc_id", "clause_id", "n", "dangling", (alpha * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / F.col("n")) + (1 - alpha) / F.col("n")).alias("rank"))
    return ranks.select("doc_id", "clause_id", F.round(by_max("rank"), 6).alias("pagerank"))


def converged_pagerank(nodes: DataFrame, pairs: DataFrame, alpha: float = ALPHA, most: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """PageRank until the change is under ``tolerance`` for each node: a document's graph is iterated where it lies."""
    ids = nodes.groupBy("doc_id").agg(F.collect_list("clause_id").alias("ids"))  # one document's clauses
    es = pairs.groupBy("doc_id").agg(F.collect_list(F.struct("source", "target", "weight")).alias("es"))
    kind = nodes.schema["doc_id"].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples():
                own = list(row.ids)
                n, rank = len(own), dict.fromkeys(own, 1 / len(own))
                out: dict = {}
                for e in row.es if row.es is not None else ():
                    out.setdefault(e["source"], []).append((e["target"], e["weight"]))
                sums = {s: sum(w for _, w in to) for s, to in out.items()}
                for _ in range(most):
                    last, rank = rank, dict.fromkeys(own, 0.0)
                    lost = sum(last[v] for v in own if v not in out)
                    for s, to in out.items():
                        for t, w in to:
                            rank[t] += alpha * last[s] * w / sums[s]
                    for v in own:
                        rank[v] += alpha * lost / n + (1 - alpha) / n
                    if sum(abs(rank[v] - last[v]) for v in own) < n * tolerance:
                        break
                top = max(rank.values())
                yield pd.DataFrame({"doc_id": [row.doc_id] * n, "clause_id": own, "pagerank": [round(rank[v] / top, 6) for v in own]})

    return ids.join(es, "doc_id", "left").mapInPandas(run, f"doc_id {kind}, clause_id int, pagerank double")


def betweenness_of(ids: list, edges: list[tuple]) -> dict:
    """Weighted betweenness of one digraph by shortest paths; the weight is the distance."""
    out: dict = {}
    for s, t, w in edges:
        out.setdefault(s, []).append((t, w))
    total = dict.fromkeys(ids, 0.0)
    for s in ids:
        far, paths, before, order = {s: 0.0}, {s: 1.0}, {}, []
        heap, done = [(0.0, 0, s)], set()
        tick = 0
        while heap:
            d, _, v = heapq.heappop(heap)
            if v in done:
                continue
            done.add(v)
            order.append(v)
            for t, w in out.get(v, ()):
                nd = d + w
                if t not in far or nd < far[t] - 1e-12:
                    far[t], paths[t], before[t] = nd, paths[v], [v]
                    tick += 1
                    heapq.heappush(heap, (nd, tick, t))
                elif t not in done and abs(nd - far[t]) <= 1e-12:
                    paths[t] += paths[v]
                    before[t].append(v)
        owed = dict.fromkeys(order, 0.0)
        for v in reversed(order):
            for u in before.get(v, ()):
                owed[u] += paths[u] / paths[v] * (1 + owed[v])
            if v != s:
                total[v] += owed[v]
    return total


def betweenness(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Betweenness divided by the document's greatest, 0 without edges; one document at a time in a worker."""
    ids = nodes.groupBy("doc_id").agg(F.collect_list("clause_id").alias("ids"))  # one document's clauses
    es = pairs.groupBy("doc_id").agg(F.collect_list(F.struct("source", "target", "weight")).alias("es"))
    kind = nodes.schema["doc_id"].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples():
                got = betweenness_of(list(row.ids), [(e["source"], e["target"], e["weight"]) for e in (row.es if row.es is not None else ())])
                top = max(got.values(), default=0) or 1.0
                yield pd.DataFrame({"doc_id": [row.doc_id] * len(got), "clause_id": list(got), "betweenness": [round(x / top, 6) for x in got.values()]})

    return ids.join(es, "doc_id", "left").mapInPandas(run, f"doc_id {kind}, clause_id int, betweenness double")
