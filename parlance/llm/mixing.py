"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A source's documents are dealt to blocks by a hash of the row; the blocks are put into a
permuted order.  A source that may give ``target`` words gives every document
``target div size`` times and then whole blocks in permuted order until the words that
are still missing are reached; inside the last block, documents in permuted order, and of
the last document only the words still missing.  The numbers of drawn blocks of all
sources are split exactly among the output shards: each node of a binary tree over the
shards gives its left half a multivariate hypergeometric draw of the node's blocks, so
every shard gets its share of blocks, and each source is spread as by dealing shuffled
blocks.  ``mix`` reports the shards of every row's draws; ``mixed`` lays its rows out shard
after shard, those of a shard shuffled by a hash of the draw.

Everything is a function of the rows and the seed, so reruns agree.  The driver handles
one row for each source (``MAX_SOURCES`` at most); prefix sums run inside blocks of about
``BLOCK_ROWS`` documents (more where a source would have over ``MAX_BLOCKS`` blocks) and over
a source's blocks, never over a source's documents.

Defined cases: null or empty text: size 0, nothing taken; null source: the last source;
sources without words have target 0; repeated rows are each taken alike; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parlance.llm.bytekit import row_key
from parlance.llm.cluster import checkpointed

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
BLOCK_ROWS, MAX_BLOCKS, MAX_SOURCES, SHARDS, SEED = 1000, 100_000, 100_000, 16, 20240229
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: np.ndarray, weights: np.ndarray, share: float = SHARE, most: float = MOST) -> np.ndarray:
    """Each source's words: by weight, at most ``most`` times its size; what is over goes to the others by weight."""
    sizes, weights = np.asarray(sizes, float), np.asarray(weights, float)
    cap, left = most * sizes, share * sizes.sum()
    out, is_open = np.zeros(len(sizes)), np.ones(len(sizes), bool)
    while is_open.any():
        fair = left * weights[is_open] / weights[is_open].sum()
        over = fair >= cap[is_open]
        if not over.any():
            out[is_open] = fair
            break
        full = np.flatnonzero(is_open)[over]
        out[full] = cap[full]
        left = max(0.0, left - cap[full].sum())
        is_open[full] = False
    return out


def split(quotas: np.ndarray, shards: int, seed: int = SEED) -> np.ndarray:
    """Sources x shards: how many of each source's blocks each shard gets; rows sum to ``quotas``, shards differ by one at most."""
    out = np.zeros((len(quotas), shards), np.int64)

    def node(have: np.ndarray, first: int, last: int) -> None:
        if last - first == 1:
            out[:, first] = have
            return
        middle, total = (first + last) // 2, int(have.sum())
        # Whole rows of blocks for each shard; the first of the shards get one more.
        each, more = divmod(total, last - first)
        draw = each * (middle - first) + min(more, middle - first)
        rng = np.random.default_rng([seed, first, last])
        left = rng.multivariate_hypergeometric(have, draw, method="marginals") if len(have) and total else np.zeros_like(have)
        node(left, first, middle)
        node(have - left, middle, last)

    node(np.asarray(quotas, np.int64), 0, shards)
    return out


def _sources(base: DataFrame, weights: tuple, share: float, most: float) -> list[dict]:
    rows = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"a mix of more than {MAX_SOURCES} sources: group them first")
    rows = sorted((r.asDict() for r in rows), key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    got = targets(np.array([r["source_size"] for r in rows]), np.array([weights[i % len(weights)] for i in range(len(rows))]), share, most) if rows else []
    for r, t in zip(rows, got, strict=True):
        r["target"], r["blocks"] = float(t), min(MAX_BLOCKS, -(-r["n"] // BLOCK_ROWS))
        words = min(round(t), int(most * r["source_size"]))
        r["passes"], r["extra"] = divmod(words, r["source_size"]) if r["source_size"] else (0, 0)
    return rows


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, row_key, size, source, source_size, target, passes, extra_taken, taken and the shards of whole passes and of the extra draw."""
    spark = docs.sparkSession
    base = docs.select("doc_id", row_key(), "source", F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    base = checkpointed(base)
    found = _sources(base, weights, share, most)
    plan = spark.createDataFrame(
        [(r["source"], r["source_size"], r["target"], r["blocks"], r["passes"], r["extra"]) for r in found],
        "source string, source_size long, target double, blocks long, passes long, extra long",
    )
    # The plan has one row for each source, MAX_SOURCES at most: small enough to send to every executor.
    known = base.join(F.broadcast(plan), base["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    known = known.withColumn("order", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("row_key")))
    known = known.withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("order")), F.col("blocks")))
    by_block = known.groupBy("source", "block", "passes", "extra").agg(F.sum("size").alias("block_size"))
    permuted = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 2), F.col("source"), F.col("block")), "block")
    by_block = by_block.withColumns({"rank": F.row_number().over(permuted) - 1, "before": F.coalesce(F.sum("block_size").over(permuted.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    by_block = checkpointed(by_block.withColumn("drawn", (F.col("before") < F.col("extra")).cast("int")))
    # Whole passes draw every block, the extra draw those that it reaches.
    drawn = {r["source"]: (r["n"], r["drawn"]) for r in by_block.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("drawn").alias("drawn")).collect()}
    quotas = np.array([r["passes"] * drawn[r["source"]][0] + drawn[r["source"]][1] for r in found], np.int64)
    upto = np.cumsum(split(quotas, shards, seed), axis=1)
    edges = spark.createDataFrame([(r["source"], [int(x) for x in upto[i]], drawn[r["source"]][0]) for i, r in enumerate(found)], "source string, upto array<long>, n_blocks long")
    by_block = by_block.join(F.broadcast(edges), by_block["source"].eqNullSafe(edges["source"])).drop(edges["source"])
    shard = lambda k: F.expr(f"cast(size(filter(upto, c -> c <= {k})) as int)")
    # Draw number: the extra draw first, then pass after pass.
    by_block = by_block.withColumns({
        "extra_shard": F.when(F.col("drawn") == 1, shard("rank")),
        "pass_shards": F.expr("transform(sequence(1, cast(passes as int) + 1), p -> cast(size(filter(upto, c -> c <= rank + (p - 1) * n_blocks + greatest(0, upto[size(upto) - 1] - passes * n_blocks))) as int))"),
    }).withColumn("pass_shards", F.expr("slice(pass_shards, 1, cast(passes as int))"))
    blocks = by_block.select(F.col("source").alias("s"), F.col("block").alias("b"), "before", "extra_shard", "pass_shards")
    known = known.join(blocks, known["source"].eqNullSafe(blocks["s"]) & (known["block"] == blocks["b"])).drop("s", "b")
    inside = Window.partitionBy("source", "block").orderBy("order", "doc_id", "row_key").rowsBetween(Window.unboundedPreceding, -1)
    known = known.withColumn("at", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    known = known.withColumn("extra_taken", F.greatest(F.lit(0), F.least(F.col("size"), F.col("extra") - F.col("at"))))
    return known.select("doc_id", "row_key", "source", "size", "source_size", "target", F.col("passes").cast("int").alias("passes"), "extra_taken", (F.col("passes") * F.col("size") + F.col("extra_taken")).alias("taken"), "pass_shards", "extra_shard")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as the mix takes them: a row for each whole pass, and one for an extra draw.

    They lie in the order of the shards that the splitting tree gave their draws, shuffled inside a
    shard by a seeded hash.  An extra draw that takes a part of a document has its first words,
    joined by spaces, and ``n_chars`` counted anew.  Repeated rows (same id and text) are taken alike."""
    seed = options.get("seed", SEED)
    plan = mix(docs, **options).groupBy("doc_id", "row_key").agg(*[F.max(c).alias(name) for c, name in (("passes", "passes"), ("extra_taken", "extra"), ("size", "size"), ("pass_shards", "pass_shards"), ("extra_shard", "extra_shard"))]).where("passes > 0 or extra > 0")
    plan = checkpointed(plan).withColumnsRenamed({"doc_id": "k_id", "row_key": "k_key"})
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("doc_id").alias("r_id"), row_key().alias("r_key"))
    rows = rows.join(plan, rows["r_id"].eqNullSafe(plan["k_id"]) & (rows["r_key"] == plan["k_key"]))
    # Draw 0 is the extra one.
    draws = F.when(F.col("extra") > 0, F.sequence(F.lit(0), F.col("passes"))).otherwise(F.sequence(F.lit(1), F.col("passes")))
    rows = rows.withColumn("draw", F.explode(draws))
    rows = rows.withColumns({"shard": F.when(F.col("draw") == 0, F.col("extra_shard")).otherwise(F.element_at("pass_shards", F.greatest(F.lit(1), F.col("draw")))), "place": F.xxhash64(F.lit(seed + 3), "r_id", "r_key", "draw")})
    part = (F.col("draw") == 0) & (F.col("extra") < F.col("size"))
    text = F.when(part, F.array_join(F.slice(F.regexp_extract_all(F.col("row.text"), F.lit(WORD), F.lit(0)), F.lit(1), F.col("extra").cast("int")), " ")).otherwise(F.col("row.text"))
    rows = rows.withColumn("taken_text", text).repartitionByRange("shard", "place").sortWithinPartitions("shard", "place")
    columns = [F.col("taken_text").alias(c) if c == "text" else F.when(part, F.length("taken_text")).otherwise(F.col("row.n_chars")).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("row").getField(c).alias(c) for c in docs.columns]
    return rows.select(*columns)
