"""Scores of summaries and classifiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import SPACES


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), SPACES), lambda w: w != "")


def _overlap(a: np.ndarray, b: np.ndarray, orders: list[int]) -> list[int]:
    """For each order n, how many n-grams two sequences of word numbers have and share (clipped)."""
    x, y, out = a, b, []
    for n in range(1, max(orders) + 1):
        if n > 1:
            width = np.int64(max(a.max(initial=0), b.max(initial=0)) + 1)
            x, y = (g[: len(w) - n + 1] * width + w[n - 1 :] if len(w) >= n else w[:0] for g, w in ((x, a), (y, b)))
        known, number = np.unique(np.concatenate([x, y]), return_inverse=True)
        x, y = number[: len(x)], number[len(x) :]
        if n in orders:
            common = np.minimum(np.bincount(x, minlength=len(known)), np.bincount(y, minlength=len(known))).sum()
            out += [len(x), len(y), int(common)]
    return out


def gram_overlap(pairs: DataFrame, orders: list[int], split=tokens) -> DataFrame:
    """id, and for each order n the sizes n_ref, n_cand and common (clipped overlap) of n-grams, as ``n_ref_1`` and so on.

    Each pair is counted where it lies: the words of an Arrow batch are numbered once and n-grams are
    numbers of numbers, so nothing is shuffled.  A null text has no words."""
    names = [f"{c}_{n}" for n in sorted(orders) for c in ("n_ref", "n_cand", "common")]
    kind = pairs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [batch.column(1), batch.column(2)]
            flat = [c.flatten() for c in sides]
            numbers = pa.concat_arrays(flat).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            split_at = len(flat[0])
            words = [numbers[:split_at], numbers[split_at:]]
            size = [np.array([0 if n is None else n for n in pc.list_value_length(c).to_pylist()], np.int64) for c in sides]
            edge = [np.concatenate([[0], np.cumsum(x)]) for x in size]
            rows = [_overlap(*(w[e[k] : e[k + 1]] for w, e in zip(words, edge, strict=True)), orders) for k in range(batch.num_rows)]
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], ["id", *names])

    return pairs.select("id", split(F.col("reference")).alias("r"), split(F.col("candidate")).alias("c")).mapInArrow(run, f"id {kind}, " + ", ".join(f"{n} long" for n in names))


def _share(a: str, b: str) -> Column:
    return F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))


def rouge_n(pairs: DataFrame, n: int, split=tokens) -> DataFrame:
    p, r = _share(f"common_{n}", f"n_cand_{n}"), _share(f"common_{n}", f"n_ref_{n}")
    return gram_overlap(pairs, [n], split).select("id", F.round(p, 6).alias("p"), F.round(r, 6).alias("r"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 6).alias("f1"))


def bleu(pairs: DataFrame, most: int = 4) -> DataFrame:
    """Unsmoothed BLEU with a brevity penalty; 0 where an order has no match."""
    orders = list(range(1, most + 1))
    shares = [_share(f"common_{n}", f"n_cand_{n}") for n in orders]
    log = sum((F.ln(p) for p in shares), F.lit(0.0))
    short = F.when(F.col("n_cand_1") > F.col("n_ref_1"), 1.0).otherwise(F.exp(1 - F.try_divide("n_ref_1", "n_cand_1")))
    return gram_overlap(pairs, orders).select("id", F.round(F.when(F.least(*shares) > 0, short * F.exp(log / most)).otherwise(0.0), 6).alias("bleu"))


def lcs(x: list[str], y: list[str]) -> int:
    """Length of the longest common subsequence, bit-parallel: a row of the table is one integer, a step a few operations on it."""
    if len(x) > len(y):
        x, y = y, x
    at: dict[str, int] = {}
    for i, w in enumerate(x):
        at[w] = at.get(w, 0) | 1 << i
    every = (1 << len(x)) - 1
    row = every  # a zero bit is where the length grows by one
    for w in y:
        hit = row & at.get(w, 0)
        if hit:
            row = ((row + hit) | (row - hit)) & every
    return len(x) - row.bit_count()


def rouge_l(pairs: DataFrame) -> DataFrame:
    """F1 of the longest common subsequence; each pair where it lies."""
    import pandas as pd

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for a, b in zip(part["reference"], part["candidate"], strict=True):
                x, y = (a or "").lower().split(), (b or "").lower().split()
                common = lcs(x, y)
                p, r = common / max(1, len(y)), common / max(1, len(x))
                out.append(round(2 * p * r / (p + r), 6) if p + r else 0.0)
            yield pd.DataFrame({"id": part["id"], "rouge_l": out})

    return pairs.select("id", "reference", "candidate").mapInPandas(run, f"id {pairs.schema['id'].dataType.simpleString()}, rouge_l double")


def confusion(rows: DataFrame) -> DataFrame:
    return rows.groupBy("y", "predicted").agg(F.count(F.lit(1)).alias("n"))


def classification_report(rows: DataFrame) -> DataFrame:
    """Precision, recall and F1 of each class; divisions by zero are 0; ``rows``: y, predicted."""
    c = confusion(rows)
    by_y = c.groupBy(F.col("y").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("y") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hit"))
    by_p = c.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("named"))
    j = by_y.join(by_p, "class", "full").na.fill(0, ["support", "hit", "named"])
    p, r = F.coalesce(F.try_divide("hit", "named"), F.lit(0.0)), F.coalesce(F.try_divide("hit", "support"), F.lit(0.0))
    return j.select("class", "support", F.round(p, 6).alias("p"), F.round(r, 6).alias("r"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 6).alias("f1"))


def mean_std(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and population deviation, rounded to 4."""
    return rows.agg(*[F.round(f(c), 4).alias(f"{name}_{c}") for c in columns for name, f in (("mean", F.avg), ("std", F.stddev_pop))])


def name_found(name: Column, text: Column) -> Column:
    """A case name in a text: as it is, without ``and other(s)``, or by its first three longer words."""
    low, t = F.lower(name), F.lower(text)
    short = F.trim(F.regexp_replace(low, r"\s+and\s+others?", ""))
    first = F.slice(F.filter(F.split(low, r"[^a-z0-9]+"), lambda w: F.length(w) > 2), 1, 3)
    return t.contains(low) | t.contains(short) | ((F.size(first) > 0) & F.forall(first, lambda w: t.contains(w)))


def compression(reference: Column, candidate: Column) -> Column:
    return F.coalesce(F.round(F.try_divide(F.size(tokens(reference)), F.size(tokens(candidate))), 6), F.lit(0.0))


def classification_summary(rows: DataFrame) -> DataFrame:
    """Macro averages of the classes' scores, and accuracy; ``rows``: y, predicted."""
    report = classification_report(rows)
    hits = rows.agg(F.round(F.avg(F.when(F.col("y") == F.col("predicted"), 1.0).otherwise(0.0)), 6).alias("accuracy"))
    macro = report.agg(*[F.round(F.avg(c), 5).alias(f"macro_{c}") for c in ("p", "r", "f1")])
    return macro.crossJoin(F.broadcast(hits))  # one row
