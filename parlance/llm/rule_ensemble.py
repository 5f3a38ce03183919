"""Quality classifier as a sparse rule ensemble.

Statistics of each whole text are measured once.  Small trees are grown on bootstrap
samples of labelled rows; every path from a root is a conjunctive rule.  A logistic model
with lasso weights over the rules keeps few of them, and those are compiled into one Spark
column expression, so scoring adds no Python after the measurements.

The fit uses at most ``SAMPLE_ROWS`` labelled rows, the first by a hash of the document id
(a documented bound; scoring covers every document); each tree is grown on a bootstrap sample
of ``TREE_ROWS`` of those rows at most, the weights are fitted on all of them.  Labels, language, source and the
document id are never inputs of a score.

Defined cases: a null or empty text has all statistics 0 and gets a score like any other;
no usable labels, or labels of one class only, give every document the share of label 1
(0.5 without labels); null labels are ignored; repeated rows give repeated rows; extra
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.rule_ledger import measure

SAMPLE_ROWS, TREE_ROWS, TREES, DEPTH, CUTS, LEAST_LEAF, PENALTY, STEPS, SEED = 20_000, 2000, 24, 3, 24, 8, 0.001, 600, 20240229
THRESHOLD = 0.3


def statistics() -> dict[str, Column]:
    """The inputs of a score, from the measurements."""
    share = lambda a, b: F.col(a) / F.greatest(F.lit(1), F.col(b))
    return {
        "words": F.col("n_words").cast("double"),
        "lines": F.col("n_lines").cast("double"),
        "chars_per_word": share("word_chars", "n_words"),
        "symbols_per_word": share("n_symbols", "n_words"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "duplicate_line_share": share("n_dup_lines", "n_lines"),
        "upper_share": share("n_upper", "n_letters"),
        "shouts_per_word": share("n_shouts", "n_words"),
        "words_per_line": share("n_words", "n_lines"),
        "letters_per_char": share("n_letters", "word_chars"),
    }


#: A rule: conditions (feature, above, cut); above means the value is greater than the cut.
Rule = tuple[tuple[str, bool, float], ...]


@dataclass(frozen=True)
class Model:
    bias: float
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]

    def score(self) -> Column:
        """The compiled expression: logistic of the weighted rules that hold."""
        total = F.lit(self.bias)
        features = statistics()
        for rule, weight in zip(self.rules, self.weights, strict=True):
            holds = F.lit(True)
            for name, above, cut in rule:
                holds = holds & ((features[name] > cut) if above else (features[name] <= cut))
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def _grow(x: np.ndarray, y: np.ndarray, names: list[str], rng: np.random.Generator, path: Rule, depth: int, out: set[Rule]) -> None:
    if path:
        out.add(path)
    if depth == 0 or len(y) < 2 * LEAST_LEAF or y.min() == y.max():
        return
    best = (1e-9, None)
    whole = y.mean() * (1 - y.mean())
    for j in rng.permutation(x.shape[1])[: max(2, (2 * x.shape[1]) // 3)]:
        for cut in np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, CUTS))):
            left = x[:, j] <= cut
            n = int(left.sum())
            if n < LEAST_LEAF or len(y) - n < LEAST_LEAF:
                continue
            a, b = y[left].mean(), y[~left].mean()
            gain = whole - (n * a * (1 - a) + (len(y) - n) * b * (1 - b)) / len(y)
            if gain > best[0]:
                best = (gain, (j, cut, left))
    if best[1] is None:
        return
    j, cut, left = best[1]
    _grow(x[left], y[left], names, rng, (*path, (names[j], False, float(cut))), depth - 1, out)
    _grow(x[~left], y[~left], names, rng, (*path, (names[j], True, float(cut))), depth - 1, out)


def _lasso(z: np.ndarray, y: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient for logistic loss with an L1 penalty; the bias is free."""
    n, k = z.shape
    a = np.hstack([np.ones((n, 1)), z])
    step = 4 * n / max(1e-9, np.linalg.norm(a, 2) ** 2)
    w = v = np.zeros(k + 1)
    t = 1.0
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(a @ v, -30, 30)))
        u = v - step * (a.T @ (p - y)) / n
        u[1:] = np.sign(u[1:]) * np.maximum(0, np.abs(u[1:]) - step * penalty)
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        w, v, t = u, u + (t - 1) / s * (u - w), s
    return float(w[0]), w[1:]


def fit_arrays(x: np.ndarray, y: np.ndarray, names: list[str]) -> Model:
    if not len(y) or y.min() == y.max():
        share = min(1 - 1e-3, max(1e-3, float(y.mean()) if len(y) else 0.5))
        return Model(float(np.log(share / (1 - share))), (), ())
    rng = np.random.default_rng(SEED)
    found: set[Rule] = set()
    for _ in range(TREES):
        rows = rng.integers(0, len(y), min(len(y), TREE_ROWS))
        _grow(x[rows], y[rows], names, rng, (), DEPTH, found)
    rules = sorted(found)
    z = np.ones((len(y), len(rules)))
    for i, rule in enumerate(rules):
        for name, above, cut in rule:
            c = x[:, names.index(name)]
            z[:, i] *= c > cut if above else c <= cut
    # Rules that hold for the same rows are one.
    first = np.sort(np.unique(z, axis=1, return_index=True)[1])
    bias, w = _lasso(z[:, first], y, PENALTY)
    kept = np.flatnonzero(np.abs(w) > 1e-3)
    return Model(bias, tuple(rules[first[i]] for i in kept), tuple(float(w[i]) for i in kept))


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from labelled rows that are not held out."""
    names = list(statistics())
    wanted = labels.select("doc_id", F.col("quality").cast("double").alias("y")).where("y is not null and doc_id is not null").where(~held_out())
    wanted = wanted.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    texts = docs.select("doc_id", "text").join(F.broadcast(wanted.select("doc_id")), "doc_id", "left_semi")  # SAMPLE_ROWS ids at most
    rows = measure(texts).select("doc_id", *[c.alias(n) for n, c in statistics().items()]).join(F.broadcast(wanted), "doc_id").orderBy("doc_id").toPandas()
    return fit_arrays(rows[names].to_numpy(float), rows["y"].to_numpy(float), names)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    rows = measure(docs).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), model.score().alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
