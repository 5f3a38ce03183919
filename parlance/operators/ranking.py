"""Hybrid ranking of clauses with an adaptive top-k and a guaranteed disposition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parlance.functions.text import any_of, length_factor, procedure_heavy, statutory_fragment
from parlance.functions.vectors import near_better

# Role weights, signal weights and their changes by case type, k ratios, disposition patterns.
ROLE_WEIGHTS = {"Claim": 1.0, "Premise": 0.7, "Opposition": 0.6}
OTHER_ROLE = 0.5
WEIGHTS = {"pagerank": 0.25, "betweenness": 0.15, "role": 0.20, "citation": 0.15, "embedding": 0.10, "support_degree": 0.10, "position": 0.05}
CASE_CHANGES = {
    "Fundamental Rights": {"role": 0.05, "citation": 0.05, "support_degree": -0.05},
    "Civil Appeal": {"pagerank": 0.05, "citation": 0.05, "position": -0.05},
}
STRONG_DISPOSITIONS = [
    r"\bfor the foregoing reasons\b",
    r"\b(for these reasons|for these grounds|for the above reasons|for the aforementioned reasons)\b",
    r"\b(i proceed to (?:dismiss|allow|grant))\b",
    r"\b(?:the )?appeal(?:s)? (?:of [^.]*? )?(?:is|are|must be|should|should therefore stand) (?:allowed|dismissed|rejected)\b",
    r"\bappeal(?:s)? (?:allowed|dismissed|rejected)\b",
    r"\bappeal(?:s)? (?:is|are) (?:hereby|accordingly) (?:dismissed|allowed|rejected)\b",
    r"\b(application|petition|revision application|motion) (?:is|are|must be) (?:allowed|dismissed|rejected)\b",
    r"\b(application|petition|motion) (?:dismissed|allowed|rejected)\b",
    r"\b(?:the )?(?:application|petition|motion) is,? (?:accordingly|therefore|hereby) (?:dismissed|allowed|rejected)\b",
    r"\b(i (?:therefore|accordingly|hereby) (?:make|would make|hereby make) order)\b",
    r"\b(i|is|are) (?:set aside|affirmed|quashed|varied)",
    r"\bjudgment(?:s)? (?:is|are) (?:set aside|affirmed|quashed|varied)\b",
    r"(?s:\bi set aside.*?and (?:allow|dismiss|restore))",
    r"\b(?:should|must) (?:stand|be) (?:rejected|dismissed|allowed)\b",
    r"\bi (?:therefore|accordingly)? hold that",
    r"\bi hold that (?:there is no|the|this) (?:lawful )?(?:appeal|application|petition)",
    r"\bi (?:have no hesitation in )?(?:uphold|dismiss|allow|reject)",
    r"(?s:\bi (?:therefore|accordingly|further)? declare that.*(?:violates|illegal|null|void|infringed))",
    r"\bi (?:therefore|accordingly|further)? declare that",
    r"\bi (?:proceed to )?answer (?:both|the|all|three) (?:questions? of law|issues? of law)",
    r"\b(?:re-hearing|rehearing) (?:ordered|directed)\b",
    r"\bi am (?:in )?agreement (?:with|that)",
    r"\border(?:s)? (?:made|issued).*must (?:remain|stand) (?:unaltered|unchanged)",
    r"\bthat (?:date|order|judgment) will stand\b",
    r"(?s:\baccordingly,? (?:the )?(?:application|petition|motion|order).*?is (?:rejected|dismissed|allowed)\b)",
    r"\b(?:i )?(?:order|ordered) (?:no )?costs\b",
    r"\bno costs (?:ordered|awarded)\b",
    r"\bi (?:further )?direct (?:the|that|respondents?|registrar)",
    r"\bi therefore order.*(?:pay|compensation|costs)",
    r"\b(?:the )?state (?:shall|will) pay.*(?:costs|compensation)",
    r"\bis forthwith directed (?:to|that)",
    r"\b(?:the )?(?:petitioner|appellant|respondent) is entitled to (?:support (?:his|her|their) application for leave to proceed|proceed|receive)",
]
WEAK_DISPOSITIONS = [r"\b with costs\b"]
MAIN_OUTCOMES = [
    r"\b(?:the )?(?:application|petition|appeal|motion)(?:s)?\s+(?:is|are|was|were)?\s*,?\s*(?:accordingly|therefore|hereby)?\s*(?:dismissed|allowed|rejected)\b",
    r"\bappeal(?:s)?\s+(?:allowed|dismissed|rejected)\b",
    r"\bi proceed to (?:dismiss|allow|grant)\b",
    r"\b(?:is|are|judgment)\s+(?:set aside|affirmed|quashed|varied)\b",
    r"(?s:\bi set aside.*?and (?:allow|dismiss|restore))",
    r"(?s:\bfor the foregoing reasons.*?(?:set aside|allowed|dismissed|rejected))",
]
ORDERS = [
    r"\bi (?:therefore|accordingly)? (?:hold|declare) that",
    r"\bi (?:further )?direct (?:the|that|respondents?)",
    r"\bi (?:therefore|accordingly) order.*(?:pay|compensation)",
    r"\b(?:the )?state (?:shall|will) pay.*(?:costs|compensation)",
    r"\bis forthwith directed",
]
COSTS_ONLY = [r"\bno costs (?:ordered|awarded)\b", r"\bi (?:make |order )?no order for costs\b", r"\b(?:i )?(?:order|ordered) (?:no )?costs\b"]


#: Columns that a hybrid score needs.
SIGNALS = ("pagerank", "betweenness", "citation", "centroid_similarity", "support_in")


def role_weight(label: Column) -> Column:
    out = F.lit(OTHER_ROLE)
    for name, w in ROLE_WEIGHTS.items():
        out = F.when(label == name, w).otherwise(out)
    return out


def case_type(name: Column) -> Column:
    return F.when(F.upper(name).contains("FR_"), "Fundamental Rights").otherwise("Civil Appeal")


def weights_of(kind: str) -> dict[str, float]:
    """The signal weights of a case type, scaled to sum 1."""
    w = {k: v + CASE_CHANGES.get(kind, {}).get(k, 0.0) for k, v in WEIGHTS.items()}
    return {k: v / sum(w.values()) for k, v in w.items()}


def position(idx: Column, n: Column) -> Column:
    return F.when(n <= 1, 0.5).otherwise(idx / F.greatest(F.lit(1), n - 1))


def position_score(p: Column) -> Column:
    """Low for the opening, rising steps, a ramp over the last part."""
    return F.when(p < 0.20, 0.35).when(p < 0.60, 0.55).when(p < 0.85, 0.70).otherwise(0.95 + 0.05 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (p - 0.85) / 0.15)))


def min_max(c: str, key: str = "doc_id") -> Column:
    w = Window.partitionBy(key)
    low, high = F.min(c).over(w), F.max(c).over(w)
    return F.when(high > low, (F.col(c) - low) / (high - low)).otherwise(0.5)


def text_signals(rows: DataFrame) -> DataFrame:
    """What a hybrid score needs of a text: length_factor, statute and heavy."""
    text = F.coalesce("text", F.lit(""))
    return rows.withColumns({"length_factor": length_factor(text), "statute": statutory_fragment(text), "heavy": procedure_heavy(text)})


def hybrid_score(rows: DataFrame) -> DataFrame:
    """The weighted sum of the signal columns with the text factors, min-max scaled by document.

    ``rows``: doc_id, clause_id, text (or its ``text_signals``), label, idx, name and the columns of ``SIGNALS``; a null signal is 0, a
    missing column is an error."""
    if lost := [c for c in SIGNALS if c not in rows.columns]:
        raise ValueError(f"signals are missing: {', '.join(lost)}")
    if "heavy" not in rows.columns:
        rows = text_signals(rows)
    have = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    by_doc = Window.partitionBy("doc_id")
    rows = rows.withColumn("n", F.count(F.lit(1)).over(by_doc))
    boosted = role_weight(F.col("label")) * (1 + 0.5 * have("pagerank"))
    rows = rows.withColumn("role_boosted", boosted).withColumn("role_boosted", F.col("role_boosted") / F.max("role_boosted").over(by_doc))
    signals = {"pagerank": have("pagerank"), "betweenness": have("betweenness"), "role": F.col("role_boosted"), "citation": have("citation"), "embedding": have("centroid_similarity"), "support_degree": have("support_in") / 10, "position": position_score(position(F.col("idx"), F.col("n")))}
    kind = case_type(F.col("name"))
    total = F.lit(0.0)
    for k, signal in signals.items():
        w = F.lit(0.0)
        for t in CASE_CHANGES:
            w = F.when(kind == t, weights_of(t)[k]).otherwise(w)
        total = total + w * signal
    total = total * (0.9 + 0.1 * F.col("length_factor")) * F.when(F.col("statute"), 0.92).otherwise(1.0)
    rows = rows.withColumn("raw", total)
    many = F.sum(F.col("heavy").cast("int")).over(by_doc) > 10
    rows = rows.withColumn("raw", F.round(F.col("raw") * F.when(many & F.col("heavy"), 0.96).otherwise(1.0), 9))
    return rows.withColumn("score", F.round(min_max("raw"), 6)).drop("raw", "heavy", "length_factor", "statute", "role_boosted")


def ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "idx")))


def dedup_penalty(rows: DataFrame, threshold: float = 0.92, penalty: float = 0.93, vectors: DataFrame | None = None) -> DataFrame:
    """Scores times ``penalty`` where a better ranked clause of score over 0 is that similar.

    ``vectors``: doc_id, clause_id, embedding; by default those of ``rows``."""
    v = ranked(rows)
    hit = near_better(v, rows if vectors is None else vectors, threshold).withColumn("near", F.lit(True))
    out = v.join(hit, ["doc_id", "clause_id"], "left").withColumn("score", F.round(F.when(F.col("near"), F.col("score") * penalty).otherwise(F.col("score")), 6))
    return out.drop("near", "rank")


def adaptive_k(n: Column, edges: Column, kind: Column, method: str = "hybrid", least: int = 5, most: int = 50, share: float = 0.15, weights: tuple[float, float, float] = (0.4, 0.3, 0.3)) -> Column:
    """How many clauses a document gives, by a method."""
    clamp = lambda k: F.greatest(F.lit(least), F.least(F.lit(most), k)).cast("int")
    by_share = lambda r: clamp(F.floor(n * r))
    if method == "length":
        return by_share(F.when(n < 100, 0.20).when(n < 200, 0.15).otherwise(0.10))
    if method == "complexity":
        density = F.coalesce(F.try_divide(edges, n), F.lit(0.0))
        return F.when(n == 0, least).otherwise(by_share(F.lit(0.10) + F.when(density < 2, 0.0).when(density < 4, 0.05).otherwise(0.10)))
    if method == "case_type":
        return by_share(F.when(kind == "Fundamental Rights", 0.13).when(kind == "Civil Appeal", 0.17).otherwise(0.15))
    if method == "hybrid":
        parts = [adaptive_k(n, edges, kind, m, least, most) for m in ("length", "complexity", "case_type")]
        return clamp(F.bround(F.round(sum((w * k for w, k in zip(weights, parts, strict=True)), F.lit(0.0)), 6), 0))
    return by_share(share)


def dispositions(rows: DataFrame) -> DataFrame:
    """strong, weak (only where not strong) and priority 1 to 3 of every clause."""
    t = F.trim(F.coalesce("text", F.lit("")))
    strong = t.rlike(any_of(STRONG_DISPOSITIONS))
    first = F.when(t == "", 3).when(t.rlike(any_of(MAIN_OUTCOMES)), 1).when(t.rlike(any_of(ORDERS)), 2).when(t.rlike(any_of(COSTS_ONLY)), 3).otherwise(2)
    return rows.withColumns({"strong": strong, "weak": ~strong & F.col("text").rlike(any_of(WEAK_DISPOSITIONS)), "priority": first})


def guarantee_disposition(rows: DataFrame) -> DataFrame:
    """Adds, beyond k, the best disposition where a document's selection has none: by priority, then the latest.

    ``rows``: doc_id, clause_id, idx, text (or its ``dispositions``), selected."""
    d = rows if "strong" in rows.columns else dispositions(rows)
    by_doc = Window.partitionBy("doc_id")
    any_strong = F.max(F.col("strong")).over(by_doc)
    d = d.withColumn("required", F.when(any_strong, F.col("strong")).otherwise(F.col("weak")))
    d = d.withColumn("covered", F.max(F.col("required") & F.col("selected")).over(by_doc))
    best = F.row_number().over(Window.partitionBy("doc_id", "required").orderBy("priority", F.desc("idx")))
    d = d.withColumn("forced", F.col("required") & ~F.col("covered") & (best == 1))
    out = d.withColumn("selected", F.col("selected") | F.col("forced")).drop("strong", "weak", "priority", "required", "covered")
    return out


def document_order(rows: DataFrame) -> DataFrame:
    kept = rows.where("selected")
    return kept.withColumn("doc_order", F.row_number().over(Window.partitionBy("doc_id").orderBy("idx")))


def mmr(rows: DataFrame, k: int, weight: float = 0.3) -> DataFrame:
    """True maximal marginal relevance: one document at a time, greedy; the first of equals wins."""
    import numpy as np
    import pandas as pd

    kind = rows.schema["doc_id"].dataType.simpleString()

    def pick(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("idx").reset_index(drop=True)
        v = np.array(part["embedding"].tolist(), float)
        v = v / np.maximum(1e-9, np.linalg.norm(v, axis=1, keepdims=True))
        near, left, out = np.zeros(len(part)), np.ones(len(part), bool), []
        for _ in range(min(k, len(part))):
            gain = np.where(left, (1 - weight) * part["score"].to_numpy() + weight * (1 - np.clip(near, 0, 1)), -np.inf)
            i = int(np.argmax(gain))
            out.append(i)
            left[i] = False
            near = np.maximum(near, v @ v[i])
        return pd.DataFrame({"doc_id": part["doc_id"].iloc[out].to_numpy(), "clause_id": part["clause_id"].iloc[out].to_numpy(), "pick": range(1, len(out) + 1)})

    return rows.select("doc_id", "clause_id", "idx", "score", "embedding").groupBy("doc_id").applyInPandas(pick, f"doc_id {kind}, clause_id int, pick int")
