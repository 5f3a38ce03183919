"""Citations in clauses, the citation graph over documents, and precedent importance."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parlance.runtime import checkpointed

# Citation patterns in their order, with the type that a match of each has.
CITATION_PATTERNS = [
    (r"SC/CA/(\d+)/(\d{4})", "SC/CA/"),
    (r"SC/FR/(\d+)/(\d{4})", "SC/FR/"),
    (r"SC Appeal No[:\s]*(\d+)/(\d{4})", "SC/CA/"),
    (r"SC APPEAL NO[:\s]*(\d+)/(\d{4})", "SC/"),
    (r"SC Appeal (\d+)/(\d{4})", "SC/CA/"),
    (r"S\.C Appeal No[:\s]*(\d+)/(\d{4})", "SC/CA/"),
    (r"S\.C\. Appeal No[:\s]*(\d+)/(\d{4})", "SC/CA/"),
    (r"SC FR No[:\s]*(\d+)/(\d{4})", "SC/FR/"),
    (r"SC FR (\d+)/(\d{4})", "SC/FR/"),
    (r"\([^)]*SC Appeal No[^)]*(\d+)/(\d{4})[^)]*\)", "SC/CA/"),
    (r"\[[^\]]*SC Appeal No[^\]]*(\d+)/(\d{4})[^\]]*\]", "SC/CA/"),
    (r"SC/(\d+)/(\d{4})", "SC/"),
]
# Forms of case numbers, and of quoted texts, in the order in which they are tried.
CASE_PATTERNS = [r"(?i)SC[_\s]?(?:CA|FR|SPL)?[_\s]?(\d+)[_\s]?(\d{4})", r"(?i)SC[/\s]?(?:CA|FR|APPEAL)[/\s]?(\d+)[/\s]?(\d{4})", r"(?i)SC\s+Appeal\s+(?:No[:\s]*)?(\d+)[/\s]?(\d{4})", r"(?i)SC[_\s/](\d+)[_\s/](\d{4})"]
QUOTES = [r'"([^"]+)"', "\u201c([^\u201d]+)\u201d", r"'([^']+)'"]


# The patterns of citations with their places, and how each writes its citation: with the type (typed),
# as an appeal, or bare.
SPAN_PATTERNS = [
    (r"SC/CA/(\d+)/(\d{4})", "typed"),
    (r"SC/FR/(\d+)/(\d{4})", "typed"),
    (r"SC/APPEAL/(\d+)/(\d{4})", "bare"),
    (r"SC Appeal No[:\s]*(\d+)/(\d{4})", "appeal"),
    (r"SC APPEAL NO[:\s]*(\d+)/(\d{4})", "appeal"),
    (r"SC Appeal (\d+)/(\d{4})", "appeal"),
    (r"S\.C Appeal No[:\s]*(\d+)/(\d{4})", "bare"),
    (r"S\.C\. Appeal No[:\s]*(\d+)/(\d{4})", "bare"),
    (r"SC FR No[:\s]*(\d+)/(\d{4})", "bare"),
    (r"SC FR (\d+)/(\d{4})", "bare"),
    (r"\([^)]*SC Appeal No[^)]*(\d+)/(\d{4})[^)]*\)", "appeal"),
    (r"\[[^\]]*SC Appeal No[^\]]*(\d+)/(\d{4})[^\]]*\]", "appeal"),
    (r"\([^)]*SC/CA/[^)]*(\d+)/(\d{4})[^)]*\)", "typed"),
    (r'\[[^\]]*SC/CA/[^"]*(\d+)/(\d{4})[^\]]*\]', "typed"),
    (r"[A-Z][^[]*\[[^\]]*SC Appeal No[^\]]*(\d+)/(\d{4})[^\]]*\]", "appeal"),
    (r'[A-Z][^[]*\[[^\]]*SC/CA/[^"]*(\d+)/(\d{4})[^\]]*\]', "typed"),
    (r"cited.*?SC/CA/(\d+)/(\d{4})", "typed"),
    (r"cited.*?SC/FR/(\d+)/(\d{4})", "typed"),
    (r"referred.*?SC/CA/(\d+)/(\d{4})", "typed"),
    (r"referred.*?SC/FR/(\d+)/(\d{4})", "typed"),
    (r"following.*?SC/CA/(\d+)/(\d{4})", "typed"),
    (r"following.*?SC/FR/(\d+)/(\d{4})", "typed"),
    (r"SC/(\d+)/(\d{4})", "bare"),
]
AROUND = 20


def spans(c: Column) -> Column:
    """All citations of a text in the order of the patterns: citation, matched, start and stop.

    The type is FR where pattern or match say so, else that of an appeal, else what stands within
    ``AROUND`` characters.  Places need match offsets, so this runs in Arrow batches."""

    @F.pandas_udf("array<struct<citation:string,matched:string,start:int,stop:int>>")
    def run(texts: pd.Series) -> pd.Series:
        known = [(re.compile(p, re.I), "FR" in p, "APPEAL" in p.upper(), form) for p, form in SPAN_PATTERNS]

        def one(text: str | None) -> list[dict]:
            out = []
            for pattern, says_fr, says_appeal, form in known if text and re.search("S\\.?C", text, re.I) else ():
                for m in pattern.finditer(text):
                    near = text[max(0, m.start() - AROUND) : m.end() + AROUND].upper()
                    kind = "FR" if says_fr or "FR" in m[0] or (not says_appeal and "FR" in near) else "CA"
                    name = {"typed": f"SC/{kind}/{m[1]}/{m[2]}", "appeal": f"SC Appeal No {m[1]}/{m[2]}", "bare": f"SC/{m[1]}/{m[2]}"}[form]
                    out.append({"citation": name, "matched": m[0], "start": m.start(), "stop": m.end()})
            return out

        return texts.map(one)

    return run(c)


def cited_spans(rows: DataFrame) -> DataFrame:
    """doc_id, clause_id, cited, citation, matched, start, stop: the first of each cited document and citation of a clause.

    ``rows``: doc_id, clause_id, name (of the document), text; a document does not cite itself."""
    found = rows.select("doc_id", "clause_id", "name", F.posexplode(spans(F.col("text"))).alias("at", "s")).select("doc_id", "clause_id", "at", "s.*", citation_name(F.col("s.citation"), F.col("name")).alias("cited"))
    return first_seen(found.where("cited is not null"), ["doc_id", "clause_id", "cited", "citation"], "at").drop("at")


def extraction_stats(documents: DataFrame, found: DataFrame) -> DataFrame:
    """One row: documents, those with citations, citations, those with a target clause, distinct cited documents.

    ``found``: doc_id, cited, target_clause (null without one)."""
    total = found.agg(F.countDistinct("doc_id").alias("with_citations"), F.count(F.lit(1)).alias("citations"), F.count("target_clause").alias("with_target"), F.countDistinct("cited").alias("cited_documents"))
    return documents.select("doc_id").distinct().agg(F.count(F.lit(1)).alias("documents")).crossJoin(F.broadcast(total))  # one row


def target_clauses(links: DataFrame, clauses: DataFrame) -> DataFrame:
    """Links with the text of their target clause, null where the cited document lacks it; ``links``: cited, target_clause."""
    known = clauses.select(F.col("name").alias("cited"), F.col("clause_id").alias("target_clause"), F.col("text").alias("target_text"))
    return links.join(known, ["cited", "target_clause"], "left")


def _named(kind: str, cut: str) -> Callable[[Column], Column]:
    return lambda m: F.concat(F.when(F.upper(m).contains("FR"), "SC/FR/").otherwise(kind), F.regexp_extract(m, cut, 1), F.lit("/"), F.regexp_extract(m, cut, 2))


def citations(c: Column) -> Column:
    """The distinct citations of a text, sorted."""
    found = []
    for pattern, kind in CITATION_PATTERNS:
        whole = F.regexp_extract_all(c, F.lit(f"(?i){pattern}"), F.lit(0))
        cut = f"(?is)^.*?{pattern}.*$" if pattern[:2] not in (r"\(", r"\[") else f"(?is)^{pattern}$"
        found.append(F.transform(whole, _named(kind, cut)))
    return F.array_sort(F.array_distinct(F.flatten(F.array(*found))))


def cited_document(c: Column) -> Column:
    """SC/CA/n/y and SC/FR/n/y as document names; others have none."""
    return F.when(c.rlike(r"^SC/(CA|FR)/\d+/\d{4}$"), F.replace(c, F.lit("/"), F.lit("_")))


def case_number(c: Column) -> Column:
    """number/year of a case name or citation by the first pattern that is found; null if none is."""
    tries = [F.concat(F.regexp_extract(c, p, 1), F.lit("/"), F.regexp_extract(c, p, 2)) for p in CASE_PATTERNS]
    return F.coalesce(*[F.when(t != "/", t) for t in tries])


def citation_name(c: Column, own: Column) -> Column:
    """The document that a citation names (type CA unless it says FR); null without a case or for ``own`` itself."""
    number = case_number(c)
    name = F.concat(F.lit("SC_"), F.when(c.rlike(r"(?i)SC[/\s]?FR[/\s]?"), "FR").otherwise("CA"), F.lit("_"), F.replace(number, F.lit("/"), F.lit("_")))
    return F.when(number.isNotNull() & ~F.coalesce(number == case_number(own), F.lit(False)), name)


def position_score(cites: Column, idx: Column, n: Column) -> Column:
    """Citing clauses of the middle part count more; others 0."""
    p = idx / n
    return F.when(~cites, 0.0).when((p > 0.2) & (p < 0.8), 1 - 0.5 * p).otherwise(0.5)


def importance(rows: DataFrame, precedent: DataFrame) -> DataFrame:
    """Share of citations plus half the mean importance of the distinct cited documents, 1 at most.

    ``rows``: doc_id, clause_id, text; ``precedent``: name, importance."""
    n = counts(rows)
    cited = n.select("doc_id", "clause_id", F.explode(F.array_distinct(F.filter(F.transform(citations(F.col("text")), cited_document), lambda x: x.isNotNull()))).alias("name"))
    mean = cited.join(precedent, "name", "left").groupBy("doc_id", "clause_id").agg(F.avg(F.coalesce("importance", F.lit(0.0))).alias("mean"))
    both = n.join(mean, ["doc_id", "clause_id"], "left")
    return both.select("doc_id", "clause_id", F.round(F.least(F.lit(1.0), F.col("share") + 0.5 * F.coalesce("mean", F.lit(0.0))), 6).alias("citation_importance"))


def precedent_rank(pairs: DataFrame, iterations: int, alpha: float = 0.85) -> DataFrame:
    """Unweighted PageRank of the citation graph over documents, divided by its greatest.

    One join and one aggregation per iteration; the mass of documents that cite nothing is
    one number, summed on the executors."""
    pairs = checkpointed(pairs)
    names = pairs.select(F.col("doc").alias("name")).union(pairs.select(F.col("cited").alias("name"))).distinct()
    out = pairs.groupBy("doc").agg(F.count(F.lit(1)).alias("out"))
    total = names.agg(F.count(F.lit(1)).alias("n"))
    share = pairs.join(out, "doc").select(F.col("doc").alias("name"), "cited", (1 / F.col("out")).alias("p"))
    ranks = names.crossJoin(F.broadcast(total)).join(out.select(F.col("doc").alias("name"), "out"), "name", "left").select("name", "n", F.col("out").isNull().alias("dangling"), (1 / F.col("n")).alias("rank"))  # one row
    for _ in range(iterations):
        ranks = checkpointed(ranks)
        sent = share.join(ranks.select("name", "rank"), "name").groupBy(F.col("cited").alias("name")).agg(F.sum(F.col("rank") * F.col("p")).alias("got"))
        lost = ranks.agg(F.sum(F.when(F.col("dangling"), F.col("rank")).otherwise(0.0)).alias("lost"))
        ranks = ranks.crossJoin(F.broadcast(lost)).join(sent, "name", "left").select("name", "n", "dangling", (alpha * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / F.col("n")) + (1 - alpha) / F.col("n")).alias("rank"))  # one row
    ranks = checkpointed(ranks)
    top = ranks.agg(F.max("rank").alias("top"))
    return ranks.crossJoin(F.broadcast(top)).select("name", F.round(F.col("rank") / F.col("top"), 6).alias("importance"))  # one row


def external_edges(links: DataFrame) -> DataFrame:
    """Citation links as edges to external nodes named document::clause_n; ``links``: doc, source, found, target_clause."""
    return links.select(F.col("doc").alias("doc_id"), F.col("source").cast("string").alias("source"), F.concat_ws("", "found", F.lit("::clause_"), F.col("target_clause").cast("string")).alias("target"), F.lit("inter_citation").alias("relation"), F.col("found").alias("cited_doc"))


def first_seen(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key by position."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def quoted(c: Column, least: int = 30) -> Column:
    """The first quotation of more than ``least`` characters, by kind of quotes."""
    some = [F.regexp_extract(c, p, 1) for p in QUOTES]
    return F.coalesce(*[F.when(F.length(s) > least, s) for s in some])


def counts(rows: DataFrame) -> DataFrame:
    """Citations of each clause by its text; divided by the document's greatest."""
    n = rows.withColumn("n_citations", F.size(citations(F.col("text"))))
    top = F.max("n_citations").over(Window.partitionBy("doc_id"))
    return n.withColumn("share", F.when(top > 0, F.col("n_citations") / top).otherwise(0.0))


def citation_graph(rows: DataFrame) -> DataFrame:
    """Distinct (doc, cited document) pairs; a document does not cite itself."""
    cited = rows.select(F.col("name").alias("doc"), F.explode(citations(F.col("text"))).alias("citation")).withColumn("cited", cited_document(F.col("citation")))
    return cited.where("cited is not null and cited <> doc").select("doc", "cited").distinct()


def resolve(pairs: DataFrame, available: DataFrame) -> DataFrame:
    """Citations to documents that exist, by their alternative names in order: as SC_, as FR, as is."""
    tail = F.regexp_replace("cited", r"^SC_CA_", "")
    names = F.when(F.col("cited").startswith("SC_CA_"), F.array(F.concat(F.lit("SC_"), tail), F.concat(F.lit("SC_FR_"), tail), F.col("cited"))).otherwise(F.array(F.col("cited")))
    tries = pairs.select("doc", "cited", F.posexplode(names).alias("order", "name"))
    return tries.join(available.select("name").distinct(), "name").groupBy("doc", "cited").agg(F.min_by("name", "order").alias("found"))


def nearest_clause(sources: DataFrame, targets: DataFrame, threshold: float = 0.6) -> DataFrame:
    """For each citing clause the most similar clause of the cited document, if over threshold - 0.01; ties to the first."""
    from parlance.functions.vectors import dot, unit

    a = sources.select("source_id", "target_doc", unit(F.col("embedding")).alias("u"))
    b = targets.select(F.col("doc_id").alias("target_doc"), F.col("clause_id").alias("target_clause"), unit(F.col("embedding")).alias("v"))
    scored = a.join(b, "target_doc").withColumn("s", F.round(dot(F.col("u"), F.col("v")), 6)).where(F.col("s") > threshold - 0.01)
    best = scored.groupBy("source_id", "target_doc").agg(F.max_by(F.struct("target_clause", "s"), F.struct("s", -F.col("target_clause"))).alias("b"))
    return best.select("source_id", "target_doc", F.col("b.target_clause").alias("target_clause"), F.col("b.s").alias("similarity"))
