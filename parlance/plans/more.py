"""More registered queries: files between stages, feature rows, sections, hooks for models, and rules on planted texts.

Rules whose vocabulary the tables lack run on the tables' own texts with a phrase of that vocabulary planted in each;
the SQL plants the same phrases and computes the rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parlance.functions import text as tx
from parlance.operators import centrality, citations, cleaner, context, evaluate, features, graph, headnotes, models, ranking, segment, structure, translate
from parlance.plans.catalog import CITED_SQL, CITING, CLAUSES, EDGES, GRAPH_SQL, LINES, NODES, PAIRS, SQL, VECTORS, WORDS, _rank_sql, citation_lookup, edges_of, named, nodes_of, paired, query, quote, rlike, vectors_of
from parlance.runtime import checkpointed
from parlance.sources import files
from parlance.sources import tables as src

def listed(values: list[str]) -> str:
    return "[" + ", ".join(quote(v) for v in values) + "]"


def planted(values: list[str], key: str = "doc_id + clause_id"):
    """One of the phrases by arithmetic, as a function that gives the column, and as SQL."""
    return lambda: F.element_at(F.array(*map(F.lit, values)), (F.expr(key) % len(values) + 1).cast("int")), f"{listed(values)}[CAST(({key}) % {len(values)} AS INT) + 1]"


# Documents, lines and sentences.


@query()
def clean_documents(spark, sf_dir):
    """Every text with a header, a footer and page numbers written on its lines, cleaned in two passes."""
    d = src.table(spark, sf_dir, "documents")
    line = F.concat(F.lit("SC Appeal "), "doc_id", F.lit(" | "), "line", F.lit(" - end of page "), F.col("pos") % 90)
    rows = src.lines(d).select("doc_id", "pos", F.when(F.col("pos") % 5 == 0, F.concat(F.lit("Page "), "pos", F.lit(" of 99"))).otherwise(line).alias("line"))
    return cleaner.joined(cleaner.clean(rows))


@query()
def sentence_rules(spark, sf_dir):
    """Sentences of every whole text after the substitutions, the cuts and the repairs."""
    rows = structure.body_sentences(src.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.size("sentences").alias("n"), F.md5(F.array_join("sentences", "\n")).alias("digest"))


HEADS = ["Decided on: 12.03.2010 Sisira de Abrew, J.", "DATE OF JUDGMENT 2 May 2011", "no head at all", "Order delivered on 2010-02-03"]
_HEAD, _HEAD_SQL = planted(HEADS, "doc_id")


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'judge' WHEN doc_id % 4 <> 2 THEN 'date' END AS split_after FROM documents")
def metadata_of_documents(spark, sf_dir):
    """Which cut separates a planted head and the body; the letter d is taken out of the body, so that it holds no phrase of its own."""
    body = F.translate("text", "Dd", "")
    head = F.concat(F.lit("SC "), "doc_id", F.lit(" "), _HEAD(), F.lit(" The petitioner came. " + "so it was then as there " * 6), body)
    return src.table(spark, sf_dir, "documents").select("doc_id", structure.metadata_split(head).alias("s")).select("doc_id", "s.split_after")


@query()
def unmatched_metadata(spark, sf_dir):
    """Documents without any phrase that ends metadata."""
    d = src.table(spark, sf_dir, "documents").select("doc_id", structure.metadata_split(F.col("text")).alias("s"))
    return d.where("s.meta is null").select("doc_id")


@query(f"""WITH {LINES}, n AS (SELECT doc_id, list(CASE WHEN pos = 2 THEN 'Held:' ELSE line END ORDER BY pos) AS ls FROM lines GROUP BY doc_id), t AS (SELECT doc_id, list_transform(list_concat(['Parties', 'March 3, 2010'], list_concat(ls, ['Per A, J. so', 'Cases referred to: x', '1. Name of case ' || doc_id || ' - 1999', 'A. B for petitioner', 'tail'])), lambda x: trim(x, ' ')) AS ls FROM n),
p AS (SELECT *, coalesce(list_position(list_transform(ls, lambda x: regexp_matches(x, '^(?i)Held\\s*:?\\s*$')), true), len(ls) + 1) AS h, list_position(list_transform(ls, lambda x: regexp_matches(x, '^(?i)Cases\\s+referred\\s+to')), true) AS c FROM t)
SELECT doc_id, array_to_string(list_filter(ls[3:CAST(h AS INT) - 1], lambda x: x <> ''), ' ') AS facts, CASE WHEN h > len(ls) THEN '' ELSE array_to_string(list_filter(ls[CAST(h AS INT) + 1:CAST(c AS INT) - 1], lambda x: x <> '' AND NOT regexp_matches(x, '^(?i)Held\\s*:?\\s*$')), ' ') END AS held, 'Name of case ' || doc_id AS names FROM p""")
def headnote_sections(spark, sf_dir):
    """Facts, holdings and case names of headnotes whose lines are those of the texts, the second of them the heading."""
    rows = src.lines(src.table(spark, sf_dir, "documents")).withColumn("line", F.when(F.col("pos") == 2, "Held:").otherwise(F.col("line")))
    own = rows.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]).alias("ls"))  # one document
    frame = F.concat(F.array(F.lit("Parties"), F.lit("March 3, 2010")), "ls", F.array(F.lit("Per A, J. so"), F.lit("Cases referred to: x"), F.concat(F.lit("1. Name of case "), "doc_id", F.lit(" - 1999")), F.lit("A. B for petitioner"), F.lit("tail")))
    lines = own.select("doc_id", headnotes.headnote_lines(F.array_join(frame, "\n")).alias("l"))
    names = F.array_join(headnotes.case_names(headnotes.cases_referred(F.col("l"))), ";")
    return lines.select("doc_id", headnotes.before_held(F.col("l")).alias("facts"), headnotes.held(F.col("l")).alias("held"), names.alias("names"))


@query("WITH h AS (SELECT CASE doc_id % 4 WHEN 0 THEN 'SC_CA_' WHEN 1 THEN 'SC_FR_' WHEN 2 THEN 'SC_SPL_' ELSE 'SC_CA_ ' END || doc_id || '_2010' AS stem, doc_id FROM documents) SELECT stem, CASE WHEN doc_id % 3 = 0 THEN replace(stem, ' ', '') ELSE 'SC_' || CASE WHEN doc_id % 4 IN (0, 3) AND doc_id < 10 AND doc_id % 3 = 2 THEN '0' ELSE '' END || doc_id || '_2010' END AS name FROM h WHERE doc_id % 3 = 0 OR (doc_id % 4 IN (0, 2, 3) AND doc_id % 3 IN (1, 2) AND (doc_id % 3 = 1 OR (doc_id < 10 AND doc_id % 4 <> 2)))")
def headnote_pairs(spark, sf_dir):
    """Headnotes with the first existing name of their summary: as they are, in short form, or padded."""
    d = src.table(spark, sf_dir, "documents").select("doc_id")
    kind = F.element_at(F.array(*map(F.lit, ["SC_CA_", "SC_FR_", "SC_SPL_", "SC_CA_ "])), (F.col("doc_id") % 4 + 1).cast("int"))
    stems = d.select("doc_id", F.concat(kind, "doc_id", F.lit("_2010")).alias("stem"))
    padded = F.concat(F.lit("SC_"), F.when((F.col("doc_id") < 10) & (F.col("doc_id") % 3 == 2), "0").otherwise(""), "doc_id", F.lit("_2010"))
    names = stems.select(F.when(F.col("doc_id") % 3 == 0, F.regexp_replace("stem", " ", "")).when((F.col("doc_id") % 3 == 1) | (F.col("doc_id") < 10), padded).alias("name")).where("name is not null")
    return headnotes.pair(stems, names)


# Citations.
_CITING, _CITING_SQL = planted([t for _, t in CITING if t])


@query(f"WITH {CLAUSES}, c AS (SELECT doc_id, clause_id, text || ' ' || {_CITING_SQL} AS t FROM clauses) SELECT doc_id, clause_id, array_to_string({CITED_SQL}, ';') AS cited FROM c")
def citations_of_clauses(spark, sf_dir):
    """Every clause with a citation planted behind it: all its distinct citations."""
    rows = src.clauses(spark, sf_dir).select("doc_id", "clause_id", F.concat("text", F.lit(" "), _CITING()).alias("t"))
    return rows.select("doc_id", "clause_id", F.array_join(citations.citations(F.col("t")), ";").alias("cited"))


def cited_spans_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.clauses(spark, sf_dir).select("doc_id", "clause_id", src.case_id().alias("name"), F.concat("text", F.lit(" "), _CITING()).alias("text"))
    return citations.cited_spans(rows)


@query()
def citation_spans(spark, sf_dir):
    """Citations of every clause with their places, the first of each cited document and form."""
    return cited_spans_of(spark, sf_dir).select("doc_id", "clause_id", "cited", "citation", "matched", "start", "stop")


@query(f"WITH {GRAPH_SQL}, l AS (SELECT doc, cited, CASE WHEN length(cited) % 2 = 0 THEN 1 END AS target_clause FROM g) SELECT (SELECT count(*) FROM named) AS documents, count(DISTINCT doc) AS with_citations, count(*) AS citations, count(target_clause) AS with_target, count(DISTINCT cited) AS cited_documents FROM l")
def extraction_stats(spark, sf_dir):
    rows = named(spark, sf_dir)
    found = citations.citation_graph(rows).select(F.col("doc").alias("doc_id"), "cited", F.when(F.length("cited") % 2 == 0, 1).alias("target_clause"))
    return citations.extraction_stats(rows.select(F.col("name").alias("doc_id")), found)


_FOUND = GRAPH_SQL + ", c AS (SELECT doc, cited, unnest(ns) AS name, unnest(range(len(ns))) AS o FROM (SELECT *, CASE WHEN starts_with(cited, 'SC_CA_') THEN ['SC_' || substr(cited, 7), 'SC_FR_' || substr(cited, 7), cited] ELSE [cited] END AS ns FROM g)), f AS (SELECT doc, cited, arg_min(name, o) AS found FROM c WHERE name IN (SELECT name FROM named) GROUP BY doc, cited)"


@query(f"WITH {_FOUND} SELECT doc, cited FROM (SELECT doc, found AS cited FROM f UNION SELECT doc, cited FROM g)")
def cited_documents(spark, sf_dir):
    """Documents that a document cites, by its inter-document edges or by its text."""
    by_edge = citations.external_edges(citation_lookup(spark, sf_dir).select("doc", F.lit(1).alias("source"), "found", F.lit(2).alias("target_clause")))
    by_edge = by_edge.where("relation = 'inter_citation'").select(F.col("doc_id").alias("doc"), F.col("cited_doc").alias("cited"))
    return by_edge.union(citations.citation_graph(named(spark, sf_dir))).distinct()


@query(f"WITH {_FOUND}, {CLAUSES}, k AS (SELECT (CASE WHEN doc_id % 2 = 0 THEN 'SC_FR_' ELSE 'SC_CA_' END) || doc_id || '_2010' AS name, clause_id, text FROM clauses) SELECT doc, found AS cited, 2 AS target_clause, k.text AS target_text FROM f LEFT JOIN k ON k.name = f.found AND k.clause_id = 2".replace("c AS (SELECT doc, cited, unnest(ns)", "cc AS (SELECT doc, cited, unnest(ns)").replace("FROM c WHERE name IN", "FROM cc WHERE name IN"))
def citation_targets(spark, sf_dir):
    """Citation links with the text of the clause that they point to, null where there is none."""
    links = citation_lookup(spark, sf_dir).select("doc", F.col("found").alias("cited"), F.lit(2).alias("target_clause"))
    return citations.target_clauses(links, src.clauses(spark, sf_dir).withColumn("name", src.case_id()))


@query(f"WITH {_FOUND} SELECT doc AS doc_id, 2 + count(*) AS nodes, count(*) AS external, round(100.0 * count(*) / (2 + count(*)), 2) AS share FROM f GROUP BY doc")
def external_node_census(spark, sf_dir):
    """External nodes of a document's graph, all its nodes (two of its own here), and their share."""
    e = citations.external_edges(citation_lookup(spark, sf_dir).select("doc", F.lit(1).alias("source"), "found", F.lit(2).alias("target_clause")))
    n = e.groupBy("doc_id").agg(F.countDistinct("target").alias("external"))
    return n.select("doc_id", (F.col("external") + 2).alias("nodes"), "external", F.round(100 * F.col("external") / (F.col("external") + 2), 2).alias("share"))


# Files.


@query(f"WITH {CLAUSES} SELECT doc_id, clause_id, text, lag(text) OVER w AS prev_text, lead(text) OVER w AS next_text, lag(text, 2) OVER w AS prev_text_1 FROM clauses WINDOW w AS (PARTITION BY doc_id ORDER BY clause_id)")
def clause_files(spark, sf_dir):
    """Clauses with context written as one JSON record for each document and read back."""
    rows = context.with_context(src.clauses(spark, sf_dir))
    at = files.scratch(spark, "clauses")
    files.clause_records(rows, ["clause_id", "text", "prev_text", "next_text", "prev_text_1"]).write.json(at)
    return spark.read.schema(files.CLAUSE_FILE).json(at).select("doc_id", F.explode("clauses").alias("c")).select("doc_id", "c.*")


@query(f"WITH {CLAUSES} SELECT doc_id, clause_id, text, label FROM clauses WHERE (doc_id + clause_id) % 7 <> 0")
def annotated_files(spark, sf_dir):
    """Labelled clauses as JSON records with unlabelled clauses and broken lines among them; the good ones come back."""
    rows = src.clauses(spark, sf_dir).withColumn("label", F.when((F.col("doc_id") + F.col("clause_id")) % 7 != 0, F.col("label")))
    at = files.scratch(spark, "annotated")
    files.clause_records(rows, ["clause_id", "text", "label"]).write.json(at)
    spark.createDataFrame([('{"doc_id": 1, "clauses": [{',), ("not json",)], "value string").write.mode("append").text(at)
    return files.read_annotated(spark, at)


@query(f"WITH {CLAUSES} SELECT label, count(*) AS n FROM clauses GROUP BY label")
def training_rows(spark, sf_dir):
    """Training rows as JSON lines, written and read back."""
    at = files.scratch(spark, "training")
    src.clauses(spark, sf_dir).select("doc_id", "clause_id", "text", "label").write.json(at)
    return spark.read.schema("doc_id bigint, clause_id int, text string, label string").json(at).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {EDGES} SELECT e.doc_id, source, target, relation, score, s.label AS source_label FROM edges e JOIN nodes s ON s.doc_id = e.doc_id AND s.clause_id = e.source")
def graph_files(spark, sf_dir):
    """Graphs as JSON records of nodes and edges, read back and joined again."""
    nodes, edges = nodes_of(spark, sf_dir), edges_of(spark, sf_dir)
    at = files.scratch(spark, "graphs")
    files.graph_records(nodes, edges).write.json(at)
    n, e = files.read_graph(spark, at)
    return e.join(n.select("doc_id", F.col("id").alias("source"), F.col("label").alias("source_label")), ["doc_id", "source"]).select("doc_id", "source", "target", "relation", "score", "source_label")


@query(f"WITH {NODES} SELECT doc_id, clause_id, idx, label FROM nodes")
def graph_store(spark, sf_dir):
    """Node tables kept as parquet."""
    at = files.scratch(spark, "graph-store")
    nodes_of(spark, sf_dir).write.parquet(at)
    return spark.read.parquet(at).select("doc_id", "clause_id", "idx", "label")


@query("SELECT vec_id, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda x: CAST(CAST(x AS FLOAT) AS DOUBLE))), 4) AS total FROM embeddings")
def vector_store(spark, sf_dir):
    """Vectors kept as parquet in single precision, doubles again after reading."""
    at = files.scratch(spark, "vectors")
    src.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<float>").alias("v")).write.parquet(at)
    back = spark.read.parquet(at).select("vec_id", F.col("v").cast("array<double>").alias("v"))
    return back.select("vec_id", F.size("v").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query("SELECT doc_id, CASE WHEN CAST('0x' || substr(md5(doc_id::VARCHAR || '-42'), 1, 6) AS BIGINT) < CAST(0.2 * 16777216 AS BIGINT) THEN 'test' ELSE 'train' END AS part, lang, n_chars FROM documents")
def csv_pairs(spark, sf_dir):
    """A CSV file with a header, read by its schema and split by a hash."""
    at = files.scratch(spark, "csv")
    src.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").write.option("header", "true").csv(at)
    rows = spark.read.schema("doc_id bigint, lang string, n_chars bigint").option("header", "true").csv(at)
    return rows.select("doc_id", files.by_hash(F.col("doc_id")).alias("part"), "lang", "n_chars")


@query("SELECT doc_id, length(text) AS n, md5(text) AS digest FROM documents")
def text_files(spark, sf_dir):
    """Texts written as records and read back whole."""
    at = files.scratch(spark, "texts")
    files.write_texts(src.table(spark, sf_dir, "documents"), at)
    return spark.read.schema("doc_id bigint, text string").json(at).select("doc_id", F.length("text").alias("n"), F.md5("text").alias("digest"))


@query(r"SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> ''), ' ') AS text FROM documents")
def ocr_records(spark, sf_dir):
    """OCR results as nested JSON, a line of text for each line, flattened."""
    d = src.table(spark, sf_dir, "documents")
    lines = F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("text")))
    record = F.to_json(F.create_map(F.lit("page"), F.array(F.struct(lines.alias("text_lines")))))
    return d.select("doc_id", files.ocr_text(record).alias("text"))


@query("WITH d AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS ls FROM documents) SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS n_meta, array_to_string(CASE WHEN doc_id % 2 = 0 THEN ls ELSE list_concat(['meta'], ls) END, ' ') AS body FROM d")
def annotation_files(spark, sf_dir):
    """Annotation files: metadata and body by a mark in any spelling, all body without it."""
    d = src.table(spark, sf_dir, "documents")
    marked = F.concat(F.lit("meta\n"), F.when(F.col("doc_id") % 2 == 0, "===body  ===\n").otherwise(""), "text")
    return d.select("doc_id", files.annotation_parts(marked).alias("p")).select("doc_id", F.size("p.meta").alias("n_meta"), F.array_join("p.body", " ").alias("body"))


@query("SELECT doc_id, 'X' || doc_id || '.clauses' AS stem, 'a/b/X' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.clauses.json' ELSE '.clauses.json' END AS path FROM documents")
def file_names(spark, sf_dir):
    """Names of the next stage's files."""
    path = F.concat(F.lit("a/b/X"), "doc_id", F.when(F.col("doc_id") % 2 == 0, ".clauses.txt").otherwise(".clauses.md"))
    return src.table(spark, sf_dir, "documents").select("doc_id", files.stem(path).alias("stem"), files.next_name(path, ".txt", ".json").alias("path"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'inter' ELSE 'plain' END AS source FROM documents")
def preferred_graphs(spark, sf_dir):
    """Of two forms of a document's graph the one with links to others goes before the plain one."""
    d = src.table(spark, sf_dir, "documents").select("doc_id")
    return files.preferred(d.where("doc_id % 3 = 0").withColumn("source", F.lit("inter")), d.withColumn("source", F.lit("plain")), "doc_id")


@query("SELECT d.doc_id, coalesce(CASE WHEN doc_id % 2 = 0 THEN 'exact' END, CASE WHEN doc_id % 3 = 0 THEN 'below' END) AS found FROM documents d WHERE doc_id % 2 = 0 OR doc_id % 3 = 0")
def summaries_by_stem(spark, sf_dir):
    """A document's summary by its stem in the same folder, else anywhere below."""
    d = src.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("X"), "doc_id").alias("stem"))
    exact, below = d.where("doc_id % 2 = 0").select("stem", F.lit("exact").alias("found")), d.where("doc_id % 3 = 0").select("stem", F.lit("below").alias("found"))
    return d.join(files.preferred(exact, below, "stem"), "stem").select("doc_id", "found")


# Feature rows and ranking.


@query(f"{_rank_sql(3).rsplit(' SELECT doc_id, clause_id, round', 1)[0]}, pr AS (SELECT doc_id, clause_id, round(r / max(r) OVER (PARTITION BY doc_id), 6) AS pagerank FROM r3), o AS (SELECT doc_id, source AS clause_id, count(*) AS c FROM pairs GROUP BY ALL), i AS (SELECT doc_id, target AS clause_id, count(*) AS c FROM pairs GROUP BY ALL), su AS (SELECT doc_id, target AS clause_id, count(*) FILTER (relation = 'green_support') AS s, count(*) FILTER (relation = 'red_opposes') AS p FROM edges GROUP BY ALL), d AS (SELECT n.doc_id, n.clause_id, coalesce(i.c, 0) AS a, coalesce(o.c, 0) AS b FROM nodes n LEFT JOIN o USING (doc_id, clause_id) LEFT JOIN i USING (doc_id, clause_id)) SELECT doc_id, clause_id, pagerank, round(coalesce(a / nullif(max(a) OVER w, 0), 0), 6) AS in_degree, round(coalesce(b / nullif(max(b) OVER w, 0), 0), 6) AS out_degree, round(coalesce((a + b) / nullif(max(a + b) OVER w, 0), 0), 6) AS degree, coalesce(s, 0) AS support_in, coalesce(p, 0) AS opposition_in, round(coalesce(s, 0) / (coalesce(s, 0) + coalesce(p, 0) + 1), 6) AS support_ratio FROM d JOIN pr USING (doc_id, clause_id) LEFT JOIN su USING (doc_id, clause_id) WINDOW w AS (PARTITION BY doc_id)")
def centrality_features(spark, sf_dir):
    """The centrality row of every clause, with PageRank of three iterations; betweenness is compared elsewhere."""
    nodes, edges = nodes_of(spark, sf_dir), checkpointed(edges_of(spark, sf_dir))
    rank = centrality.pagerank(nodes, graph.simple_digraph(edges), 3)
    return features.graph_features(nodes, edges, rank).drop("betweenness")


@query(f"WITH {EDGES}, c AS (SELECT e.doc_id, e.source AS clause_id, count(*) AS c FROM edges e JOIN nodes s ON s.doc_id = e.doc_id AND s.clause_id = e.source JOIN nodes t ON t.doc_id = e.doc_id AND t.clause_id = e.target WHERE e.relation = 'green_support' AND s.label = 'Premise' AND t.label = 'Claim' GROUP BY ALL), r AS (SELECT *, CASE label WHEN 'Claim' THEN 1.0 WHEN 'Premise' THEN 0.7 WHEN 'Opposition' THEN 0.6 ELSE 0.5 END::DOUBLE AS w, (idx % 10) / 10.0 AS pr FROM nodes) SELECT r.doc_id, r.clause_id, w AS role_weight, round(w * (1 + 0.5 * pr) / max(w * (1 + 0.5 * pr)) OVER p, 6) AS role_boosted, round(coalesce(coalesce(c, 0) / nullif(max(coalesce(c, 0)) OVER p, 0), 0), 6) AS premise_support FROM r LEFT JOIN c USING (doc_id, clause_id) WINDOW p AS (PARTITION BY r.doc_id)")
def rhetorical_features(spark, sf_dir):
    nodes = nodes_of(spark, sf_dir)
    rank = nodes.select("doc_id", "clause_id", (F.col("idx") % 10 / 10.0).alias("pagerank"))
    return features.rhetorical_features(nodes, edges_of(spark, sf_dir), rank)


@query(f"""WITH {NODES}, c AS (SELECT doc_id, clause_id, idx, text || ' ' || {_CITING_SQL} AS t, count(*) OVER (PARTITION BY doc_id) AS n FROM nodes), x AS (SELECT *, {CITED_SQL} AS cs FROM c),
m AS (SELECT doc_id, clause_id, avg(CASE WHEN d LIKE 'SC_CA%' THEN 0.5 ELSE 0.0 END) AS m FROM (SELECT doc_id, clause_id, unnest(list_distinct(list_transform(list_filter(cs, lambda q: regexp_matches(q, '^SC/(CA|FR)/')), lambda q: replace(q, '/', '_')))) AS d FROM x) GROUP BY ALL),
s AS (SELECT *, len(cs) AS k, coalesce(len(cs) / nullif(max(len(cs)) OVER (PARTITION BY doc_id), 0), 0) AS sh FROM x)
SELECT s.doc_id, s.clause_id, k::INT AS citations, round(sh, 6) AS share, round(least(1.0, sh + 0.5 * coalesce(m, 0)), 6) AS citation_importance, CASE WHEN k = 0 THEN 0.0 WHEN idx / n > 0.2 AND idx / n < 0.8 THEN round(1 - 0.5 * idx / n, 6) ELSE 0.5 END AS citation_position FROM s LEFT JOIN m USING (doc_id, clause_id)""")
def citation_features(spark, sf_dir):
    """The citation row of every clause; precedents of type CA have importance 0.5 here."""
    nodes = nodes_of(spark, sf_dir).withColumn("text", F.concat("text", F.lit(" "), _CITING()))
    names = nodes.select(F.explode(F.filter(F.transform(citations.citations(F.col("text")), citations.cited_document), lambda x: x.isNotNull())).alias("name")).distinct()
    return features.citation_features(nodes, names.select("name", F.when(F.col("name").startswith("SC_CA"), 0.5).otherwise(0.0).alias("importance")))


@query(f"""WITH {VECTORS}, x AS (SELECT doc_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM vecs), m AS (SELECT doc_id, list(a ORDER BY i) AS c FROM (SELECT doc_id, i, avg(v) AS a FROM x GROUP BY ALL) GROUP BY doc_id),
f AS (SELECT v.doc_id, v.clause_id, max(list_cosine_similarity(v.embedding, o.embedding)) AS near FROM vecs v JOIN vecs o ON o.doc_id = v.doc_id AND o.idx < 2 GROUP BY ALL)
SELECT v.doc_id, v.clause_id, round((list_cosine_similarity(v.embedding, m.c) + 1) / 2, 5) AS centroid_similarity, round(greatest(0.0, least(1.0, 1 - coalesce(near, 0))), 5) AS diversity FROM vecs v JOIN m USING (doc_id) LEFT JOIN f USING (doc_id, clause_id)""")
def embedding_features(spark, sf_dir):
    """Similarity to the document's centre, and distance from its first two clauses."""
    v = vectors_of(spark, sf_dir)
    return features.embedding_features(v, v.where("idx < 2").select("doc_id", "embedding"))


def corpus_nodes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = vectors_of(spark, sf_dir).withColumn("name", src.case_id())
    bad = F.when(F.col("doc_id") % 50 == 7, F.lit(None)).otherwise(F.col("clause_id"))
    return v.withColumn("clause_id", bad), graph.build(vectors_of(spark, sf_dir), 0.2)


@query()
def ranking_driver(spark, sf_dir):
    """Every document's selection by all signals, in document order, as JSON records written and read back; faulty documents are set aside."""
    chosen, aside = features.rank_corpus(*corpus_nodes(spark, sf_dir), "balanced")
    at = files.scratch(spark, "ranked")
    files.clause_records(chosen, ["clause_id", "label", "score", "rank", "k", "forced", "doc_order"]).write.json(at)
    back = spark.read.schema("doc_id bigint, clauses array<struct<clause_id:int,label:string,score:double,rank:int,k:int,forced:boolean,doc_order:int>>").json(at)
    rows = back.select("doc_id", F.explode("clauses").alias("c")).select("doc_id", "c.*", F.lit(None).cast("string").alias("reason"))
    return rows.unionByName(aside.select("doc_id", "reason"), allowMissingColumns=True)


@query()
def ranking_summary(spark, sf_dir):
    return features.ranking_summary(*features.select_corpus(*corpus_nodes(spark, sf_dir), "balanced"))


_PRESET_SQL = {
    "conservative": "greatest(5, least(30, CAST(floor(n * 0.1) AS INT)))",
    "case_type_focused": "greatest(8, least(30, CAST(floor(n * CASE WHEN d % 2 = 0 THEN 0.13 ELSE 0.17 END) AS INT)))",
}
for _name, (_lo, _hi, _w) in {"balanced": (8, 30, (0.4, 0.3, 0.3)), "comprehensive": (10, 30, (0.3, 0.4, 0.3)), "context_rich": (20, 50, (0.4, 0.4, 0.2))}.items():
    _clamp = lambda x: f"greatest({_lo}, least({_hi}, CAST({x} AS INT)))"  # noqa: B023, E731
    _k = [_clamp("floor(n * CASE WHEN n < 100 THEN 0.20 WHEN n < 200 THEN 0.15 ELSE 0.10 END)"), _clamp("floor(n * (0.10 + CASE WHEN e / n < 2 THEN 0.0 WHEN e / n < 4 THEN 0.05 ELSE 0.10 END))"), _clamp("floor(n * CASE WHEN d % 2 = 0 THEN 0.13 ELSE 0.17 END)")]
    _PRESET_SQL[_name] = _clamp(f"round_even(round({_w[0]} * {_k[0]} + {_w[1]} * {_k[1]} + {_w[2]} * {_k[2]}, 6), 0)")


@query("SELECT doc_id, " + ", ".join(f"{_PRESET_SQL[p]} AS k_{p}" for p in features.PRESETS) + " FROM (SELECT doc_id, doc_id AS d, 1 + n_chars % 400 AS n, (n_chars * 7) % 1500 AS e FROM documents)")
def adaptive_k_presets(spark, sf_dir):
    d = src.table(spark, sf_dir, "documents").select("doc_id", (1 + F.col("n_chars") % 400).alias("n"), (F.col("n_chars") * 7 % 1500).alias("e"), ranking.case_type(src.case_id()).alias("t"))
    return d.select("doc_id", *[features.preset_k(F.col("n"), F.col("e"), F.col("t"), p).alias(f"k_{p}") for p in features.PRESETS])


_LABEL_CODES = {"Premise": 0, "None": 1, "Opposition": 2, "Claim": 3}


@query(f"WITH {CLAUSES} SELECT doc_id, clause_id, CASE label WHEN 'Premise' THEN 0 WHEN 'None' THEN 1 WHEN 'Opposition' THEN 2 WHEN 'Claim' THEN 3 END AS code, label AS decoded FROM clauses")
def label_codes(spark, sf_dir):
    """Labels as the classifier's codes and back."""
    code = F.create_map(*[F.lit(x) for kv in _LABEL_CODES.items() for x in kv])
    name = F.create_map(*[F.lit(x) for k, v in _LABEL_CODES.items() for x in (v, k)])
    return src.clauses(spark, sf_dir).select("doc_id", "clause_id", code[F.col("label")].alias("code")).withColumn("decoded", name[F.col("code")])


_RELATIONS = ["follows", "green_support", "red_opposes", "inter_citation"]


@query(f"WITH {EDGES}, y AS (SELECT doc_id, list(CASE label WHEN 'Premise' THEN 0 WHEN 'Opposition' THEN 1 ELSE 2 END ORDER BY idx) AS y FROM nodes GROUP BY doc_id), e AS (SELECT e.doc_id, count(*) AS n, sum(s.idx * 1000 + t.idx * 10 + CASE relation WHEN 'follows' THEN 0 WHEN 'green_support' THEN 1 ELSE 2 END)::BIGINT AS checksum FROM edges e JOIN nodes s ON s.doc_id = e.doc_id AND s.clause_id = e.source JOIN nodes t ON t.doc_id = e.doc_id AND t.clause_id = e.target GROUP BY e.doc_id) SELECT doc_id, array_to_string(y, ',') AS y, coalesce(n, 0) AS n_edges, coalesce(checksum, 0) AS checksum FROM y LEFT JOIN e USING (doc_id)")
def graph_tensors(spark, sf_dir):
    """Graphs as arrays of codes and dense indices."""
    rows = features.graph_tensor(nodes_of(spark, sf_dir), edges_of(spark, sf_dir), _RELATIONS, {"Premise": 0, "Opposition": 1, "Claim": 2})
    total = F.aggregate("edges", F.lit(0).cast("long"), lambda s, e: s + e["i"] * 1000 + e["j"] * 10 + e["kind"])
    return rows.select("doc_id", F.array_join(F.transform("y", lambda x: x.cast("string")), ",").alias("y"), F.coalesce(F.size("edges"), F.lit(0)).alias("n_edges"), F.coalesce(total, F.lit(0)).alias("checksum")).withColumn("n_edges", F.greatest(F.lit(0), "n_edges"))


@query(f"WITH {NODES} SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'clause_without_id' WHEN doc_id % 5 = 1 AND count(*) > 1 THEN 'edge_out_of_bounds' WHEN doc_id % 5 = 2 AND count(*) > 1 THEN 'unknown_relation' END AS reason FROM nodes GROUP BY doc_id")
def graph_validity(spark, sf_dir):
    """Why a document's graph cannot be ranked: faults planted by document."""
    nodes = nodes_of(spark, sf_dir)
    edges = graph.follows(nodes).withColumns({"target": F.when(F.col("doc_id") % 5 == 1, F.col("target") + 100_000).otherwise(F.col("target")), "relation": F.when(F.col("doc_id") % 5 == 2, "odd").otherwise(F.col("relation"))})
    own = nodes.withColumn("clause_id", F.when((F.col("doc_id") % 5 != 0) | (F.col("idx") > 0), F.col("clause_id")))
    return features.validity(own, edges)


@query(f"WITH {EDGES} SELECT doc_id, source, target, CASE relation WHEN 'green_support' THEN 'green' WHEN 'red_opposes' THEN 'red' ELSE 'gray' END AS colour, CASE relation WHEN 'follows' THEN 'dashed' ELSE 'solid' END AS style FROM edges")
def styled_edges(spark, sf_dir):
    """Edges with the colour and line of a picture."""
    r = F.col("relation")
    return edges_of(spark, sf_dir).select("doc_id", "source", "target", F.when(r == "green_support", "green").when(r == "red_opposes", "red").otherwise("gray").alias("colour"), F.when(r == "follows", "dashed").otherwise("solid").alias("style"))


# Dispositions on the documents' own clauses.
RULINGS = [
    "The appeal is dismissed with costs.", "I direct the registrar to send the record.", "No costs ordered in this matter.", "The parties lived at the same place.", "For the foregoing reasons the petition is allowed.", "He was paid with costs of the day.",
    "The State shall pay the costs", "that order will stand", "", "It was late.", "He went home.", "the day was long", "they met again", "the land was sold", "the deed was read", "the road was closed", "a notice came", "the term ended", "no one came", "the sum was paid",
]
_RULING, _RULING_SQL = planted(RULINGS, "doc_id * 3 + clause_id")
_RULED = f"{NODES}, ruled AS (SELECT doc_id, clause_id, idx, text || ' ' || {_RULING_SQL} AS text, (doc_id + clause_id) % 3 = 0 AS selected, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS rank FROM nodes)"
_JUDGED = f"""judged AS (SELECT *, {rlike("trim(text, ' ')", ranking.STRONG_DISPOSITIONS)} AS strong, {rlike('text', ranking.WEAK_DISPOSITIONS)} AS w0,
 CASE WHEN trim(text, ' ') = '' THEN 3 WHEN {rlike("trim(text, ' ')", ranking.MAIN_OUTCOMES)} THEN 1 WHEN {rlike("trim(text, ' ')", ranking.ORDERS)} THEN 2 WHEN {rlike("trim(text, ' ')", ranking.COSTS_ONLY)} THEN 3 ELSE 2 END AS priority FROM ruled)"""
_FORCED = "r AS (SELECT *, CASE WHEN bool_or(strong) OVER w THEN strong ELSE w0 AND NOT strong END AS required FROM judged WINDOW w AS (PARTITION BY doc_id)), c AS (SELECT *, bool_or(required AND selected) OVER (PARTITION BY doc_id) AS covered, row_number() OVER (PARTITION BY doc_id, required ORDER BY priority, idx DESC) AS b FROM r), f AS (SELECT *, required AND NOT covered AND b = 1 AS forced FROM c)"


def ruled_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes_of(spark, sf_dir).withColumn("rank", F.col("idx") + 1)
    return n.select("doc_id", "clause_id", "idx", F.concat("text", F.lit(" "), _RULING()).alias("text"), ((F.col("doc_id") + F.col("clause_id")) % 3 == 0).alias("selected"), "rank")


@query(f"WITH {_RULED}, {_JUDGED} SELECT doc_id, clause_id, strong, NOT strong AND w0 AS weak, priority FROM judged")
def dispositions_of_clauses(spark, sf_dir):
    return ranking.dispositions(ruled_nodes(spark, sf_dir)).select("doc_id", "clause_id", "strong", "weak", "priority")


@query(f"WITH {_RULED}, {_JUDGED}, {_FORCED} SELECT doc_id, clause_id, forced, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS INT) AS doc_order FROM f WHERE selected OR forced")
def guaranteed_dispositions(spark, sf_dir):
    return ranking.document_order(ranking.guarantee_disposition(ruled_nodes(spark, sf_dir))).select("doc_id", "clause_id", "forced", "doc_order")


@query(f"WITH {_RULED}, {_JUDGED}, {_FORCED}, l AS (SELECT *, max(CASE WHEN selected THEN rank END) OVER (PARTITION BY doc_id) AS last, bool_or(forced) OVER (PARTITION BY doc_id) AS af FROM f) SELECT doc_id, clause_id, forced FROM l WHERE forced OR (selected AND NOT (af AND rank = last))")
def replaced_dispositions(spark, sf_dir):
    """The forced disposition takes the place of the last selected clause."""
    return features.replace_disposition(ruled_nodes(spark, sf_dir)).where("selected").select("doc_id", "clause_id", "forced")


@query(f"WITH {_RULED}, {_JUDGED}, {_FORCED}, s AS (SELECT * FROM f WHERE selected OR forced) SELECT doc_id, coalesce(max(CASE WHEN forced THEN clause_id END), max(CASE WHEN required THEN clause_id END)) AS primary_id, arg_max(text, CASE WHEN forced THEN 1000000 + clause_id WHEN required THEN clause_id ELSE -1 END) AS text FROM s GROUP BY doc_id HAVING bool_or(required)")
def primary_dispositions(spark, sf_dir):
    """The disposition that stands for a document: the forced one, else the last one selected, with its text."""
    d = ranking.dispositions(ranking.guarantee_disposition(ruled_nodes(spark, sf_dir)))
    d = d.withColumn("required", F.when(F.max("strong").over(Window.partitionBy("doc_id")), F.col("strong")).otherwise(F.col("weak"))).where("selected and required")
    by = F.struct(F.col("forced").cast("int"), "clause_id")
    return d.groupBy("doc_id").agg(F.max_by("clause_id", by).alias("primary_id"), F.max_by("text", by).alias("text"))


# Languages, markers, summaries on the tables' own texts.
FOREIGN = ["", "\u0d85\u0db8", "\u0b85\u0bae", "\u0d85 \u0b85"]
_FOREIGN, _FOREIGN_SQL = planted(FOREIGN)


@query(rf"WITH {CLAUSES} SELECT doc_id, clause_id, CASE WHEN s AND t THEN 'mixed' WHEN s THEN 'sinhala' WHEN t THEN 'tamil' END AS lang FROM (SELECT doc_id, clause_id, regexp_matches(x, '[\x{{0D80}}-\x{{0DFF}}]') AS s, regexp_matches(x, '[\x{{0B80}}-\x{{0BFF}}]') AS t FROM (SELECT doc_id, clause_id, text || ' ' || {_FOREIGN_SQL} AS x FROM clauses))")
def language_tags(spark, sf_dir):
    return src.clauses(spark, sf_dir).select("doc_id", "clause_id", tx.language_tag(F.concat("text", F.lit(" "), _FOREIGN())).alias("lang"))


@query(rf"WITH {CLAUSES}, x AS (SELECT CASE WHEN regexp_matches({_FOREIGN_SQL}, '^[\x{{0D80}}-\x{{0DFF}}]') THEN 'sinhala' WHEN {_FOREIGN_SQL} <> '' THEN 'tamil' END AS lang FROM clauses) SELECT lang, count(*) AS n FROM x WHERE lang IS NOT NULL GROUP BY lang")
def language_counts(spark, sf_dir):
    """Clauses with a foreign block by the language of the first."""
    block = translate.first_block(F.concat("text", F.lit(" "), _FOREIGN()))
    rows = src.clauses(spark, sf_dir).select(block.alias("b")).where("b is not null")
    return rows.groupBy(F.col("b.lang").alias("lang")).agg(F.count(F.lit(1)).alias("n"))


ASKED = ["Q. ", "Q:", " A. ", "c: ", "C: ", "", "\u0db4\u0dd4: ", "\u0d8b: "]
_ASKED, _ASKED_SQL = planted(ASKED)


@query(f"WITH {CLAUSES}, x AS (SELECT doc_id, clause_id, trim({_ASKED_SQL} || text, ' ') AS t FROM clauses) SELECT doc_id, clause_id, CASE WHEN starts_with(t, chr(3508) || chr(3540) || ':') THEN 'Q:' || trim(substr(t, 4), ' ') WHEN starts_with(t, 'Q.') OR starts_with(t, 'Q:') THEN 'Q:' || trim(substr(t, 3), ' ') WHEN starts_with(t, 'A:') OR starts_with(t, 'A.') OR starts_with(t, chr(3467) || ':') OR starts_with(t, 'c:') OR starts_with(t, 'C:') THEN 'A:' || trim(substr(t, 3), ' ') ELSE t END AS line FROM x")
def marked_questions(spark, sf_dir):
    return src.clauses(spark, sf_dir).select("doc_id", "clause_id", tx.question_answer(F.concat(_ASKED(), "text")).alias("line"))


@query()
def question_pairs(spark, sf_dir):
    """Questions and answers in a foreign language between the lines of every text, paired."""
    t = F.concat(F.lit("Q. \u0d85\u0db8 "), "lang", F.lit(" A. \u0b85\u0bae A. \u0b85 Q: plain "), "doc_id", F.lit(" Q: \u0d85 C: \u0d85\u0db8."))
    return translate.question_answer_pairs(src.table(spark, sf_dir, "documents").select("doc_id", t.alias("text"))).select("doc_id", "place", "mark", "foreign", "lang", "pair")


@query()
def token_chunks(spark, sf_dir):
    """Every text in chunks of at most 200 words."""
    return src.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(translate.token_chunks(F.col("text"), 200)).alias("place", "chunk"))


LATEX = ["\\textbf{Order} of the {Court} $x_{2}$ \\n next", "plain <b>bold</b> &nbsp; \\emph{a b}  \\section c\\\\d", "\u201cquoted\u201d \u2018x\u2019 {}", ""]
_LATEX, _LATEX_SQL = planted(LATEX)


@query(rf"""WITH {CLAUSES}, x AS (SELECT doc_id, clause_id, text || ' ' || {_LATEX_SQL} AS t FROM clauses) SELECT doc_id, clause_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(t, '\n', chr(10)), '<[^>]+>', ' ', 'g'), '&[a-zA-Z]+;', ' ', 'g'), '\\[a-zA-Z]+\{{([^{{}}]*)\}}', '\1', 'g'), '\\[a-zA-Z]+', ' ', 'g'), '[{{}}]', ' ', 'g'), '\\', ' ', 'g'), '["“”‘’]+', '"', 'g'), '[ \t\n\x0B\f\r]{{2,}}', ' ', 'g'), '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g') AS text FROM x""")
def latex_of_clauses(spark, sf_dir):
    return src.clauses(spark, sf_dir).select("doc_id", "clause_id", tx.strip_latex(F.concat("text", F.lit(" "), _LATEX())).alias("text"))


_TAIL = ["the", "of", "and.", "", "here.", "and", "to", "end"]
_TAILS, _TAILS_SQL = planted(_TAIL)
_CUT = "'[ \\t\\n\\x0B\\f\\r]+'"


@query(f"""WITH {CLAUSES}, x AS (SELECT doc_id, clause_id, trim(text, ' ') || ' (a) it stays (b) too.' AS o, trim(CASE (doc_id + clause_id) % 3 WHEN 0 THEN upper(substr(text, 1, 1)) || substr(text, 2) || ' (a) it stays (b) ' || {_TAILS_SQL} WHEN 1 THEN 'In the United States ' || text || ' (a) (b).' ELSE substr(text, 1, 12) END, ' ') AS s FROM clauses),
g AS (SELECT *, lower(s) AS low, regexp_extract_all(s, '[A-Za-z0-9_]+|[ \\t\\n\\x0B\\f\\r]+|[^A-Za-z0-9_ \\t\\n\\x0B\\f\\r]') AS tk, list_transform(list_filter(regexp_split_to_array(s, '[.!?]'), lambda q: trim(q, ' ') <> ''), lambda q: lower(trim(q, ' '))) AS ss FROM x)
SELECT doc_id, clause_id, CASE WHEN length(s) < 15 THEN 'too_short' WHEN contains(s, 'United States') AND NOT contains(lower(o), 'united states') THEN 'invented_phrase'
 WHEN length(s) >= 30 AND NOT regexp_matches(s, '[.?!"'']$') AND list_contains(['the','a','an','of','and','to','in'], regexp_split_to_array(low, {_CUT})[-1]) THEN 'truncated'
 WHEN length(s) >= 25 AND (regexp_matches(s, '^\\p{{Ll}}') OR starts_with(low, 'of the ') OR starts_with(low, 'and the ') OR starts_with(low, 'but the ') OR starts_with(low, 'which ') OR starts_with(low, 'that the ')) THEN 'fragment' END AS reason FROM g""")
def early_guards(spark, sf_dir):
    """The first four guards on rewritings made from the clauses; later ones are null here."""
    up = F.concat(tx.upper_letter(F.substring("text", 1, 1)), F.substr("text", F.lit(2)))
    s = F.when((F.col("doc_id") + F.col("clause_id")) % 3 == 0, F.concat(up, F.lit(" (a) it stays (b) "), _TAILS())).when((F.col("doc_id") + F.col("clause_id")) % 3 == 1, F.concat(F.lit("In the United States "), "text", F.lit(" (a) (b)."))).otherwise(F.substring("text", 1, 12))
    reason = tx.guard(F.concat(F.trim("text"), F.lit(" (a) it stays (b) too.")), s)
    return src.clauses(spark, sf_dir).select("doc_id", "clause_id", F.when(reason.isin("too_short", "invented_phrase", "truncated", "fragment"), reason).alias("reason"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN trim('Key points stay ' || text, ' ') WHEN doc_id % 3 = 1 THEN trim(array_to_string(list_filter(string_split(text, chr(10)), lambda x: x <> ''), chr(10)), ' ') END AS summary FROM documents")
def summaries_chosen(spark, sf_dir):
    d = src.table(spark, sf_dir, "documents")
    final = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Key points (compressed from selected clauses) stay "), "text")).when(F.col("doc_id") % 3 == 1, "")
    return d.select("doc_id", tx.chosen_summary(final, F.when(F.col("doc_id") % 3 == 1, F.split("text", "\n"))).alias("summary"))


@query(r"SELECT doc_id, trim(regexp_replace('1. reason ' || string_split(text || chr(10) || 'Key holding', 'Key holding')[1], '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') AS reasoning FROM documents")
def reasoning_of_texts(spark, sf_dir):
    t = F.concat(F.lit("Lead.\nKey reasoning (compressed from selected clauses):\n1. reason "), "text", F.lit("\nKey holding (verbatim clause): h"))
    return src.table(spark, sf_dir, "documents").select("doc_id", tx.reasoning_part(t).alias("reasoning"))


SPOKEN = ["I find that we hold it.", "In my view I dismiss it.", "We are of it and I order so.", "it appears to me and I refuse.", "plain"]
_SPOKEN, _SPOKEN_SQL = planted(SPOKEN)


def _third_person_sql(c: str) -> str:
    out = f"trim({c}, ' ')"
    for pattern, to in tx.THIRD_PERSON:
        out = f"regexp_replace({out}, {quote('(?i)' + pattern)}, {quote(to)}, 'g')"
    return out


@query(f"WITH {CLAUSES} SELECT doc_id, clause_id, {_third_person_sql(_SPOKEN_SQL + " || ' ' || text")} AS line FROM clauses")
def third_person(spark, sf_dir):
    """Clauses that begin in the first person, rewritten."""
    return src.clauses(spark, sf_dir).select("doc_id", "clause_id", tx.third_person(F.concat(_SPOKEN(), F.lit(" "), "text")).alias("line"))


STARTS = ["but denied ", "But rather ", "even though held ", "even So ", "and the ", "but ", "plain "]
_START, _START_SQL = planted(STARTS)
_LOWER = lambda x: f"lower(substr({x}, 1, 1)) || substr({x}, 2)"


@query(f"""WITH {CLAUSES}, x AS (SELECT doc_id, clause_id, (doc_id + clause_id) % 7 AS k, trim({_START_SQL} || text, ' ') AS s, text AS t FROM clauses WHERE NOT starts_with(text, ' '))
SELECT doc_id, clause_id, CASE k WHEN 0 THEN 'The Court noted that the Respondent denied ' || rtrim(t, ' ') WHEN 1 THEN 'The Court noted that the provision applies rather ' || {_LOWER("rtrim(t, ' ')")} WHEN 2 THEN 'The Court noted that it held ' || rtrim(t, ' ') WHEN 3 THEN 'The Court noted that so ' || rtrim(t, ' ') WHEN 4 THEN 'The Court noted that ' || {_LOWER("rtrim(t, ' ')")} WHEN 5 THEN 'The Court noted that ' || CASE WHEN list_contains({listed(tx.VERBS_AFTER_CONJUNCTION)}, lower(regexp_split_to_array(t, '[ \t\n\x0B\f\r]+')[1])) THEN 'it ' ELSE '' END || {_LOWER("rtrim(t, ' ')")} ELSE 'plain ' || t END AS line FROM x""")
def conjunction_starts(spark, sf_dir):
    """Clauses that begin with a conjunction, as statements of what the Court noted."""
    return src.clauses(spark, sf_dir).where(~F.col("text").startswith(" ")).select("doc_id", "clause_id", tx.repaired_start(F.concat(_START(), "text")).alias("line"))


CASES = ["SC/CA/12/2010", "SC FR 4 2009", "SC Appeal No: 9/2011", "none", "SC/3/1999", "SC_CA_7_2010"]
_CASE, _CASE_SQL = planted(CASES)
_NUMBER = lambda c: "coalesce(" + ", ".join(f"CASE WHEN regexp_matches({c}, {quote(p)}) THEN regexp_extract({c}, {quote(p)}, 1) || '/' || regexp_extract({c}, {quote(p)}, 2) END" for p in citations.CASE_PATTERNS) + ")"


@query(f"WITH {CLAUSES}, x AS (SELECT doc_id, clause_id, {_CASE_SQL} || ' ' || text AS c, (CASE WHEN doc_id % 2 = 0 THEN 'SC_FR_' ELSE 'SC_CA_' END) || doc_id || '_2010' AS own FROM clauses), n AS (SELECT *, {_NUMBER('c')} AS n, {_NUMBER('own')} AS o FROM x) SELECT doc_id, clause_id, CASE WHEN n IS NOT NULL AND NOT coalesce(n = o, false) THEN 'SC_' || CASE WHEN regexp_matches(c, '(?i)SC[/\\s]?FR[/\\s]?') THEN 'FR' ELSE 'CA' END || '_' || replace(n, '/', '_') END AS name FROM n")
def citation_names(spark, sf_dir):
    """The document that a citation before a clause names; none for the document itself."""
    return src.clauses(spark, sf_dir).select("doc_id", "clause_id", citations.citation_name(F.concat(_CASE(), F.lit(" "), "text"), src.case_id()).alias("name"))


@query()
def clause_split(spark, sf_dir):
    """Clauses of every line of the texts, a marker planted in its middle."""
    marks = F.element_at(F.array(*map(F.lit, segment.MARKERS)), ((F.col("doc_id") + F.col("clause_id")) % len(segment.MARKERS) + 1).cast("int"))
    half = F.floor(F.length("text") / 2).cast("int")
    t = F.concat(F.substring("text", 1, 40), F.lit(" "), marks, F.lit(" "), F.substr("text", half + 1))
    return src.clauses(spark, sf_dir).select("doc_id", "clause_id", F.posexplode(segment.split_clauses(t)).alias("part", "clause"))


@query()
def line_edge_numbers(spark, sf_dir):
    """Every line of the texts with numbers written at its ends, without those that look like page numbers."""
    t = F.concat(F.col("pos") % 120, F.lit(" "), "line", F.lit(" "), F.col("doc_id") % 3000)
    return src.lines(src.table(spark, sf_dir, "documents")).select("doc_id", "pos", tx.edge_numbers(t).alias("cut"), tx.keep_safely(t, tx.edge_numbers(t)).alias("kept"))


# Routing, offsets, inputs, scores.


@query("WITH documents AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text || ' a;b;c' WHEN 1 THEN regexp_replace(text, '[^A-Za-z \\n.]', '', 'g') ELSE text END AS text FROM documents), g AS (" + SQL["garbled_pages_route"] + ") SELECT doc_id, CASE WHEN garbled OR trim(text, ' ') = '' THEN 'ocr' ELSE 'text' END AS route FROM g JOIN documents USING (doc_id)")
def page_routes(spark, sf_dir):
    """Garbled or blank pages go to the OCR hook, the others keep their text; a third is garbled on purpose, a third made plain."""
    d = src.table(spark, sf_dir, "documents")
    t = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" a;b;c"))).when(F.col("doc_id") % 3 == 1, F.regexp_replace("text", "[^A-Za-z \n.]", "")).otherwise(F.col("text"))
    return d.select("doc_id", F.when(tx.garbled(t) | (F.trim(t) == ""), "ocr").otherwise("text").alias("route"))


@query(f"WITH {LINES}, o AS (SELECT doc_id, pos, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos) AS e, length(line) + 1 AS n FROM lines) SELECT doc_id, min(pos) AS page, (300 - arg_min(e - n, pos))::BIGINT AS inside FROM o WHERE e >= 300 GROUP BY doc_id")
def offset_inside_page(spark, sf_dir):
    """The line ("page") that holds the offset 300, and the offset inside it."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    rows = src.lines(src.table(spark, sf_dir, "documents")).withColumn("n", F.length("line") + 1).withColumn("e", F.sum("n").over(w)).where("e >= 300")
    return rows.groupBy("doc_id").agg(F.min("pos").alias("page"), (300 - F.min_by(F.col("e") - F.col("n"), "pos")).alias("inside"))


@query(f"WITH {CLAUSES}, c AS (SELECT *, lag(text) OVER w AS p, lead(text) OVER w AS x FROM clauses WINDOW w AS (PARTITION BY doc_id ORDER BY clause_id)) SELECT doc_id, clause_id, concat_ws(' ', '[PREV] ' || trim(p, ' '), '[CURRENT] ' || trim(text, ' '), '[NEXT] ' || trim(x, ' ')) AS input FROM c")
def training_inputs(spark, sf_dir):
    """The trainer's input: one clause before, the clause, one behind."""
    part = lambda mark, c: F.when(F.trim(c) != "", F.concat(F.lit(mark), F.trim(c)))
    rows = context.with_context(src.clauses(spark, sf_dir))
    return rows.select("doc_id", "clause_id", F.concat_ws(" ", part("[PREV] ", "prev_text"), part("[CURRENT] ", "text"), part("[NEXT] ", "next_text")).alias("input"))


@query("WITH y AS (SELECT quality AS y, CASE WHEN d.n_chars > 600 THEN 1 ELSE 0 END AS p FROM labels JOIN documents d USING (doc_id)), k AS (SELECT unnest([0, 1]) AS class), c AS (SELECT class, count(*) FILTER (y = class) AS s, count(*) FILTER (p = class) AS m, count(*) FILTER (y = class AND p = class) AS h FROM y, k GROUP BY class), q AS (SELECT class, s, h, coalesce(h / nullif(m, 0), 0) AS p, coalesce(h / nullif(s, 0), 0) AS r FROM c), f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM q) SELECT round(avg(round(p, 6)), 5) AS macro_p, round(avg(round(r, 6)), 5) AS macro_r, round(avg(round(f1, 6)), 5) AS macro_f1, round(sum(h) / sum(s), 6) AS accuracy FROM f")
def classification_summary(spark, sf_dir):
    """Macro averages and accuracy."""
    rows = src.table(spark, sf_dir, "labels").join(src.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return evaluate.classification_summary(rows.select(F.col("quality").alias("y"), F.when(F.col("n_chars") > 600, 1).otherwise(0).alias("predicted")))


@query(f"WITH {CLAUSES}, s AS (SELECT label, count(*) AS n FROM clauses WHERE clause_id % 2 = 0 AND label <> 'None' GROUP BY label), e AS (SELECT d.label, coalesce(n, 0) AS n FROM (SELECT unnest(['Premise','None','Opposition','Claim']) AS label) d LEFT JOIN s USING (label)) SELECT label, n, round(CASE WHEN n > 0 THEN sum(n) OVER () / (count(*) FILTER (n > 0) OVER () * n) ELSE 1.0 END, 6) AS weight FROM e")
def masked_class_weights(spark, sf_dir):
    rows = src.clauses(spark, sf_dir).select("label", ((F.col("clause_id") % 2 == 0) & (F.col("label") != "None")).alias("mask"))
    return features.masked_class_weights(rows, src.LABELS)


@query(f"WITH p AS (SELECT a.doc_id AS id, a.text AS reference, b.text AS candidate FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1), s AS (SELECT id, coalesce(round({WORDS('reference')} / nullif({WORDS('candidate')}, 0), 6), 0) AS ratio, CASE WHEN id % 3 > 0 THEN length(reference) END AS chars FROM p) SELECT count(*) AS n, count(ratio) AS n_ratio, round(avg(ratio), 4) AS mean_ratio, round(stddev_pop(ratio), 4) AS std_ratio, count(chars) AS n_chars, round(avg(chars), 4) AS mean_chars, round(stddev_pop(chars), 4) AS std_chars FROM s")
def evaluation_summary(spark, sf_dir):
    """Means and deviations of the scores that rows have."""
    rows = paired(spark, sf_dir).select(evaluate.compression(F.col("reference"), F.col("candidate")).alias("ratio"), F.when(F.col("id") % 3 > 0, F.length("reference")).alias("chars"))
    return headnotes.evaluation_summary(rows, ["ratio", "chars"])


_TAILS_OF_NAMES = [" SILVA v Perera and Others ", " silva v perera ", " perera said others; silva came and went ", " Silva alone "]
_NAME_TAIL, _NAME_TAIL_SQL = planted(_TAILS_OF_NAMES, "doc_id")


@query(f"SELECT doc_id, contains(t, 'silva v perera') OR (contains(t, 'silva') AND contains(t, 'perera') AND contains(t, 'and')) AS found FROM (SELECT doc_id, lower(text || {_NAME_TAIL_SQL}) AS t FROM documents)")
def names_found(spark, sf_dir):
    """A case name in a text: as it is, without others, by its longer words, or not at all."""
    return src.table(spark, sf_dir, "documents").select("doc_id", evaluate.name_found(F.lit("Silva v Perera and others"), F.concat("text", _NAME_TAIL())).alias("found"))


# Hooks for models.


@query(f"WITH {CLAUSES} SELECT doc_id, clause_id, ['Premise','None','Opposition','Claim'][CAST(CAST('0x' || substr(md5(text), 1, 1) AS INT) % 4 AS INT) + 1] AS predicted FROM clauses")
def model_labels(spark, sf_dir):
    """The classifier hook with its stand-in."""
    rows = context.with_context(src.clauses(spark, sf_dir))
    return rows.select("doc_id", "clause_id", models.classify(F.col("text"), F.col("prev_text"), F.col("prev_text_1"), models.stand_in_classifier).alias("predicted"))


@query(f"WITH {CLAUSES} SELECT doc_id, clause_id, length(text)::DOUBLE AS a, (length(text) - length(replace(text, ' ', '')))::DOUBLE AS b, (length(text) - length(replace(text, 'e', '')))::DOUBLE AS c FROM clauses")
def model_vectors(spark, sf_dir):
    """The encoder hook with its stand-in."""
    v = src.clauses(spark, sf_dir).withColumn("v", models.embed(F.col("text"), models.stand_in_encoder))
    return v.select("doc_id", "clause_id", *[F.element_at("v", i).cast("double").alias(n) for i, n in enumerate("abc", 1)])


@query(f"WITH {CLAUSES} SELECT doc_id, clause_id, replace(text, 'e', '3') AS text FROM clauses")
def model_translations(spark, sf_dir):
    """The translator hook with its stand-in."""
    return src.clauses(spark, sf_dir).select("doc_id", "clause_id", models.rewrite(F.col("text"), models.stand_in_translator).alias("text"))


@query(f"WITH {PAIRS}, x AS (SELECT doc_id, source AS clause_id, target AS near FROM pairs UNION SELECT doc_id, target, source FROM pairs UNION SELECT doc_id, clause_id, clause_id FROM nodes), u AS (SELECT x.doc_id, x.clause_id, unnest(v.embedding) AS e, unnest(range(len(v.embedding))) AS i FROM x JOIN vecs v ON v.doc_id = x.doc_id AND v.clause_id = x.near) SELECT doc_id, clause_id, round(sum(a * (i + 1)), 4) AS checksum FROM (SELECT doc_id, clause_id, i, avg(e) AS a FROM u GROUP BY ALL) GROUP BY ALL")
def graph_vectors(spark, sf_dir):
    """The graph encoder hook with its stand-in."""
    v = vectors_of(spark, sf_dir)
    rows = models.graph_vectors(v, graph.simple_digraph(checkpointed(graph.build(v, 0.2))))
    total = F.aggregate(F.transform("vector", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return rows.select("doc_id", "clause_id", F.round(total, 4).alias("checksum"))


@query("SELECT vec_id, round(list_avg(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 5) AS pooled FROM embeddings")
def pooled_vectors(spark, sf_dir):
    """Mean pooling over tokens with a mask: every number of a vector is a token of one dimension, and one is masked out."""
    e = src.table(spark, sf_dir, "embeddings")
    tokens = F.concat(F.transform("embedding", lambda x: F.array(x.cast("double"))), F.array(F.array(F.lit(99.0))))
    mask = F.concat(F.transform("embedding", lambda x: F.lit(1)), F.array(F.lit(0)))
    return e.select("vec_id", F.round(models.mean_pooled(tokens, mask)[0], 5).alias("pooled"))
