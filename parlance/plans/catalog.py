"""The registered queries, by name, with their SQL for a second engine.

Clause texts come from the lines of ``documents``; labels, embeddings and case names are the
stand-ins of ``sources.tables``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parlance.functions import text as tx
from parlance.functions.vectors import cosine
from parlance.operators import centrality, citations, context, evaluate, graph, ranking, segment, structure, summarize, translate
from parlance.runtime import checkpointed
from parlance.sources import tables as src

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The semantic threshold on these tables; the default of the operator hits nothing here.
THRESHOLD = 0.2


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


# SQL building blocks.
LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM documents)"
CLAUSES = LINES + """, numbered AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS INT) AS clause_id, trim(line, ' ') AS text FROM lines WHERE trim(line, ' ') <> ''),
clauses AS (SELECT *, ['Premise','None','Opposition','Claim'][CAST((doc_id * 7 + clause_id) % 4 AS INT) + 1] AS label FROM numbered)"""
NODES = CLAUSES + ", nodes AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY clause_id) - 1 AS INT) AS idx FROM clauses WHERE label <> 'None')"
VECTORS = NODES + ", vecs AS (SELECT n.*, CAST(e.embedding AS DOUBLE[]) AS embedding FROM nodes n JOIN embeddings e ON e.vec_id = (n.doc_id * 31 + n.clause_id) % (SELECT count(*) FROM embeddings))"
FOLLOWS = "follows AS (SELECT doc_id, clause_id AS source, lead(clause_id) OVER (PARTITION BY doc_id ORDER BY idx) AS target, 'follows' AS relation, 1.0::DOUBLE AS score FROM nodes QUALIFY target IS NOT NULL)"
SEMANTIC = f"""forward AS MATERIALIZED (SELECT a.doc_id, a.clause_id AS source, b.clause_id AS target, a.idx AS i, b.idx AS j, round(list_cosine_similarity(a.embedding, b.embedding), 6) AS score
  FROM vecs a JOIN vecs b ON a.doc_id = b.doc_id AND b.idx - a.idx BETWEEN 1 AND 10),
semantic AS (SELECT * FROM forward WHERE score >= {THRESHOLD} UNION ALL SELECT doc_id, target, source, j, i, score FROM forward WHERE score >= {THRESHOLD})"""
PRUNED = """outs AS (SELECT * FROM semantic QUALIFY row_number() OVER (PARTITION BY doc_id, source ORDER BY score DESC, j) <= 3),
pruned AS (SELECT * FROM outs QUALIFY row_number() OVER (PARTITION BY doc_id, target ORDER BY score DESC, i) <= 3)"""
TYPED = """typed AS (SELECT p.doc_id, p.source, p.target, CASE WHEN s.label = 'Opposition' OR t.label = 'Opposition' THEN 'red_opposes' ELSE 'green_support' END AS relation, p.score
  FROM pruned p JOIN nodes s ON s.doc_id = p.doc_id AND s.clause_id = p.source JOIN nodes t ON t.doc_id = p.doc_id AND t.clause_id = p.target)"""
EDGES = f"""{VECTORS}, {FOLLOWS}, {SEMANTIC}, {PRUNED}, {TYPED},
edges AS (SELECT doc_id, source, target, relation, score FROM (SELECT *, 0 AS o FROM follows UNION ALL SELECT *, 1 AS o FROM typed) QUALIFY row_number() OVER (PARTITION BY doc_id, source, target, relation ORDER BY o, score DESC) = 1)"""
PAIRS = EDGES + """, pairs AS (SELECT doc_id, source, target, arg_max(w, o) AS weight, arg_max(relation, o) AS relation FROM (SELECT *, CASE relation WHEN 'green_support' THEN 1.0 WHEN 'red_opposes' THEN 0.8 ELSE 0.5 END::DOUBLE * score AS w, (relation <> 'follows')::INT::VARCHAR || relation AS o FROM edges) GROUP BY doc_id, source, target)"""
WORDS = lambda c: f"len(list_filter(regexp_split_to_array({c}, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> ''))"
FACTOR = lambda c: f"CASE WHEN {WORDS(c)} < 10 THEN 0.5 WHEN {WORDS(c)} > 100 THEN 0.8 ELSE 1.0 END"
POSITION = "CASE WHEN p < 0.20 THEN 0.35 WHEN p < 0.60 THEN 0.55 WHEN p < 0.85 THEN 0.70 ELSE 0.95 + 0.05 * greatest(0.0, least(1.0, (p - 0.85) / 0.15)) END"


def quote(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


def rlike(c: str, patterns: list[str]) -> str:
    return f"regexp_matches({c}, {quote(tx.any_of(patterns))})"


def nodes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.labelled_nodes(src.clauses(spark, sf_dir))


def vectors_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.stand_in_embeddings(nodes_of(spark, sf_dir), src.table(spark, sf_dir, "embeddings"))


def edges_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.build(vectors_of(spark, sf_dir), THRESHOLD)


# Flagship: the best clauses of every document.
RANKED_SQL = f"""{NODES}, c AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM nodes),
p AS (SELECT *, CASE WHEN n <= 1 THEN 0.5 ELSE idx / (n - 1) END AS p, CASE label WHEN 'Claim' THEN 1.0 WHEN 'Premise' THEN 0.7 WHEN 'Opposition' THEN 0.6 ELSE 0.5 END AS rw FROM c),
r AS (SELECT *, round((0.20 * rw / max(rw) OVER (PARTITION BY doc_id) + 0.05 * ({POSITION})) * (0.9 + 0.1 * {FACTOR('text')}), 9) AS raw FROM p),
s AS (SELECT *, round(CASE WHEN max(raw) OVER w > min(raw) OVER w THEN (raw - min(raw) OVER w) / (max(raw) OVER w - min(raw) OVER w) ELSE 0.5 END, 6) AS score FROM r WINDOW w AS (PARTITION BY doc_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, idx) AS rank, greatest(5, least(50, CAST(floor(n * 0.15) AS INT))) AS k FROM s)"""


@query(f"WITH {RANKED_SQL} SELECT doc_id, clause_id, label, score, CAST(rank AS INT) AS rank, k FROM k WHERE rank <= k")
def top_clauses_per_document(spark, sf_dir):
    nodes = nodes_of(spark, sf_dir).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("doc_id")))
    top = F.max("rw").over(Window.partitionBy("doc_id"))
    rows = nodes.withColumn("rw", ranking.role_weight(F.col("label")))
    rows = rows.withColumn("raw", F.round((0.20 * F.col("rw") / top + 0.05 * ranking.position_score(ranking.position(F.col("idx"), F.col("n")))) * (0.9 + 0.1 * tx.length_factor(F.col("text"))), 9))
    rows = ranking.ranked(rows.withColumn("score", F.round(ranking.min_max("raw"), 6)))
    k = ranking.adaptive_k(F.col("n"), F.lit(0), F.lit(None), "percentage")
    return rows.withColumn("k", k).where(F.col("rank") <= F.col("k")).select("doc_id", "clause_id", "label", "score", "rank", "k")


@query(f"WITH {CLAUSES}, c AS (SELECT label, count(*) AS n FROM clauses GROUP BY label) SELECT d.label, coalesce(n, 0) AS n, round(100.0 * coalesce(n, 0) / sum(coalesce(n, 0)) OVER (), 2) AS percent FROM (SELECT unnest(['Premise','None','Opposition','Claim']) AS label) d LEFT JOIN c USING (label)")
def label_distribution(spark, sf_dir):
    return context.label_distribution(src.clauses(spark, sf_dir))


@query(f"WITH {CLAUSES} SELECT label, count(*) AS clauses, count(DISTINCT doc_id) AS documents FROM clauses GROUP BY ROLLUP (label)")
def corpus_label_rollup(spark, sf_dir):
    return context.corpus_rollup(src.clauses(spark, sf_dir))


@query("SELECT conv_id, turn, lag(text) OVER w AS prev_text, lag(text, 2) OVER w AS prev_text_1, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def context_lag_lead(spark, sf_dir):
    return context.with_context(src.table(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", "prev_text", "prev_text_1", "next_text")


@query(f"WITH {CLAUSES}, c AS (SELECT *, lag(text) OVER w AS p, lag(text, 2) OVER w AS p1 FROM clauses WINDOW w AS (PARTITION BY doc_id ORDER BY clause_id)) SELECT doc_id, clause_id, concat_ws(' ', '[PREV_1] ' || trim(p1, ' '), '[PREV] ' || trim(p, ' '), '[CURRENT] ' || trim(text, ' ')) AS input FROM c")
def context_string(spark, sf_dir):
    return context.context_string(context.with_context(src.clauses(spark, sf_dir))).select("doc_id", "clause_id", "input")


@query("WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id::VARCHAR || '-42')) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT doc_id FROM documents)) SELECT doc_id, CASE WHEN r <= floor(n * 0.7) THEN 'train' WHEN r <= floor(n * 0.7) + floor(n * 0.15) THEN 'val' ELSE 'test' END AS part FROM r")
def doc_split_train_val_test(spark, sf_dir):
    return context.split_documents(src.table(spark, sf_dir, "documents"))


@query(f"""WITH {NODES}, s AS (SELECT * FROM nodes), c AS (SELECT label, count(*) AS c, max(count(*)) OVER () AS m FROM s GROUP BY label),
r AS (SELECT s.*, c.c, c.m, row_number() OVER (PARTITION BY s.label ORDER BY md5(doc_id::VARCHAR || '-' || clause_id::VARCHAR)) AS r FROM s JOIN c USING (label))
SELECT label, count(*) AS n, count(DISTINCT doc_id) AS documents, sum(clause_id)::BIGINT AS clause_sum FROM (SELECT *, unnest(range(CAST(m // c + CASE WHEN r <= m % c THEN 1 ELSE 0 END AS BIGINT))) FROM r) GROUP BY label""")
def upsample_balance(spark, sf_dir):
    return context.upsample(nodes_of(spark, sf_dir)).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("documents"), F.sum("clause_id").alias("clause_sum"))


@query(f"WITH {CLAUSES}, c AS (SELECT label, count(*) AS n FROM clauses GROUP BY label) SELECT label, n, round(sum(n) OVER () / (4 * n), 6) AS weight FROM c")
def class_weights(spark, sf_dir):
    return context.class_weights(src.clauses(spark, sf_dir))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&[a-zA-Z]+;', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') AS text FROM pages")
def html_strip(spark, sf_dir):
    return src.table(spark, sf_dir, "pages").select("page_id", tx.strip_html(F.col("html")).alias("text"))


HARD = "[bcdfghjklmnpqrstvwxzBCDFGHJKLMNPQRSTVWXZ;=]"


@query(rf"""WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws, regexp_extract_all(text, '(?s)[(\["“‘](.+?)[)\]”’"]', 1) AS qs FROM documents)
SELECT doc_id, regexp_matches(text, '[\x{{0D80}}-\x{{0DFF}}úïñÿ]') OR len(list_filter(ws, lambda x: length(x) - length(replace(x, ';', '')) > 1 OR length(x) - length(replace(x, ',', '')) > 1 OR regexp_matches(x, '[<>{{}}^+@\\|]') OR (NOT regexp_matches(x, '^\p{{Lu}}') AND regexp_matches(x, '{HARD}{{5,}}')))) > 0 OR len(list_filter(qs, lambda x: regexp_matches(x, '{HARD}{{4,}}'))) > 0 AS garbled FROM w""")
def garbled_pages_route(spark, sf_dir):
    return src.table(spark, sf_dir, "documents").select("doc_id", tx.garbled(F.col("text")).alias("garbled"))


@query(rf"WITH {LINES} SELECT doc_id, count(*) FILTER ({rlike('line', tx.PAGE_LINES)}) AS page_lines, count(*) AS lines FROM (SELECT * FROM lines UNION ALL SELECT doc_id, 'Page ' || doc_id || ' of 9', 0 FROM documents) GROUP BY doc_id")
def page_number_lines(spark, sf_dir):
    docs = src.table(spark, sf_dir, "documents")
    rows = src.lines(docs).select("doc_id", "line").union(docs.select("doc_id", F.concat(F.lit("Page "), F.col("doc_id"), F.lit(" of 9"))))
    return rows.groupBy("doc_id").agg(F.count_if(tx.page_line(F.col("line"))).alias("page_lines"), F.count(F.lit(1)).alias("lines"))


HEADED = "headed AS (SELECT doc_id, pos, 'SC Appeal ' || doc_id || ' page ' || line || ' end of line' AS line FROM lines UNION ALL SELECT doc_id, 1000000, 'a lone line' FROM documents)"


def headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a header and a footer written on, and one line without."""
    docs = src.table(spark, sf_dir, "documents")
    marked = src.lines(docs).select("doc_id", F.col("pos").cast("int").alias("pos"), F.concat(F.lit("SC Appeal "), "doc_id", F.lit(" page "), "line", F.lit(" end of line")).alias("line"))
    return marked.union(docs.select("doc_id", F.lit(1000000), F.lit("a lone line")))


@query(rf"""WITH {LINES}, {HEADED}, k AS (SELECT * FROM headed WHERE trim(line, ' ') <> ''), t AS (SELECT doc_id, count(*) AS lines FROM k GROUP BY doc_id),
w AS (SELECT doc_id, pos, list_filter(regexp_split_to_array(line, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')[1:20] AS ws FROM k),
a AS (SELECT doc_id, pos, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM w), n AS (SELECT doc_id, i, word, count(*) AS c, min(pos) AS first FROM a WHERE lower(word) NOT IN ('page', 'pages') GROUP BY ALL),
b AS (SELECT n.*, c / lines >= 0.55 AS ok FROM n JOIN t USING (doc_id) QUALIFY row_number() OVER (PARTITION BY doc_id, i ORDER BY c DESC, first) = 1),
r AS (SELECT *, bool_and(ok) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM b) SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS header, count(*) AS n_words FROM r WHERE run GROUP BY doc_id""")
def header_detect(spark, sf_dir):
    return segment.header(headed(spark, sf_dir))


@query(rf"""WITH {LINES}, {HEADED}, k AS (SELECT * FROM headed WHERE trim(line, ' ') <> ''), t AS (SELECT doc_id, count(*) AS lines FROM k GROUP BY doc_id),
w AS (SELECT doc_id, pos, list_filter(regexp_split_to_array(line, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM k), e AS (SELECT doc_id, pos, ws, unnest(range(1, least(20, len(ws)) + 1)) AS k FROM w),
n AS (SELECT doc_id, k, array_to_string(ws[len(ws) - k + 1:], ' ') AS tail, count(*) AS c, min(pos) AS first FROM e GROUP BY ALL), f AS (SELECT n.* FROM n JOIN t USING (doc_id) WHERE c / lines >= 0.55 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k DESC, c DESC, first) = 1)
SELECT doc_id, tail AS footer, k AS n_words, c AS n_lines FROM f""")
def footer_detect(spark, sf_dir):
    return segment.footer(headed(spark, sf_dir))


@query(f"WITH {NODES}, {FOLLOWS} SELECT doc_id, source, target, relation, score FROM follows")
def sequential_edges(spark, sf_dir):
    return graph.follows(nodes_of(spark, sf_dir))


@query(f"WITH {VECTORS}, {SEMANTIC} SELECT doc_id, source, target, score FROM semantic")
def semantic_edges(spark, sf_dir):
    return graph.semantic(vectors_of(spark, sf_dir), THRESHOLD).select("doc_id", "source", "target", "score")


@query(f"WITH {VECTORS}, {SEMANTIC}, {PRUNED} SELECT doc_id, source, target, score FROM pruned")
def edges_pruned_topk(spark, sf_dir):
    return graph.prune(graph.semantic(vectors_of(spark, sf_dir), THRESHOLD)).select("doc_id", "source", "target", "score")


@query(f"WITH {EDGES} SELECT doc_id, source, target, relation, score FROM edges")
def argument_graph(spark, sf_dir):
    return edges_of(spark, sf_dir)


@query(f"""WITH {EDGES}, n AS (SELECT doc_id, count(*) AS n_nodes, count(*) FILTER (label = 'Claim') AS n_claim, count(*) FILTER (label = 'Premise') AS n_premise, count(*) FILTER (label = 'Opposition') AS n_opposition FROM nodes GROUP BY doc_id),
e AS (SELECT doc_id, count(*) AS n_edges, count(*) FILTER (relation = 'follows') AS n_follows, count(*) FILTER (relation = 'green_support') AS n_green_support, count(*) FILTER (relation = 'red_opposes') AS n_red_opposes FROM edges GROUP BY doc_id)
SELECT n.*, coalesce(n_edges, 0) AS n_edges, coalesce(n_follows, 0) AS n_follows, coalesce(n_green_support, 0) AS n_green_support, coalesce(n_red_opposes, 0) AS n_red_opposes FROM n LEFT JOIN e USING (doc_id)""")
def graph_stats(spark, sf_dir):
    return graph.stats(nodes_of(spark, sf_dir), edges_of(spark, sf_dir))


@query(f"WITH {PAIRS} SELECT doc_id, source, target, round(weight, 6) AS weight, relation FROM pairs")
def simple_digraph(spark, sf_dir):
    return graph.simple_digraph(edges_of(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


@query(f"""WITH {PAIRS}, o AS (SELECT doc_id, source AS clause_id, count(*) AS c FROM pairs GROUP BY ALL), i AS (SELECT doc_id, target AS clause_id, count(*) AS c FROM pairs GROUP BY ALL),
d AS (SELECT n.doc_id, n.clause_id, coalesce(i.c, 0) AS a, coalesce(o.c, 0) AS b FROM nodes n LEFT JOIN o USING (doc_id, clause_id) LEFT JOIN i USING (doc_id, clause_id))
SELECT doc_id, clause_id, round(coalesce(a / nullif(max(a) OVER w, 0), 0), 6) AS in_degree, round(coalesce(b / nullif(max(b) OVER w, 0), 0), 6) AS out_degree, round(coalesce((a + b) / nullif(max(a + b) OVER w, 0), 0), 6) AS degree FROM d WINDOW w AS (PARTITION BY doc_id)""")
def degree_centrality(spark, sf_dir):
    return centrality.degrees(nodes_of(spark, sf_dir), graph.simple_digraph(edges_of(spark, sf_dir)))


@query(f"""WITH {EDGES}, c AS (SELECT doc_id, target AS clause_id, count(*) FILTER (relation = 'green_support') AS s, count(*) FILTER (relation = 'red_opposes') AS o FROM edges GROUP BY ALL)
SELECT n.doc_id, n.clause_id, coalesce(s, 0) AS support_in, coalesce(o, 0) AS opposition_in, round(coalesce(s, 0) / (coalesce(s, 0) + coalesce(o, 0) + 1), 6) AS support_ratio FROM nodes n LEFT JOIN c USING (doc_id, clause_id)""")
def support_opposition(spark, sf_dir):
    return centrality.support(nodes_of(spark, sf_dir), edges_of(spark, sf_dir))


@query(f"""WITH {EDGES}, c AS (SELECT e.doc_id, e.source AS clause_id, count(*) AS c FROM edges e JOIN nodes s ON s.doc_id = e.doc_id AND s.clause_id = e.source JOIN nodes t ON t.doc_id = e.doc_id AND t.clause_id = e.target WHERE e.relation = 'green_support' AND s.label = 'Premise' AND t.label = 'Claim' GROUP BY ALL)
SELECT n.doc_id, n.clause_id, round(coalesce(coalesce(c, 0) / nullif(max(coalesce(c, 0)) OVER (PARTITION BY n.doc_id), 0), 0), 6) AS premise_support FROM nodes n LEFT JOIN c USING (doc_id, clause_id)""")
def premise_support(spark, sf_dir):
    return centrality.premise_support(nodes_of(spark, sf_dir), edges_of(spark, sf_dir))


def _rank_sql(k: int) -> str:
    out = f"""WITH {PAIRS}, share AS (SELECT doc_id, source, target, weight / sum(weight) OVER (PARTITION BY doc_id, source) AS p FROM pairs),
r0 AS (SELECT doc_id, clause_id, count(*) OVER (PARTITION BY doc_id) AS n, NOT EXISTS (SELECT 1 FROM pairs x WHERE x.doc_id = nodes.doc_id AND x.source = nodes.clause_id) AS d, 1.0 / count(*) OVER (PARTITION BY doc_id) AS r FROM nodes)"""
    for i in range(k):
        out += f""", g{i} AS (SELECT s.doc_id, s.target AS clause_id, sum(r.r * s.p) AS g FROM share s JOIN r{i} r ON r.doc_id = s.doc_id AND r.clause_id = s.source GROUP BY ALL),
r{i + 1} AS (SELECT r.doc_id, r.clause_id, n, d, 0.85 * (coalesce(g, 0) + sum(CASE WHEN d THEN r ELSE 0 END) OVER (PARTITION BY r.doc_id) / n) + 0.15 / n AS r FROM r{i} r LEFT JOIN g{i} g USING (doc_id, clause_id))"""
    return out + f" SELECT doc_id, clause_id, round(r / max(r) OVER (PARTITION BY doc_id), 6) AS pagerank FROM r{k}"


@query(_rank_sql(3))
def pagerank_k_iter(spark, sf_dir):
    return centrality.pagerank(nodes_of(spark, sf_dir), graph.simple_digraph(edges_of(spark, sf_dir)), 3)


@query()
def pagerank_converged(spark, sf_dir):
    return centrality.converged_pagerank(nodes_of(spark, sf_dir), graph.simple_digraph(edges_of(spark, sf_dir)))


@query()
def betweenness(spark, sf_dir):
    return centrality.betweenness(nodes_of(spark, sf_dir), graph.simple_digraph(edges_of(spark, sf_dir)))


@query(f"""WITH {VECTORS}, x AS (SELECT doc_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM vecs), m AS (SELECT doc_id, list(a ORDER BY i) AS c FROM (SELECT doc_id, i, avg(v) AS a FROM x GROUP BY ALL) GROUP BY doc_id)
SELECT v.doc_id, v.clause_id, round((list_cosine_similarity(v.embedding, m.c) + 1) / 2, 5) AS centroid_similarity FROM vecs v JOIN m USING (doc_id)""")
def centroid_similarity(spark, sf_dir):
    v = vectors_of(spark, sf_dir)
    at = v.select("doc_id", F.posexplode("embedding").alias("i", "x")).groupBy("doc_id", "i").agg(F.avg("x").alias("a"))
    c = at.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "a"))), lambda s: s["a"]).alias("c"))  # one vector
    return v.join(c, "doc_id").select("doc_id", "clause_id", F.round((cosine(F.col("embedding"), F.col("c")) + 1) / 2, 5).alias("centroid_similarity"))


CITING = [
    (1, "SC Appeal No 12/2010 was followed"), (2, "see (SC Appeal No 123/2010) and SC/FR/7/2011"), (3, "SC FR No 4/2009; S.C. Appeal No: 5/2012"), (4, "nothing here"), (5, "SC/CA/9/2001 SC/CA/9/2001 sc/8/2002"), (6, None),
]
CITED_SQL = "list_sort(list_distinct(flatten([" + ", ".join(
    f"list_transform(regexp_extract_all(t, {quote('(?i)' + p)}, 0), lambda m: CASE WHEN contains(upper(m), 'FR') THEN 'SC/FR/' ELSE '{k}' END || regexp_extract(m, {quote('(?is)^' + ('' if p[:2] in (chr(92) + '(', chr(92) + '[') else '.*?') + p)}, 1) || '/' || regexp_extract(m, {quote('(?is)^' + ('' if p[:2] in (chr(92) + '(', chr(92) + '[') else '.*?') + p)}, 2))"
    for p, k in citations.CITATION_PATTERNS
) + "])))"


NAMED = "named AS (SELECT (CASE WHEN doc_id % 2 = 0 THEN 'SC_FR_' ELSE 'SC_CA_' END) || doc_id || '_2010' AS name, 'cites SC/' || (CASE WHEN doc_id % 3 = 0 THEN 'FR' ELSE 'CA' END) || '/' || (doc_id // 2) || '/2010 and SC/CA/' || (doc_id % 7) || '/2010' AS t FROM documents)"


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = src.table(spark, sf_dir, "documents")
    text = F.concat(F.lit("cites SC/"), F.when(F.col("doc_id") % 3 == 0, "FR").otherwise("CA"), F.lit("/"), F.floor(F.col("doc_id") / 2), F.lit("/2010 and SC/CA/"), F.col("doc_id") % 7, F.lit("/2010"))
    return d.select(src.case_id().alias("name"), text.alias("text"))


GRAPH_SQL = f"{NAMED}, x AS (SELECT name AS doc, unnest({CITED_SQL}) AS c FROM named), g AS (SELECT DISTINCT doc, replace(c, '/', '_') AS cited FROM x WHERE regexp_matches(c, '^SC/(CA|FR)/\\d+/\\d{{4}}$') AND replace(c, '/', '_') <> doc)"


@query(f"WITH {GRAPH_SQL} SELECT doc, cited FROM g")
def citation_graph(spark, sf_dir):
    return citations.citation_graph(named(spark, sf_dir))


@query(f"""WITH {GRAPH_SQL}, c AS (SELECT doc, cited, unnest(ns) AS name, unnest(range(len(ns))) AS o FROM (SELECT *, CASE WHEN starts_with(cited, 'SC_CA_') THEN ['SC_' || substr(cited, 7), 'SC_FR_' || substr(cited, 7), cited] ELSE [cited] END AS ns FROM g))
SELECT doc, cited, arg_min(name, o) AS found FROM c WHERE name IN (SELECT name FROM named) GROUP BY doc, cited""")
def citation_lookup(spark, sf_dir):
    rows = named(spark, sf_dir)
    return citations.resolve(citations.citation_graph(rows), rows)


@query(f"""WITH {VECTORS}, s AS (SELECT doc_id * 1000 + clause_id AS source_id, (doc_id + 1) AS target_doc, embedding FROM vecs), j AS (SELECT source_id, s.target_doc, v.clause_id AS target_clause, round(list_cosine_similarity(s.embedding, v.embedding), 6) AS s FROM s JOIN vecs v ON v.doc_id = s.target_doc)
SELECT source_id, target_doc, target_clause, s AS similarity FROM j WHERE s > 0.15 - 0.01 QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY s DESC, target_clause) = 1""")
def nearest_target_clause(spark, sf_dir):
    v = vectors_of(spark, sf_dir)
    s = v.select((F.col("doc_id") * 1000 + F.col("clause_id")).alias("source_id"), (F.col("doc_id") + 1).alias("target_doc"), "embedding")
    return citations.nearest_clause(s, v, 0.15)


def _k_sql(name: str) -> str:
    clamp = lambda x: f"greatest(5, least(50, CAST({x} AS INT)))"
    length = clamp("floor(n * CASE WHEN n < 100 THEN 0.20 WHEN n < 200 THEN 0.15 ELSE 0.10 END)")
    density = clamp("floor(n * (0.10 + CASE WHEN e / n < 2 THEN 0.0 WHEN e / n < 4 THEN 0.05 ELSE 0.10 END))")
    case = clamp("floor(n * CASE WHEN d % 2 = 0 THEN 0.13 ELSE 0.17 END)")
    return {"length": length, "complexity": density, "case_type": case, "percentage": clamp("floor(n * 0.15)"), "hybrid": clamp(f"round_even(round(0.4 * {length} + 0.3 * {density} + 0.3 * {case}, 6), 0)")}[name]


@query("SELECT doc_id, " + ", ".join(f"{_k_sql(m)} AS k_{m}" for m in ("percentage", "length", "complexity", "case_type", "hybrid")) + " FROM (SELECT doc_id, doc_id AS d, 1 + n_chars % 400 AS n, (n_chars * 7) % 1500 AS e FROM documents)")
def adaptive_k_all_methods(spark, sf_dir):
    d = src.table(spark, sf_dir, "documents").select("doc_id", (1 + F.col("n_chars") % 400).alias("n"), (F.col("n_chars") * 7 % 1500).alias("e"), ranking.case_type(src.case_id()).alias("t"))
    return d.select("doc_id", *[ranking.adaptive_k(F.col("n"), F.col("e"), F.col("t"), m).alias(f"k_{m}") for m in ("percentage", "length", "complexity", "case_type", "hybrid")])


@query()
def hybrid_ranking(spark, sf_dir):
    """All signals: graph, roles, citations, embeddings, position; scores, ranks and an adaptive selection."""
    v = vectors_of(spark, sf_dir)
    edges = checkpointed(edges_of(spark, sf_dir))
    pairs = graph.simple_digraph(edges)
    nodes = v.drop("embedding")
    pr = centrality.converged_pagerank(nodes, pairs)
    be = centrality.betweenness(nodes, pairs)
    su = centrality.support(nodes, edges).select("doc_id", "clause_id", "support_in")
    ci = citations.counts(nodes).select("doc_id", "clause_id", F.col("share").alias("citation"))
    rows = nodes
    for signal in (pr, be, su, ci, centroid_similarity(spark, sf_dir)):
        rows = rows.join(signal, ["doc_id", "clause_id"])
    scored = ranking.ranked(ranking.hybrid_score(rows.withColumn("name", src.case_id())))
    scored = scored.join(edges.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_edges")), "doc_id", "left")
    k = ranking.adaptive_k(F.col("n"), F.coalesce("n_edges", F.lit(0)), ranking.case_type(F.col("name")), "hybrid")
    return scored.select("doc_id", "clause_id", "label", "score", "rank", k.alias("k")).where(F.col("rank") <= F.col("k"))


@query(f"""WITH {VECTORS}, s AS (SELECT *, (clause_id * 37 + doc_id) % 11 / 10.0 AS score FROM vecs), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, idx) AS rank FROM s)
SELECT a.doc_id, a.clause_id, round(a.score * CASE WHEN EXISTS (SELECT 1 FROM r b WHERE b.doc_id = a.doc_id AND b.rank < a.rank AND b.score > 0 AND list_cosine_similarity(a.embedding, b.embedding) >= 0.3) THEN 0.93 ELSE 1 END, 6)::DOUBLE AS score FROM r a""")
def dedup_penalty(spark, sf_dir):
    rows = vectors_of(spark, sf_dir).withColumn("score", ((F.col("clause_id") * 37 + F.col("doc_id")) % 11) / 10.0)
    return ranking.dedup_penalty(rows, 0.3).select("doc_id", "clause_id", "score")


@query()
def mmr_selection(spark, sf_dir):
    rows = vectors_of(spark, sf_dir).withColumn("score", ((F.col("clause_id") * 37 + F.col("doc_id")) % 11) / 10.0)
    return ranking.mmr(rows, 5)


@query()
def structured_summary(spark, sf_dir):
    picked = top_clauses_per_document(spark, sf_dir).select("doc_id", "clause_id").join(src.clauses(spark, sf_dir), ["doc_id", "clause_id"])
    w = Window.partitionBy("doc_id").orderBy("clause_id")
    rows = summarize.safe_rewrite(picked).withColumns({"doc_order": F.row_number().over(w), "holding": F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("clause_id"))) == 1, "case_type": ranking.case_type(src.case_id())})
    return summarize.structured(rows)


PAIRED = "pairs AS (SELECT a.doc_id AS id, a.text AS reference, b.text AS candidate FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1)"


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = src.table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.col("text").alias("reference")).join(d.select((F.col("doc_id") - 1).alias("id"), F.col("text").alias("candidate")), "id")


def _gram_sql(n: int) -> str:
    toks = lambda c: f"list_filter(regexp_split_to_array(lower({c}), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')"
    side = lambda c: f"SELECT id, array_to_string(ws[i:i + {n - 1}], ' ') AS g, count(*) AS c FROM (SELECT id, ws, unnest(range(1, len(ws) - {n} + 2)) AS i FROM (SELECT id, {toks(c)} AS ws FROM pairs)) GROUP BY ALL"
    return f"r{n} AS ({side('reference')}), c{n} AS ({side('candidate')}), o{n} AS (SELECT id, sum(coalesce(r.c, 0)) AS n_ref, sum(coalesce(c.c, 0)) AS n_cand, sum(least(coalesce(r.c, 0), coalesce(c.c, 0))) AS common FROM r{n} r FULL JOIN c{n} c USING (id, g) GROUP BY id), s{n} AS (SELECT p.id, coalesce(common / nullif(n_cand, 0), 0) AS p, coalesce(common / nullif(n_ref, 0), 0) AS r FROM pairs p LEFT JOIN o{n} USING (id))"


@query(f"WITH {PAIRED}, {_gram_sql(1)} SELECT id, round(p, 6) AS p, round(r, 6) AS r, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM s1")
def eval_rouge1(spark, sf_dir):
    return evaluate.rouge_n(paired(spark, sf_dir), 1)


@query(f"WITH {PAIRED}, {_gram_sql(2)} SELECT id, round(p, 6) AS p, round(r, 6) AS r, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM s2")
def eval_rouge2(spark, sf_dir):
    return evaluate.rouge_n(paired(spark, sf_dir), 2)


@query(f"""WITH {PAIRED}, {_gram_sql(1)}, {_gram_sql(2)}, {_gram_sql(3)}, {_gram_sql(4)}, l AS (SELECT id, {WORDS('reference')} AS a, {WORDS('candidate')} AS b FROM pairs)
SELECT l.id, round(CASE WHEN least(s1.p, s2.p, s3.p, s4.p) > 0 THEN CASE WHEN b > a THEN 1.0 ELSE exp(1 - a / b) END * exp((ln(s1.p) + ln(s2.p) + ln(s3.p) + ln(s4.p)) / 4) ELSE 0 END, 6) AS bleu FROM l JOIN s1 USING (id) JOIN s2 USING (id) JOIN s3 USING (id) JOIN s4 USING (id)""")
def eval_bleu(spark, sf_dir):
    return evaluate.bleu(paired(spark, sf_dir))


@query("WITH y AS (SELECT quality AS y, CASE WHEN d.n_chars > 600 THEN 1 ELSE 0 END AS p FROM labels JOIN documents d USING (doc_id)), k AS (SELECT unnest([0, 1]) AS class), c AS (SELECT class, count(*) FILTER (y = class) AS s, count(*) FILTER (p = class) AS m, count(*) FILTER (y = class AND p = class) AS h FROM y, k GROUP BY class), q AS (SELECT class, s, coalesce(h / nullif(m, 0), 0) AS p, coalesce(h / nullif(s, 0), 0) AS r FROM c) SELECT class, s AS support, round(p, 6) AS p, round(r, 6) AS r, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM q")
def classification_report(spark, sf_dir):
    rows = src.table(spark, sf_dir, "labels").join(src.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return evaluate.classification_report(rows.select(F.col("quality").alias("y"), F.when(F.col("n_chars") > 600, 1).otherwise(0).alias("predicted")))


@query("SELECT round(avg(n_chars), 4) AS mean_n_chars, round(stddev_pop(n_chars), 4) AS std_n_chars FROM documents")
def eval_mean_std(spark, sf_dir):
    return evaluate.mean_std(src.table(spark, sf_dir, "documents"), ["n_chars"])


@query(f"WITH {PAIRED} SELECT id, coalesce(round({WORDS('reference')} / nullif({WORDS('candidate')}, 0), 6), 0) AS ratio FROM pairs")
def compression_ratio(spark, sf_dir):
    return paired(spark, sf_dir).select("id", evaluate.compression(F.col("reference"), F.col("candidate")).alias("ratio"))


@query("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def unmatched_documents(spark, sf_dir):
    return context.undone(src.table(spark, sf_dir, "documents"), src.table(spark, sf_dir, "labels"), "doc_id").select("doc_id")


@query(f"WITH {EDGES} SELECT doc_id, count(*) AS edges, round(sum(score), 5) AS total FROM edges GROUP BY doc_id")
def graph_json_roundtrip(spark, sf_dir):
    """Edges of a document as one JSON text and back."""
    e = edges_of(spark, sf_dir)
    text = e.groupBy("doc_id").agg(F.to_json(F.collect_list(F.struct("source", "target", "relation", "score"))).alias("json"))  # one document's edges
    back = text.select("doc_id", F.explode(F.from_json("json", "array<struct<source:int,target:int,relation:string,score:double>>")).alias("e"))
    return back.groupBy("doc_id").agg(F.count(F.lit(1)).alias("edges"), F.round(F.sum("e.score"), 5).alias("total"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN len(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '')) ELSE 0 END AS n, CASE WHEN doc_id % 2 = 0 THEN 'meta' || chr(10) || '=== BODY ===' || chr(10) || array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> ''), lambda x: trim(x, ' ')), ' ') ELSE text END AS joined FROM documents")
def marked_body(spark, sf_dir):
    d = src.table(spark, sf_dir, "documents")
    marked = d.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("meta\n=== BODY ===\n"), "text")).otherwise(F.col("text")).alias("t"))
    return marked.select("doc_id", F.size(tx.body_lines(F.col("t"))).alias("n"), tx.joined_body(F.col("t")).alias("joined"))


_JOINED = "regexp_replace(regexp_replace(regexp_replace(replace(text, '-' || chr(10), ''), '([a-z])\\n([a-z])', '\\1 \\2', 'g'), ',\\n([a-z])', ', \\1', 'g'), '([^.!?])\\n([a-z])', '\\1 \\2', 'g')"


@query(f"SELECT doc_id, regexp_replace(replace(regexp_replace(replace(regexp_replace({_JOINED}, '\\n{{2,}}', chr(1), 'g'), chr(10), ' '), ' {{2,}}', ' ', 'g'), chr(1), chr(10) || chr(10)), '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g') AS text FROM documents")
def paragraph_cleaning(spark, sf_dir):
    return src.table(spark, sf_dir, "documents").select("doc_id", tx.clean_paragraphs(F.col("text")).alias("text"))


@query("SELECT doc_id, CAST(row_number() OVER (ORDER BY doc_id) AS INT) AS place FROM documents")
def natural_order(spark, sf_dir):
    rows = src.table(spark, sf_dir, "documents").select("doc_id", tx.natural_key(F.concat(F.lit("Case"), "doc_id", F.lit(".txt"))).alias("k"))
    return context.ordered_ranks(rows, "k").select("doc_id", F.col("rank").cast("int").alias("place"))


def _precedent_sql(k: int) -> str:
    out = f"{GRAPH_SQL}, names AS (SELECT DISTINCT name FROM (SELECT doc AS name FROM g UNION ALL SELECT cited FROM g)), o AS (SELECT doc AS name, count(*) AS o FROM g GROUP BY doc), q0 AS (SELECT name, o, 1.0 / count(*) OVER () AS r FROM names LEFT JOIN o USING (name))"
    for i in range(k):
        out += f", h{i} AS (SELECT g.cited AS name, sum(r / o) AS got FROM g JOIN q{i} q ON q.name = g.doc GROUP BY g.cited), q{i + 1} AS (SELECT name, o, 0.85 * (coalesce(got, 0) + sum(CASE WHEN o IS NULL THEN r ELSE 0 END) OVER () / count(*) OVER ()) + 0.15 / count(*) OVER () AS r FROM q{i} LEFT JOIN h{i} USING (name))"
    return out + f", pr AS (SELECT name, round(r / max(r) OVER (), 6) AS importance FROM q{k})"


@query(f"WITH {_precedent_sql(3)} SELECT name, importance FROM pr")
def precedent_rank(spark, sf_dir):
    return citations.precedent_rank(citations.citation_graph(named(spark, sf_dir)), 3)


@query(f"""WITH {_precedent_sql(3)}, t AS (SELECT name, {CITED_SQL} AS cs FROM named), m AS (SELECT x.who AS name, avg(coalesce(pr.importance, 0)) AS m FROM (SELECT name AS who, unnest(list_distinct(list_transform(list_filter(cs, lambda x: regexp_matches(x, '^SC/(CA|FR)/')), lambda x: replace(x, '/', '_')))) AS c FROM t) x LEFT JOIN pr ON pr.name = x.c GROUP BY x.who)
SELECT t.name AS doc_id, 1 AS clause_id, round(least(1.0, CASE WHEN len(cs) > 0 THEN 1.0 ELSE 0.0 END + 0.5 * coalesce(m, 0)), 6) AS citation_importance FROM t LEFT JOIN m USING (name)""")
def citation_importance(spark, sf_dir):
    rows = named(spark, sf_dir)
    return citations.importance(rows.select(F.col("name").alias("doc_id"), F.lit(1).alias("clause_id"), "text"), citations.precedent_rank(citations.citation_graph(rows), 3))


@query(f"WITH {NODES}, n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM nodes) SELECT doc_id, clause_id, CASE WHEN (doc_id + clause_id) % 2 = 1 THEN 0.0 WHEN idx / n > 0.2 AND idx / n < 0.8 THEN round(1 - 0.5 * idx / n, 6) ELSE 0.5 END AS score FROM n")
def citation_position(spark, sf_dir):
    n = nodes_of(spark, sf_dir).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("doc_id")))
    return n.select("doc_id", "clause_id", F.round(citations.position_score((F.col("doc_id") + F.col("clause_id")) % 2 == 0, F.col("idx"), F.col("n")), 6).alias("score"))


@query(f"WITH {GRAPH_SQL}, c AS (SELECT doc, cited, unnest(ns) AS name, unnest(range(len(ns))) AS o FROM (SELECT *, CASE WHEN starts_with(cited, 'SC_CA_') THEN ['SC_' || substr(cited, 7), 'SC_FR_' || substr(cited, 7), cited] ELSE [cited] END AS ns FROM g)), f AS (SELECT doc, cited, arg_min(name, o) AS found FROM c WHERE name IN (SELECT name FROM named) GROUP BY doc, cited) SELECT doc AS doc_id, '1' AS source, found || '::clause_2' AS target, 'inter_citation' AS relation, found AS cited_doc FROM f")
def inter_document_edges(spark, sf_dir):
    found = citation_lookup(spark, sf_dir)
    return citations.external_edges(found.select("doc", F.lit(1).alias("source"), "found", F.lit(2).alias("target_clause")))


@query(f"WITH {LINES} SELECT doc_id, pos, line FROM lines QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) = 1")
def first_seen_lines(spark, sf_dir):
    return citations.first_seen(src.lines(src.table(spark, sf_dir, "documents")), ["doc_id", "line"], "pos").select("doc_id", "pos", "line")


@query(f"WITH {LINES}, o AS (SELECT doc_id, pos, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos) AS e FROM lines) SELECT doc_id, min(pos) AS page, arg_min(e, pos)::BIGINT AS page_end FROM o WHERE e >= 300 GROUP BY doc_id")
def page_of_offset(spark, sf_dir):
    """The line ("page") that holds the offset 300, by running lengths."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    rows = src.lines(src.table(spark, sf_dir, "documents")).withColumn("e", F.sum(F.length("line") + 1).over(w)).where("e >= 300")
    return rows.groupBy("doc_id").agg(F.min("pos").alias("page"), F.min_by("e", "pos").alias("page_end"))


@query("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INT) AS best FROM embeddings")
def argmax_logits(spark, sf_dir):
    return src.table(spark, sf_dir, "embeddings").select("vec_id", (F.array_position("embedding", F.array_max("embedding")) - 1).cast("int").alias("best"))


@query()
def sentence_split(spark, sf_dir):
    d = src.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(structure.repair_sentences(structure.sentences(structure.clean_body(F.col("text"))))).alias("pos", "sentence"))


@query("SELECT doc_id, 'x §SIG0001. y ' || doc_id || ' §SIG0002' AS signed, 2 AS n, 'x ' || chr(3461) || chr(3512) || '. y ' || doc_id || ' ' || chr(2949) AS restored, chr(3461) || chr(3512) AS first_block FROM documents")
def foreign_blocks(spark, sf_dir):
    text = F.concat(F.lit("x අම. y "), F.col("doc_id"), F.lit(" அ"))
    rows = src.table(spark, sf_dir, "documents").select("doc_id", text.alias("t")).withColumn("s", translate.signed(F.col("t")))
    return rows.select("doc_id", F.col("s.text").alias("signed"), F.size("s.signs").alias("n"), translate.restored(F.col("s.text"), F.col("s.signs")).alias("restored"), translate.first_block(F.col("t"))["text"].alias("first_block"))


@query()
def eval_rouge_l(spark, sf_dir):
    return evaluate.rouge_l(paired(spark, sf_dir))


def queries() -> dict[str, Query]:
    from parlance.plans import more  # noqa: F401  registers its queries

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from parlance.plans import more  # noqa: F401

    return dict(SQL)
