"""Registered queries against a second engine, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from parlance.plans import catalog

CHECKED = ["top_clauses_per_document", "label_distribution", "context_string", "header_detect", "argument_graph", "degree_centrality", "citation_lookup", "adaptive_k_all_methods", "guaranteed_dispositions", "early_guards", "page_routes", "headnote_sections", "graph_files", "citation_features", "graph_tensors", "model_labels", "conjunction_starts", "eval_rouge2", "classification_report", "citation_importance", "marked_body", "citation_names", "page_of_offset", "third_person", "foreign_blocks", "metadata_of_documents"]


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("None" if x is None or x != x else f"{x:.6g}" if isinstance(x, float) else str(x) for x in r) for r in frame.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", CHECKED)
def test_same_rows(spark, small, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "conversations", "benchmark"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    got, want = catalog.queries()[name](spark, small).toPandas(), db.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) and rows(got) == rows(want)


def test_early_guards_on_letters_whose_case_changes_their_number(spark, tmp_path):
    texts = ["ßabcdefg", "ŉabcdefg", "ﬁab cdefghi", "ᾳabcdefg", "ǰabcdefgh and more", "Unİted States or United States", "plain text of it"]
    pd.DataFrame({"doc_id": [24 * i + j for i in range(len(texts)) for j in (0, 23)], "text": [t for t in texts for _ in range(2)]}).to_parquet(tmp_path / "documents.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    got, want = catalog.queries()["early_guards"](spark, str(tmp_path)).toPandas(), db.sql(catalog.oracle_sql()["early_guards"]).df()
    assert len(got) == 14 and rows(got) == rows(want)
