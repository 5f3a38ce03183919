"""The pipeline's stages against brute-force versions on the smallest tables."""

import corpus_pipeline
import importlib.util
from pathlib import Path
from parlance.llm import pfp_dedup

_spec = importlib.util.spec_from_file_location("llm_brute", Path(__file__).parent / "test_llm_operators.py")
brute = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(brute)


def test_stages(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.toPandas()
        stage(spark, docs, small).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = (before, docs.toPandas())
        if name != "tokens":
            assert docs.columns == columns
    before, after = seen["quality_rules"]
    failed = {i for i, t in zip(before["doc_id"], before["text"], strict=True) if (n := brute.measured(t))[0] < 50 or 100 * n[4] > 50 * n[0]}
    assert failed and not failed & set(after["doc_id"])
    before, after = seen["near_duplicates"]
    order = before.sort_values("doc_id")
    ids = order["doc_id"].tolist()
    assert sorted(after["doc_id"]) == sorted({ids[c] for _, c in brute.joined(order["text"])})
    before, after = seen["repeated_passages"]
    order, after = before.sort_values("doc_id"), after.sort_values("doc_id")
    want = pfp_dedup.brute_force([t.encode() for t in order["text"]])
    assert [w[0] - w[1] for w in want] == [len(t.encode()) for t in after["text"]]
    before, after = seen["source_mix"]
    words = lambda f: sum(len(brute.WORD.findall(t)) for t in f["text"])
    assert abs(words(after) - 1.5 * words(before)) <= before["source"].nunique()
    assert len(seen["tokens"][1]) == len(after)
