"""The queries opN_<name> over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parlance.llm import forced_bpe, kd_shard, license_scan, media_ts, mixing, ngram_join, pfp_dedup, rule_ensemble, rule_ledger, style_tree
from parlance.llm.bytekit import table


def byte_vocabulary() -> str:
    """Where the public byte-level vocabulary lies; it is installed beside the library, not part of it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_ts.read_back(media_ts.store(table(spark, sf_dir, "documents")))


def op2_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shard.shard(table(spark, sf_dir, "documents"), leaves=16)


def op3_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style_tree.extract(table(spark, sf_dir, "pages"))


def op4_pfp_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfp_dedup.digest(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "passes", "extra_shard", "pass_shards")


def op7_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rule_ensemble.score(docs, rule_ensemble.fit(docs, table(spark, sf_dir, "labels")))


def op8_forced_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forced_bpe.digest(table(spark, sf_dir, "documents"), byte_vocabulary())


def op9_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = rule_ledger.apply_policy(rule_ledger.ledger(table(spark, sf_dir, "documents")))
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


#: op9 by lists and joins over words; lines and words are cut as in the operator.
OP9_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS k, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
tri AS (SELECT k, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT k, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM tri) WHERE c > 1),
cov AS (SELECT k, count(DISTINCT i + o) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS o) GROUP BY k),
lin AS (SELECT k, unnest(string_split(t, chr(10))) AS l FROM d),
dup AS (SELECT k, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n FROM lin WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY k),
m AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(w.t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(w.t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
    coalesce(dup.n_lines, 0) AS n_lines, length(regexp_replace(w.t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(w.t, '[^A-Za-z]', '', 'g')) AS n_letters, length(regexp_replace(w.t, '[^!]', '', 'g')) AS n_shouts
  FROM d JOIN w USING (k) LEFT JOIN cov USING (k) LEFT JOIN dup USING (k)),
b AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END + CASE WHEN 5 * n_symbols > n_words THEN 4 ELSE 0 END
    + CASE WHEN n_lines >= 4 AND 10 * n_dup_lines > 6 * n_lines THEN 8 ELSE 0 END + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END
    + CASE WHEN n_letters >= 20 AND 10 * n_upper > 7 * n_letters THEN 64 ELSE 0 END + CASE WHEN 4 * n_shouts > n_words THEN 128 ELSE 0 END)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b
"""


def oracle_sql() -> dict[str, str]:
    return {"op9_rule_ledger": OP9_SQL}
