"""Rule bitmask ledger.

Every rule is evaluated once for each document; its failure becomes a bit of
``fail_bits`` and what it measured stays in a column.  A policy is a named version: a
mask over those bits.  Changing or comparing policies is then a bitwise test of the
ledger and never reads a text again; the ablation of a policy is an aggregation over
the few distinct bit patterns.

Defined cases: a null or empty text has no words and fails ``too_few_words``; repeated
rows give repeated ledger rows; extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm import bytekit as bk

SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LETTER = _UPPER.copy()
_LETTER[0x61:0x7B] = True
_SHOUT = np.zeros(256, bool)
_SHOUT[0x21] = True

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_shouts")


def measure_group(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The measurements of every document of a group."""
    n_docs = len(offs) - 1
    start, end, first = bk.words(buf, offs)
    in_word = ~bk.SPACE[buf]
    lead = (buf & 0xC0) != 0x80
    out = {
        "n_words": np.diff(first),
        "word_chars": bk.sums_by_document(in_word & lead, offs),
        "n_symbols": bk.sums_by_document(_SYMBOL[buf], offs),
        "n_upper": bk.sums_by_document(_UPPER[buf], offs),
        "n_letters": bk.sums_by_document(_LETTER[buf], offs),
        "n_shouts": bk.sums_by_document(_SHOUT[buf], offs),
    }
    # Lines: cut at \n and at document edges; only lines that hold a word count.
    cuts = np.flatnonzero(buf == 0x0A)
    line_start = np.union1d(offs[:-1], cuts + 1)
    line_start = line_start[line_start < len(buf)]
    line_end = np.append(line_start[1:], len(buf))[: len(line_start)]
    line_end = np.where(np.isin(line_end, offs), line_end, line_end - 1) if len(line_end) else line_end
    # A line that ends at a document edge may still end in \n itself.
    ends_in_cut = (line_end > line_start) & (buf[np.maximum(line_end - 1, 0)] == 0x0A) if len(buf) else np.zeros(0, bool)
    line_end = line_end - ends_in_cut
    has_word = np.searchsorted(start, line_end, "left") > np.searchsorted(start, line_start, "left")
    line_start, line_end = line_start[has_word], line_end[has_word]
    line_doc = np.searchsorted(offs, line_start, "right") - 1
    out["n_lines"] = np.bincount(line_doc, minlength=n_docs)[:n_docs]
    key = bk.mix(bk.range_hashes(buf, line_start, line_end) ^ bk.mix(line_doc.astype(np.uint64) + np.uint64(1)))
    kept = np.unique(key, return_index=True)[1]
    out["n_dup_lines"] = out["n_lines"] - np.bincount(line_doc[kept], minlength=n_docs)[:n_docs]
    # Three-word windows that occur again in the same document.
    h = bk.word_hashes(buf, start, end)
    doc = np.searchsorted(first, np.arange(len(start)), "right") - 1
    repeated = np.zeros(len(start), bool)
    if len(h) >= 3:
        at = np.flatnonzero(doc[2:] == doc[:-2])
        tri = bk.mix(bk.mix(bk.mix(h[at] + doc[at].astype(np.uint64)) ^ h[at + 1]) * np.uint64(3) ^ h[at + 2])
        _, back, count = np.unique(tri, return_inverse=True, return_counts=True)
        at = at[count[back] > 1]
        for k in range(3):
            repeated[at + k] = True
    out["n_repeat_words"] = bk.sums_by_document(repeated, first)
    return out


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offs in bk.groups(batch, "text"):
                got = measure_group(buf, offs)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(got[m].astype(np.int64)) for m in MEASURES)], ["doc_id", *MEASURES])

    docs = bk.bounded_batches(docs.select("doc_id", "text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return bk.map_arrow(docs, run, f"doc_id {kind}, " + ", ".join(f"{m} long" for m in MEASURES))


def passing(docs: DataFrame, policy: str | None = None) -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with their own columns."""
    kept = bk.bounded_batches(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offs in bk.groups(batch, "text"):
                got = measure_group(buf, offs)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(got[m].astype(np.int64)) for m in MEASURES)], ["row", *MEASURES])

    rows = bk.map_arrow(kept, run, f"row {kept.schema['row'].dataType.simpleString()}, " + ", ".join(f"{m} long" for m in MEASURES))
    return apply_policy(with_bits(rows), policy or CURRENT).where("kept").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def with_bits(measured: DataFrame) -> DataFrame:
    bits = F.lit(0).cast("long")
    for name, failed in rules().items():
        bits = bits + F.when(failed, F.lit(1 << BITS[name])).otherwise(F.lit(0))
    return measured.withColumn("fail_bits", bits)


def rules() -> dict[str, Column]:
    """Name -> failure; the place in this dict is the bit."""
    c = F.col
    return {
        "too_few_words": c("n_words") < 50,
        "repeated_windows": 100 * c("n_repeat_words") > 50 * c("n_words"),
        "symbols_per_word": 5 * c("n_symbols") > c("n_words"),
        "duplicate_lines": (c("n_lines") >= 4) & (10 * c("n_dup_lines") > 6 * c("n_lines")),
        "short_words": c("word_chars") < 2 * c("n_words"),
        "long_words": c("word_chars") > 20 * c("n_words"),
        "upper_case": (c("n_letters") >= 20) & (10 * c("n_upper") > 7 * c("n_letters")),
        "shouting": 4 * c("n_shouts") > c("n_words"),
    }


BITS = {name: i for i, name in enumerate(("too_few_words", "repeated_windows", "symbols_per_word", "duplicate_lines", "short_words", "long_words", "upper_case", "shouting"))}
#: Versioned policies: the rules whose failure rejects a document.
POLICIES = {
    "base": ("too_few_words", "repeated_windows"),
    "v1": ("too_few_words", "repeated_windows", "symbols_per_word", "short_words", "long_words"),
    "v2": tuple(BITS),
}
CURRENT = "v2"


def mask(policy: str) -> int:
    return sum(1 << BITS[r] for r in POLICIES[policy])


def ledger(docs: DataFrame) -> DataFrame:
    """Measurements and ``fail_bits``, one row for each row of ``docs``."""
    return with_bits(measure(docs))


def apply_policy(book: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Adds ``base_failed`` and ``kept`` from the ledger's bits alone."""
    failed = lambda p: F.col("fail_bits").bitwiseAND(F.lit(mask(p))) != 0
    return book.withColumns({"base_failed": failed("base"), "kept": ~failed("base") & ~failed(policy), "policy": F.lit(policy)})


def ablation(book: DataFrame, policy: str = CURRENT) -> DataFrame:
    """For each rule of the policy: documents it fails, and those that only it rejects.

    The ledger is first reduced to its distinct bit patterns (at most 2**rules rows, with
    partial sums before the shuffle)."""
    m = mask(policy)
    seen = book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(m)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    per = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << BITS[r]).cast("long").alias("bit")) for r in POLICIES[policy]])
    return (
        seen.select("bits", "n", F.explode(per).alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(F.lit(0))).alias("failed"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(F.lit(0))).alias("rejected_by_it_alone"),
        )
    )
