"""Vectorised byte kernels shared by the text operators.

Every kernel works on the UTF-8 bytes of a group of documents laid end to end
(``buf``) with document offsets (``offs``).  Words are maximal runs of bytes other
than 0x20 and 0x09-0x0D; those bytes never occur inside a multi-byte character, so
byte runs equal code point runs.  Groups are cut to about ``GROUP_BYTES`` so that
working memory does not depend on the size of an Arrow batch.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP_BYTES = 1 << 20

_RNG = np.random.default_rng(20240229)
#: A random 64-bit value for each byte, and an odd base with its inverse modulo 2**64.
_TABLE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TABLE_2 = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E6C63D0876A9A4F | 1
_INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; grown by doubling and kept."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.full(size, base & ((1 << 64) - 1), np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 1 << 22:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every bit over the whole word."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Rolling:
    """Hash of any byte range of ``buf`` in constant time, from a prefix sum."""

    def __init__(self, buf: np.ndarray, second: bool = False):
        n = len(buf)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((_TABLE_2 if second else _TABLE)[buf] * powers(BASE, n), out=self.sums[1:])
        self.inverse = powers(_INVERSE, n + 1)

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self.raw(start, end) + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def range_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of disjoint ascending ranges, in blocks of bounded working memory."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + GROUP_BYTES, "right")))
        lo, hi = int(start[i]), int(end[j - 1])
        out[i:j] = Rolling(buf[lo:hi]).of(start[i:j] - lo, end[i:j] - lo)
        i = j
    return out


#: Words of more bytes are hashed as ranges; the masks keep the first bytes of a little-endian load.
SHORT_WORD = 64
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of words (disjoint ascending ranges) by loads of eight bytes, exact for words of up to eight."""
    n = end - start
    loads = np.ndarray(len(buf) + 1, "<u8", np.concatenate([buf, np.zeros(8, np.uint8)]), strides=(1,))
    out = mix((loads[start] & _FIRST[np.minimum(n, 8)]) + n.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    open_ = np.flatnonzero((n > 8) & (n <= SHORT_WORD))
    for at in range(8, SHORT_WORD, 8):
        if not len(open_):
            break
        more = loads[start[open_] + at] & _FIRST[np.minimum(n[open_] - at, 8)]
        out[open_] = mix(out[open_] * np.uint64(0x9E3779B97F4A7C15) ^ more)
        open_ = open_[n[open_] > at + 8]
    long = np.flatnonzero(n > SHORT_WORD)
    if len(long):
        out[long] = range_hashes(buf, start[long], end[long])
    return out


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string column without copying; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offs = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def groups(batch: pa.RecordBatch, column: str, limit: int = GROUP_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``limit`` bytes of text (one row at least), with their buffers."""
    if not batch.num_rows:
        return
    buf, offs = text_buffers(batch.column(batch.schema.get_field_index(column)))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield batch.slice(i, j - i), buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each document its first word's index (one more at the end)."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    space = SPACE[buf]
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = space[:-1]
    inner = offs[(offs > 0) & (offs < n)]
    before[inner] = True
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = space[1:]
    after[inner - 1] = True
    start = np.flatnonzero(~space & before)
    end = np.flatnonzero(~space & after) + 1
    return start, end, np.searchsorted(start, offs, "left")


def sums_by_document(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """How many flags are set in each document."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


#: Arrow batches of text: rows and bytes at most.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """The frame, with Arrow batches limited by bytes as well as rows (long texts).

    Spark has these limits by session only, so a session with higher ones is lowered to ours; lower
    ones of the user's stay."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        have = conf.get(key, None)
        if have is None or not have.isdigit() or not 0 < int(have) <= most:
            conf.set(key, str(most))
    return df


#: What a worker remembers between batches; emptied at the end of every task.
_memories: list[Callable[[], None]] = [_powers.clear]


def at_task_end(forget: Callable[[], None]) -> None:
    if forget not in _memories:
        _memories.append(forget)


@functools.cache
def _libc():
    try:
        libc = ctypes.CDLL("libc.so.6")
        return libc if hasattr(libc, "malloc_trim") else None
    except OSError:  # another C library
        return None


def sweep() -> None:
    """Gives a Python worker's memory back: Spark keeps idle workers beside the next task's."""
    for forget in _memories:
        forget()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if (libc := _libc()) is not None:
        libc.malloc_trim(0)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` whose workers hold no more between tasks than they need to start the next."""

    def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            sweep()

    return df.mapInArrow(swept, schema)


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(text: str = "text"):
    """With the document's id this tells rows apart; equal rows share it and get equal results."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("row_key")
