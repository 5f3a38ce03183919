"""Repeated passages by prefix-free parsing.

*Pruning parse.*  The trigger of a 400-byte string is the least rolling hash among its first
``REACH`` grams (the leftmost if equal), so it depends on the string alone and equal strings
have equal triggers.  The starts of the strings that share one trigger form a run; the run's
bytes are a phrase of the dictionary and a document is the sequence of its phrases.  Phrases
are grouped by their *core*, the bytes from the trigger on that all strings of the run
contain.  A core that occurs once cannot be part of a repeat.  Where all occurrences of a
core are one phrase, every string of the run is repeated.  What is left are cores with
several different phrases; each distinct phrase goes on once.

*Corpus order.*  Those phrases are put into suffix order, many cores at a time, by a
prefix-free parse of their own (``suffix_order``): grams whose rolling hash is 0 modulo a
number cut them into short phrases that overlap by a gram; the suffix array of the
dictionary of distinct short phrases and the suffix array of the parse, both by prefix
doubling, combine into the order of all suffixes: first by the rank of the dictionary's
suffix, then by the rank of the parse's suffix behind it.  Strings that are equal are
neighbours in that order, and neighbours are compared byte by byte.

*Hot cores.*  A core of more than ``HOT_FORMS`` phrases is never gathered: its runs are cut
into short runs aligned to the trigger, those that differ into single strings, and hashes of
these are counted with partial sums.

Everything distributed is a count, an equi-join on hashes that Spark may split where a key
is hot, or an order of a bounded number of phrases.

Defined cases: a null or empty text, or one of fewer bytes than the string length, has
nothing removed unless it holds a whole string; matches never cross documents; overlapping
repeats inside one document count; a repeated row counts as another document; extra
columns are ignored.  Hashes of cores, phrases and (of hot cores) strings: two independent
64-bit families.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm import bytekit as bk
from parlance.llm.cluster import checkpointed, release

LENGTH, GRAM, REACH = 400, 24, 224
#: Long texts are parsed in pieces of so many starts; neighbours share LENGTH - 1 bytes.
PIECE = 1 << 20


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def runs(buf: np.ndarray, offs: np.ndarray, first: bk.Rolling, length: int = LENGTH, gram: int = GRAM, reach: int = REACH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First start, last start and trigger of every run of strings inside the documents of a group."""
    n, none = len(buf), np.zeros(0, np.int64)
    if n < length:
        return none, none, none
    grams = bk.mix((first.sums[gram:] - first.sums[:-gram]) * first.inverse[: n - gram + 1])
    order = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    trigger = (_least(order, reach) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # Starts of strings that end inside their document.
    size = np.diff(offs)
    inside = size >= length
    lo, hi = offs[:-1][inside], offs[1:][inside] - length
    if not len(lo):
        return none, none, none
    edge = np.zeros(n + 1, np.int8)
    edge[lo] += 1
    np.subtract.at(edge, hi + 1, 1)
    starts = np.flatnonzero(np.cumsum(edge[:-1], dtype=np.int8))
    t = trigger[starts]
    new = np.empty(len(starts), bool)
    new[0] = True
    new[1:] = (t[1:] != t[:-1]) | (starts[1:] != starts[:-1] + 1)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(starts)) - 1
    return starts[begin], starts[end], t[begin]


def pieces(buf: np.ndarray, offs: np.ndarray, length: int = LENGTH) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(document, offset in it, bytes, offsets): a group as it is, or the pieces of its one long document."""
    if len(offs) > 2 or len(buf) <= PIECE + length:
        yield 0, 0, buf, offs
        return
    for at in range(0, len(buf) - length + 1, PIECE):
        part = buf[at : at + PIECE + length - 1]
        yield 0, at, part, np.array([0, len(part)])


def phrases(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, reach: int = REACH) -> DataFrame:
    """The parse: doc_id, row_key, start and number of strings of each phrase, with the hashes of its core and of itself."""
    docs = bk.bounded_batches(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    core_bytes = length + 1 - reach

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offs in bk.groups(batch, "text"):
                for _, shift, some, at in pieces(buf, offs, length):
                    one, two = bk.Rolling(some), bk.Rolling(some, True)
                    lo, hi, trigger = runs(some, at, one, length, gram, reach)
                    doc = np.searchsorted(at, lo, "right") - 1
                    core = one.of(trigger, trigger + core_bytes)
                    phrase = bk.mix(two.of(lo, hi + length) ^ bk.mix((trigger - lo).astype(np.uint64)))
                    keys = pa.array(doc)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(keys), part.column(1).take(keys), pa.array((lo - at[doc] + shift).astype(np.int32)), pa.array((hi - lo + 1).astype(np.int32)), pa.array(bk.signed(core)), pa.array(bk.signed(phrase))],
                        ["doc_id", "row_key", "start", "n", "core", "phrase"],
                    )

    return bk.map_arrow(docs, run, f"doc_id {kind}, row_key long, start int, n int, core long, phrase long")


#: Cores of more distinct phrases are hot.  Strings in a short run of a hot core.
HOT_FORMS, SUB_RUN = 1000, 8
#: Bytes of phrases that are put into order at once, and rows whose remaining texts are held at once.
ORDER_BYTES, HELD_ROWS = 256 << 10, 128
#: Of the prefix-free parse that gives the suffix order: bytes of a trigger, modulus of its hash.
SHORT_GRAM, MODULUS = 12, 24


def _doubled(rank: np.ndarray, end: np.ndarray, step: int, reach: int) -> np.ndarray:
    """Ranks of the prefixes of ``reach`` items of the suffixes that end at ``end``, from ranks of their first ``step`` items."""
    at = np.arange(len(rank))
    while step < reach:
        after = np.where(at + step < end, rank[np.minimum(at + step, len(rank) - 1)] + 1, 0)
        rank = np.unique(rank * np.int64(len(rank) + 2) + after, return_inverse=True)[1]
        step *= 2
    return rank


def _dictionary_order(text: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The rank of every suffix of every phrase; ``text`` has the phrases end to end."""
    end = np.repeat(np.cumsum(size), size)
    left = np.minimum(end - np.arange(len(text)), 8)
    loads = np.ndarray(len(text), ">u8", np.concatenate([text, np.zeros(8, np.uint8)]), strides=(1,)).astype(np.uint64)
    loads &= ~((np.uint64(1) << (np.uint64(64) - left.astype(np.uint64) * np.uint64(8))) - np.uint64(1)) | np.uint64(0)
    order = np.lexsort((left, loads))
    new = np.ones(len(text), bool)
    new[1:] = (loads[order[1:]] != loads[order[:-1]]) | (left[order[1:]] != left[order[:-1]])
    rank = np.empty(len(text), np.int64)
    rank[order] = np.cumsum(new) - 1
    return _doubled(rank, end, 8, int(size.max(initial=1)))


def suffix_order(buf: np.ndarray, offs: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """``starts`` in the order of the suffixes that begin there and go to the end of their texts."""
    hashes = bk.Rolling(buf)
    if len(buf) >= SHORT_GRAM:
        grams = bk.mix((hashes.sums[SHORT_GRAM:] - hashes.sums[:-SHORT_GRAM]) * hashes.inverse[: len(buf) - SHORT_GRAM + 1])
        trigger = np.flatnonzero(grams % np.uint64(MODULUS) == 0)
        trigger = trigger[trigger + SHORT_GRAM <= offs[np.searchsorted(offs, trigger, "right")]]
    else:
        trigger = np.zeros(0, np.int64)
    cuts = np.union1d(offs[:-1], trigger)
    of = np.searchsorted(offs, cuts, "right")
    last = np.append(of[1:] != of[:-1], True)
    end = np.where(last, offs[of], np.append(cuts[1:], 0) + SHORT_GRAM)
    # The dictionary: distinct phrases in suffix order.
    _, where, phrase = np.unique(hashes.of(cuts, end), return_index=True, return_inverse=True)
    size = end[where] - cuts[where]
    first = np.cumsum(size) - size
    text = buf[np.repeat(cuts[where] - first, size) + np.arange(size.sum())]
    ranks = _dictionary_order(text, size)
    # The parse: each text a sequence of phrases, its suffixes in order.
    symbols = np.unique(ranks[first][phrase], return_inverse=True)[1]
    per_text = np.bincount(of - 1, minlength=len(offs) - 1)
    parse = _doubled(symbols, np.repeat(np.cumsum(per_text), per_text), 1, int(per_text.max(initial=1)))
    # Both combined.
    k = np.searchsorted(cuts, starts, "right") - 1
    behind = np.where(last[k], 0, parse[np.minimum(k + 1, len(parse) - 1)] + 1)
    return np.lexsort((behind, ranks[first[phrase[k]] + starts - cuts[k]]))


def repeated_strings(buf: np.ndarray, offs: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Starts of the strings of ``length`` bytes that start elsewhere as well, in texts laid end to end."""
    count = np.maximum(0, np.diff(offs) - length + 1)
    starts = np.repeat(offs[:-1] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    if len(starts) < 2:
        return starts[:0]
    order = starts[suffix_order(buf, offs, starts)]
    loads = np.ndarray(max(1, len(buf) - 7), "<u8", buf if len(buf) >= 8 else np.zeros(8, np.uint8), strides=(1,))
    same = np.arange(len(order) - 1)
    for at in [*range(0, length - 7, 8), *([length - 8] if length % 8 and length >= 8 else [])]:
        same = same[loads[order[same] + at] == loads[order[same + 1] + at]]
    return np.unique(np.concatenate([order[same], order[same + 1]]))


def classes(rows: DataFrame) -> DataFrame:
    """Cores that occur at least twice: ``core`` and whether all occurrences are one phrase."""
    found = rows.groupBy("core").agg(F.count(F.lit(1)).alias("times"), F.min("phrase").alias("low"), F.max("phrase").alias("high"))
    return found.where("times > 1").select("core", (F.col("low") == F.col("high")).alias("alike"))


def _of_docs(df: DataFrame) -> str:
    return df.schema["doc_id"].dataType.simpleString()


def _texts_with(docs: DataFrame, marks: DataFrame, how: str) -> DataFrame:
    """Texts beside what is known of them; texts travel compressed, and a column ``carried`` with them if there is one."""
    extra = [f"carried {docs.schema['carried'].dataType.simpleString()}"] if "carried" in docs.columns else []
    docs = docs.select("doc_id", "row_key", "text", *docs.columns[3:])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part, buf, offs in bk.groups(batch, "text"):
                raw = buf.tobytes()
                packed = [z.compress(raw[a:b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(packed, pa.binary()), *part.columns[3:]], ["doc_id", "row_key", "packed", *(["carried"] if extra else [])])

    packed = bk.map_arrow(docs, pack, ", ".join([f"doc_id {_of_docs(docs)}, row_key long, packed binary", *extra]))
    marks = marks.withColumnsRenamed({"doc_id": "m_id", "row_key": "m_key"})
    return packed.join(marks, packed["doc_id"].eqNullSafe(marks["m_id"]) & (packed["row_key"] == marks["m_key"]), how).drop("m_id", "m_key")


def _unpack(column: pa.Array) -> list[bytes]:
    import zstandard

    z = zstandard.ZstdDecompressor()
    return [z.decompress(x.as_py()) for x in column]


def _cut(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of the wanted phrases: doc_id, row_key, start, own, bytes, core."""
    lists = wanted.groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("start", "n", "own", "core")).alias("runs"))  # a document's own phrases
    kind = _of_docs(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, raw in enumerate(_unpack(batch.column(2))):
                found = batch.column(3)[i].as_py()
                some = [raw[r["start"] : r["start"] + r["n"] + length - 1] for r in found]
                at = pa.array([i] * len(found), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array([r["start"] for r in found], pa.int32()), pa.array([r["own"] for r in found], pa.bool_()), pa.array(some, pa.binary()), pa.array([r["core"] for r in found], pa.int64())],
                    ["doc_id", "row_key", "start", "own", "bytes", "core"],
                )

    return bk.map_arrow(_texts_with(docs, lists, "inner"), run, f"doc_id {kind}, row_key long, start int, own boolean, bytes binary, core long")


def _ordered(cut: DataFrame, length: int) -> DataFrame:
    """Runs of repeated strings of documents' own phrases, by suffix order of all phrases of each core: doc_id, row_key, start, n."""
    kind = _of_docs(cut)
    rows = cut.repartition("core").sortWithinPartitions("core")

    def found(part: pa.Table) -> pa.RecordBatch:
        part = part.combine_chunks()
        buf, offs = bk.text_buffers(part.column("bytes").combine_chunks())
        starts = repeated_strings(buf, offs, length)
        new = np.ones(len(starts), bool)
        of = np.searchsorted(offs, starts, "right") - 1
        new[1:] = (starts[1:] != starts[:-1] + 1) | (of[1:] != of[:-1])
        begin = np.flatnonzero(new)
        n = np.diff(np.append(begin, len(starts)))
        at = of[begin]
        own = part.column("own").to_numpy()[at]
        at, begin, n = at[own], begin[own], n[own]
        start = part.column("start").to_numpy()[at] + starts[begin] - offs[at]
        take = lambda c: part.column(c).combine_chunks().take(pa.array(at))
        return pa.RecordBatch.from_arrays([take("doc_id"), take("row_key"), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], ["doc_id", "row_key", "start", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            core = batch.column(5).to_numpy()
            while batch.num_rows:
                held_core = held[-1].column(5)[-1].as_py() if held else None
                if sum(b.nbytes for b in held) < ORDER_BYTES:
                    # Whole cores until the group is full, and the rest of the last one.
                    upto = int(np.searchsorted(np.cumsum(_sizes(batch)), ORDER_BYTES)) + 1
                    upto = int(np.searchsorted(core, core[min(upto, len(core)) - 1], "right"))
                else:
                    upto = int(np.searchsorted(core, held_core, "right"))
                    if not upto:
                        yield found(pa.Table.from_batches(held))
                        held = []
                        continue
                held.append(batch.slice(0, upto))
                batch, core = batch.slice(upto), core[upto:]
        if held:
            yield found(pa.Table.from_batches(held))

    return bk.map_arrow(bk.bounded_batches(rows), run, f"doc_id {kind}, row_key long, start int, n int")


def _sizes(batch: pa.RecordBatch) -> np.ndarray:
    return np.diff(bk.text_buffers(batch.column(4))[1])


def _sub_runs(cut: DataFrame, length: int, gram: int, reach: int) -> DataFrame:
    """Phrases of distinct content cut into runs of ``SUB_RUN`` strings, aligned to the trigger."""
    kind = _of_docs(cut)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offs in bk.groups(batch, "bytes"):
                one, two = bk.Rolling(buf), bk.Rolling(buf, True)
                lo, hi, trigger = runs(buf, offs, one, length, gram, reach)
                n = hi - lo + 1
                start = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                item = np.repeat(np.searchsorted(offs, lo, "right") - 1, n)
                trig = np.repeat(trigger, n)
                sub = (trig - start) // SUB_RUN
                new = np.ones(len(start), bool)
                new[1:] = (item[1:] != item[:-1]) | (sub[1:] != sub[:-1])
                a = np.flatnonzero(new)
                b = np.append(a[1:], len(start)) - 1
                first, last = start[a], start[b]
                # The bytes that all strings at these distances from the trigger contain, whether or not the run has them all.
                top = trig[a] - sub[a] * SUB_RUN
                core = bk.mix(one.of(top, top - (SUB_RUN - 1) + length) + sub[a].astype(np.uint64))
                phrase = bk.mix(two.of(first, last + length) ^ bk.mix((trig[a] - first).astype(np.uint64)))
                at = pa.array(item[a])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(at), part.column(1).take(at), part.column(2).take(at), part.column(3).take(at), pa.array((first - offs[item[a]]).astype(np.int32)), pa.array((last - first + 1).astype(np.int32)), pa.array(bk.signed(core)), pa.array(bk.signed(phrase))],
                    ["doc_id", "row_key", "start", "own", "at", "n", "core", "phrase"],
                )

    return bk.map_arrow(cut, run, f"doc_id {kind}, row_key long, start int, own boolean, at int, n int, core long, phrase long")


def _strings(cut: DataFrame, mixed: DataFrame, length: int) -> DataFrame:
    """The single strings of sub-runs that occur in several forms: doc_id, row_key, start (in the document), own and two hashes."""
    lists = mixed.groupBy("doc_id", "row_key", "start").agg(F.collect_list(F.struct("at", "n")).alias("subs"))  # of one phrase
    lists = lists.withColumnsRenamed({"doc_id": "m_id", "row_key": "m_key", "start": "m_start"})
    rows = cut.join(lists, cut["doc_id"].eqNullSafe(lists["m_id"]) & (cut["row_key"] == lists["m_key"]) & (cut["start"] == lists["m_start"])).drop("m_id", "m_key", "m_start")
    kind = _of_docs(cut)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offs in bk.groups(batch, "bytes"):
                one, two = bk.Rolling(buf), bk.Rolling(buf, True)
                lists = part.column(6)
                item = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                subs = lists.flatten()
                first, n = subs.field(0).to_numpy().astype(np.int64), subs.field(1).to_numpy().astype(np.int64)
                s = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                item = np.repeat(item, n)
                at = pa.array(item)
                begin = part.column(2).to_numpy()[item] + s
                s = s + offs[item]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(at), part.column(1).take(at), pa.array(begin.astype(np.int32)), part.column(3).take(at), pa.array(bk.signed(one.of(s, s + length))), pa.array(bk.signed(two.of(s, s + length)))],
                    ["doc_id", "row_key", "start", "own", "h1", "h2"],
                )

    return bk.map_arrow(rows, run, f"doc_id {kind}, row_key long, start int, own boolean, h1 long, h2 long")


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, reach: int = REACH, hot_forms: int = HOT_FORMS) -> DataFrame:
    """Runs of starts of repeated strings: doc_id, row_key, start, n.  ``docs`` has doc_id, row_key and text."""
    spark = docs.sparkSession
    keys = ["doc_id", "row_key", "start"]
    parse = phrases(docs, length, gram, reach)
    known = checkpointed(parse.join(classes(parse), "core"))
    release(spark)
    # One row for each phrase of a core with several forms; the least occurrence stands for all.
    forms = checkpointed(known.where("not alike").groupBy("core", "phrase").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct(*keys, "n")).alias("least")))
    whole = known.where("alike").select(*keys, "n").union(known.where("not alike").join(forms.where("times > 1").select("core", "phrase"), ["core", "phrase"]).select(*keys, "n"))
    whole = checkpointed(whole)
    del known
    release(spark)
    hot = forms.groupBy("core").agg((F.count(F.lit(1)) > hot_forms).alias("hot"))
    wanted = forms.join(hot, "core").select("least.*", (F.col("times") == 1).alias("own"), "core", "hot")
    out = whole.union(checkpointed(_ordered(_cut(docs, wanted.where("not hot"), length), length)))
    release(spark)
    hottest = checkpointed(wanted.where("hot"))
    if not hottest.isEmpty():
        out = out.union(_of_hot_cores(docs, hottest, length, gram, reach))
    return out


def _of_hot_cores(docs: DataFrame, wanted: DataFrame, length: int, gram: int, reach: int) -> DataFrame:
    """Runs of repeated strings of the phrases of hot cores, by counts of hashes: doc_id, row_key, start, n."""
    keys = ["doc_id", "row_key", "start"]
    cut = checkpointed(_cut(docs, wanted, length))
    release(docs.sparkSession)
    subs = _sub_runs(cut, length, gram, reach)
    judged = checkpointed(subs.join(classes(subs), "core").select(*keys, "own", "at", "n", "alike"))
    release(docs.sparkSession)
    part = judged.where("alike and own").select("doc_id", "row_key", (F.col("start") + F.col("at")).alias("start"), "n")
    strings = _strings(cut, judged.where("not alike").select(*keys, "at", "n"), length)
    twice = strings.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("times")).where("times > 1").drop("times")
    single = strings.where("own").join(twice, ["h1", "h2"]).select(*keys, F.lit(1).alias("n"))
    out = checkpointed(part.union(single))
    release(docs.sparkSession)
    return out


def _kept(raw: bytes, starts: list[tuple[int, int]], length: int) -> tuple[bytes, int]:
    """What is left of ``raw``, and how many maximal runs were removed."""
    spans: list[list[int]] = []
    for s, n in sorted(starts):
        if spans and s <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], s + n - 1 + length)
        else:
            spans.append([s, s + n - 1 + length])
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at:a])
        at = b
    out.append(raw[at:])
    return b"".join(out), len(spans)


def remove(docs: DataFrame, length: int = LENGTH, carry: bool = False, hot_forms: int = HOT_FORMS) -> DataFrame:
    """doc_id, row_key, n_bytes, n_removed, n_spans, kept_sha256 (of the remaining bytes) and ``text`` of every document.

    ``text`` is what remains, without the bytes of characters that were cut.  With ``carry``, the
    other columns of ``docs`` come along as the struct ``carried``."""
    others = [F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("carried")] if carry else []
    whole = docs.select("doc_id", bk.row_key(), F.col("text").cast("string").alias("text"), *others)
    docs = whole.select("doc_id", "row_key", "text")
    found = repeats(docs, length, hot_forms=hot_forms).groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("start", "n")).alias("runs"))  # a document's own runs
    kind = _of_docs(docs)
    names = ["doc_id", "row_key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text", *(["carried"] if carry else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, HELD_ROWS) for b in batches for at in range(0, b.num_rows, HELD_ROWS)):
            rows = []
            for raw, runs_ in zip(_unpack(batch.column(2)), batch.column(3 + carry), strict=True):
                kept, spans = _kept(raw, [(r["start"], r["n"]) for r in runs_.as_py() or ()], length)
                rows.append((len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
            size, removed, spans, sha, text = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in (size, removed, spans)), pa.array(sha, pa.string()), pa.array(text, pa.string()), *([batch.column(3)] if carry else [])], names)

    more = f", carried {whole.schema['carried'].dataType.simpleString()}" if carry else ""
    return bk.map_arrow(_texts_with(whole, found, "left"), run, f"doc_id {kind}, row_key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string{more}")


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The rows of ``docs`` with the repeated bytes taken out of their texts and ``n_chars`` counted anew.

    Bytes of a character that was cut go with it; a null text becomes empty."""
    rows = remove(docs, length, carry=True)
    columns = [F.col("text") if c == "text" else F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("carried").getField(c).alias(c) for c in docs.columns]
    return rows.select(*columns)


def digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``remove`` by document, with the code points that remain as ``n_chars``."""
    return remove(docs, length).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text", F.length("text").cast("long").alias("n_chars"))


def brute_force(texts: list[bytes], length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """The same by comparing every string, for tests."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        starts = [(i, 1) for i in range(len(t) - length + 1) if seen[t[i : i + length]] > 1]
        kept, spans = _kept(t, starts, length)
        out.append((len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out
