"""Exact Jaccard join over word n-grams, with components, by set-relation skipping.

A document's set is its distinct five-word shingles as 64-bit hashes.  All elements have
one global order: shingles known to be frequent last, hashes otherwise.  Two sets of
similarity 0.75 share an element among the first ``n - ceil(0.75 n) + 1`` of each, so only
those go to inverted lists.  Any set of frequent shingles gives right results; it is
gathered from shingles that recur inside one batch of documents and is bounded.

Index-level skipping: lists hold each element's position, and a long list is cut into
blocks by size of the set and position.  An entry names the blocks that may hold a partner
(sizes near enough, few enough elements before the common one) and meets those alone, so
blocks out of reach are never read.  Equal sets are one entry (*class*) of the join.

Answer-level skipping: a list's members are first compared with leaders only.  The first
leader is the member that holds the list's element foremost: it has the fewest elements of
its own and so is nearest to most others.  A member's answer follows from its leader's where
that suffices: linked members are in one component and need no pair of their own, and a
pair is skipped when the exact distances to a common leader prove it too far (Jaccard
distance is a metric).  Lists that still hold several components are compared with leaders
of two of those; only pairs across components that are then left are compared themselves.
Every such pair passes an exact bitmap bound on the symmetric difference and then an exact
comparison of the two whole sets.

The driver sees counts and the bounded list of frequent shingles, never links or
components, which are found by label propagation on checkpointed tables.

Defined cases: null or empty text: no shingles, linked with nothing; fewer than five words:
the whole sequence is one shingle; equal sets link; a repeated row is another document of
the same id; extra columns are ignored.  Exactness is up to 64-bit hashes of shingles and
of sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm import bytekit as bk
from parlance.llm.cluster import checkpointed, release

WORDS, PERCENT = 5, 75
#: Frequent shingles that are put last: at most so many, each seen so often in repeats inside batches.
FREQUENT_MOST, FREQUENT_TIMES = 200_000, 4
#: Bytes of text among which recurring shingles are looked for.
RECUR_BYTES = 4 << 20
BITMAP_BYTES = 128
#: Rounds of leaders.  Lists of more entries than a block are cut by size (steps of a factor) and position (parts of a set).
LEADER_ROUNDS, BLOCK, SIZE_STEP, PARTS = 2, 32, 1.2, 16


def sets(buf: np.ndarray, offs: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct shingle hashes, ascending, end to end, and where each document begins."""
    buf = bk.LOWER[buf]
    start, end, first = bk.words(buf, offs)
    h = bk.word_hashes(buf, start, end)
    count = np.diff(first)
    doc = np.repeat(np.arange(len(count)), count)
    n = len(h)
    out, where = [], []
    if n >= words:
        at = np.flatnonzero(doc[words - 1 :] == doc[: n - words + 1])
        s = np.full(len(at), words, np.uint64)
        for k in range(words):
            s = bk.mix(s * np.uint64(0x9E3779B97F4A7C15) ^ h[at + k])
        out.append(s)
        where.append(doc[at])
    short = np.flatnonzero((count > 0) & (count < words))
    if len(short):
        s = count[short].astype(np.uint64)
        for k in range(words - 1):
            more = k < count[short]
            at = np.minimum(first[short] + k, n - 1)
            s = np.where(more, bk.mix(s * np.uint64(0x9E3779B97F4A7C15) ^ h[at]), s)
        out.append(s)
        where.append(short)
    if not out:
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    if len(short):
        s, where = np.concatenate(out), np.concatenate(where)
        order = np.argsort(where, kind="stable")
        s, where = s[order], where[order]
    else:
        s, where = out[0], where[0]
    edge = np.searchsorted(where, np.arange(len(offs)))
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        s[a:b].sort()
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != s[:-1]) | (where[1:] != where[:-1])
    s, where = s[keep], where[keep]
    return s, np.searchsorted(where, np.arange(len(offs)))


def class_keys(s: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each whole set."""
    total = np.zeros(len(s) + 1, np.uint64)
    np.cumsum(bk.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)), out=total[1:])
    return bk.mix((total[first[1:]] - total[first[:-1]]) ^ np.diff(first).astype(np.uint64))


def prefix_lengths(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    return np.where(n > 0, n - -(-percent * n // 100) + 1, 0)


def bitmaps(s: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row of ``BITMAP_BYTES`` for each set; a bit that differs needs an element that differs."""
    bits = np.zeros((len(first) - 1, BITMAP_BYTES * 8), np.uint8)
    bits[np.repeat(np.arange(len(first) - 1), np.diff(first)), (s % np.uint64(BITMAP_BYTES * 8)).astype(np.int64)] = 1
    return np.packbits(bits, axis=1)


def _groups(docs: DataFrame, fields: list[tuple[str, str]], work, limit: int = bk.GROUP_BYTES) -> DataFrame:
    """Runs ``work(part, sets, first)`` over groups of documents."""
    docs = bk.bounded_batches(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offs in bk.groups(batch, "text", limit):
                yield pa.RecordBatch.from_arrays(work(part, *sets(buf, offs)), [name for name, _ in fields])

    return bk.map_arrow(docs, run, ", ".join(f"{a} {b}" for a, b in fields))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, n (set size), class and bitmap of every document.

    The first row of each group also has ``again``: the shingles of several sets of the group
    and in how many (equal sets count once)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(part, s, first):
        keys = class_keys(s, first)
        size = np.diff(first)
        some = np.zeros(len(size), bool)
        some[np.unique(keys, return_index=True)[1]] = True
        found, times = np.unique(s[np.repeat(some, size)], return_counts=True)
        found, times = found[times > 1], times[times > 1]
        edge = np.full(len(size) + 1, len(found), np.int32)
        edge[0] = 0
        again = pa.ListArray.from_arrays(pa.array(edge), pa.StructArray.from_arrays([pa.array(bk.signed(found)), pa.array(times)], ["h", "times"]))
        return [part.column(0), part.column(1), pa.array(size), pa.array(bk.signed(keys)), pa.array([x.tobytes() for x in bitmaps(s, first)], pa.binary()), again]

    return _groups(docs, [("doc_id", kind), ("row_key", "long"), ("n", "long"), ("class", "long"), ("bitmap", "binary"), ("again", "array<struct<h:long,times:long>>")], work, RECUR_BYTES)


def frequent(signed: DataFrame) -> np.ndarray:
    """The most frequent of the shingles that recur inside groups, FREQUENT_MOST at most; sorted."""
    rows = signed.select(F.explode("again").alias("a")).groupBy("a.h").agg(F.sum("a.times").alias("times"))
    top = rows.where(F.col("times") >= FREQUENT_TIMES).orderBy(F.desc("times"), "h").limit(FREQUENT_MOST).select("h").toArrow()
    return np.sort(top.column(0).to_numpy().astype(np.int64).view(np.uint64))


def inverted(docs: DataFrame, last: np.ndarray, percent: int = PERCENT, bare: bool = False) -> DataFrame:
    """The lists: element h, class, size n and position of the element in the set's order; if ``bare``, the elements alone."""
    shared = docs.sparkSession.sparkContext.broadcast(last)  # FREQUENT_MOST hashes at most

    def work(part, s, first):
        n = np.diff(first)
        doc = np.repeat(np.arange(len(n)), n)
        late = np.zeros(len(s), bool)
        if len(shared.value) and len(s):
            at = np.minimum(np.searchsorted(shared.value, s), len(shared.value) - 1)
            late = shared.value[at] == s
        order = np.lexsort((late, doc))  # stable: hashes stay ascending
        pos = np.arange(len(s)) - np.repeat(first[:-1], n)
        keep = pos < np.repeat(prefix_lengths(n, percent), n)
        if bare:
            return [pa.array(bk.signed(s[order][keep]))]
        key = class_keys(s, first)
        return [pa.array(bk.signed(s[order][keep])), pa.array(bk.signed(key[doc[keep]])), pa.array(n[doc[keep]].astype(np.int32)), pa.array(pos[keep].astype(np.int32))]

    return _groups(docs, [("h", "long"), ("class", "long"), ("n", "int"), ("pos", "int")][: 1 if bare else 4], work)


def _possible(a: str, b: str, percent: int) -> Column:
    """Sizes near enough, and few enough elements before the common one."""
    n, m, i, j = (F.col(f"{x}.{y}").cast("long") for y in ("n", "pos") for x in (a, b))
    least = F.ceil(F.lit(percent) * (n + m) / F.lit(100 + percent))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (F.least(n - i, m - j) >= least) & (i + j <= n + m - 2 * least)


def _size_block(n: Column) -> Column:
    return F.floor(F.ln(n) / F.lit(math.log(SIZE_STEP))).cast("int")


def _own_block(m: str) -> list[Column]:
    """Where a list's entry stands: block of its size, block of its position."""
    n = F.col(f"{m}.n")
    return [_size_block(n).alias("size_block"), F.floor(PARTS * F.col(f"{m}.pos") / n).cast("int").alias("place_block")]


def _reach(m: str, percent: int) -> Column:
    """The blocks that may hold a partner of an entry, as (size_block, place_block).

    A partner of size s and position at least b s / PARTS shares ``least = r (n + s)`` elements, of which
    none stands before either position; that bounds s from both sides for every b."""
    r = percent / (100 + percent)
    n, i = F.col(f"{m}.n").cast("double"), F.col(f"{m}.pos").cast("double")
    near = 1e-6

    def sizes(b: Column) -> Column:
        part = b / F.lit(float(PARTS))
        low, high = F.greatest(n * percent / 100, r * n / F.greatest(F.lit(1e-9), 1 - r - part)), F.least(n * 100 / percent, (n - i) / r - n)
        slack, room = part - (1 - 2 * r), n * (1 - 2 * r) - i
        high = F.when(slack > 1e-9, F.least(high, room / slack)).otherwise(high)
        low = F.when(slack < -1e-9, F.greatest(low, room / slack)).otherwise(low)
        return F.struct(_size_block(F.greatest(F.lit(1.0), low * (1 - near) - near)).alias("low"), F.when(high >= low * (1 - near) - near, _size_block(F.greatest(F.lit(1.0), high * (1 + near) + near))).alias("high"), b.alias("b"))

    most = math.floor(PARTS * (100 - percent) / 100) + 1
    ranges = F.filter(F.transform(F.sequence(F.lit(0), F.lit(most)), sizes), lambda x: x["high"].isNotNull() & (x["high"] >= x["low"]))
    return F.flatten(F.transform(ranges, lambda x: F.transform(F.sequence(x["low"], x["high"]), lambda k: F.struct(k.alias("size_block"), x["b"].alias("place_block")))))


def _across(rest: DataFrame, percent: int) -> DataFrame:
    """Pairs a, b across components: ``rest`` has h, size (of the list), label and m (class, n, pos)."""
    as_two = lambda x: x.select(F.col("x.class").alias("a"), F.col("y.class").alias("b"))
    apart = (F.col("x.class") < F.col("y.class")) & (F.col("lx") != F.col("ly"))
    first, second = [F.col("label").alias("lx"), F.col("m").alias("x")], [F.col("label").alias("ly"), F.col("m").alias("y")]
    short, long = rest.where(F.col("size") <= BLOCK), rest.where(F.col("size") > BLOCK)
    whole = short.select("h", *first).join(short.select("h", *second), "h").where(apart).where(_possible("x", "y", percent))
    probes = long.select("h", *first, F.explode(_reach("m", percent)).alias("k")).select("h", "lx", "x", "k.*")
    blocks = long.select("h", *second, *_own_block("m"))
    met = probes.join(blocks, ["h", "size_block", "place_block"]).where(apart).where(_possible("x", "y", percent))
    return as_two(whole).union(as_two(met))


def _near_bitmaps(pairs: DataFrame, percent: int) -> DataFrame:
    """Drops pairs whose bitmaps differ in more bits than sets of that similarity may differ in elements."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bits = [np.frombuffer(b"".join(x.as_py() for x in batch.column(k)), np.uint8).reshape(-1, BITMAP_BYTES) for k in (4, 5)]
            differ = np.bitwise_count(bits[0] ^ bits[1]).sum(axis=1, dtype=np.int64)
            total = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            least = -(-percent * total // (100 + percent))
            kept = batch.filter(pa.array(differ <= total - 2 * least))
            yield kept.select([0, 1])

    return bk.map_arrow(pairs, run, "a long, b long")


def _compared(pairs: DataFrame, classes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Exact answers: a, b, common, total (sizes of intersection and union)."""
    involved = pairs.select("a").union(pairs.select("b")).distinct()
    known = classes.join(involved, classes["class"] == involved["a"], "left_semi").select("class", "least.*").withColumnsRenamed({"doc_id": "c_id", "row_key": "c_key"})
    bodies = checkpointed(texts.join(known, texts["doc_id"].eqNullSafe(known["c_id"]) & (texts["row_key"] == known["c_key"])).select("class", "packed").dropDuplicates(["class"]))
    release(pairs.sparkSession)
    rows = pairs.join(bodies.withColumnsRenamed({"class": "a", "packed": "x"}), "a").join(bodies.withColumnsRenamed({"class": "b", "packed": "y"}), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdDecompressor()
        for batch in batches:
            common, total = [], []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                one, two = z.decompress(x.as_py()), z.decompress(y.as_py())
                s, first = sets(np.frombuffer(one + two, np.uint8), np.array([0, len(one), len(one) + len(two)]))
                both = len(s) - len(np.unique(s))
                common.append(both)
                total.append(len(s) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(common, pa.int64()), pa.array(total, pa.int64())], ["a", "b", "common", "total"])

    return bk.map_arrow(rows, run, "a long, b long, common long, total long")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node, label of every node: equal labels for linked nodes; ``links`` has a, b.

    By contraction: every node goes to the least of itself and its neighbours, links between
    what they went to are made distinct, and so on until none is left.  A star is gone after
    a step or two; nodes are hashes, so a chain loses a good part of its links in each step
    and the joins of all steps together are little more than the links."""
    left = checkpointed(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    place = nodes.select("node", F.col("node").alias("label"))
    while not left.isEmpty():
        ends = left.select(F.col("a").alias("from"), F.col("a").alias("to")).union(left.select(F.col("b").alias("from"), F.col("a").alias("to")))
        step = checkpointed(ends.groupBy("from").agg(F.min("to").alias("to")))
        moved = left.join(step.withColumnsRenamed({"from": "a", "to": "x"}), "a").join(step.withColumnsRenamed({"from": "b", "to": "y"}), "b")
        left = checkpointed(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        place = checkpointed(place.join(step, place["label"] == step["from"], "left").select("node", F.coalesce("to", "label").alias("label")))
    release(nodes.sparkSession)
    return place


def _packed(docs: DataFrame) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part, buf, offs in bk.groups(batch, "text"):
                raw = buf.tobytes()
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([z.compress(raw[a:b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)], pa.binary())], ["doc_id", "row_key", "packed"])

    return bk.map_arrow(docs, pack, f"doc_id {kind}, row_key long, packed binary")


def links(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signatures of all documents; links between classes, enough to connect every component; node and label of every class).

    ``docs`` has doc_id, row_key and text."""
    spark = docs.sparkSession
    signed = checkpointed(signatures(docs))
    classes = signed.where("n > 0").groupBy("class").agg(F.min(F.struct("doc_id", "row_key")).alias("least"), F.first("n").alias("n"), F.first("bitmap").alias("bitmap"))
    classes = checkpointed(classes)
    last = frequent(signed)
    shared = inverted(docs, last, percent, bare=True).groupBy("h").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("h")
    shared = checkpointed(shared)
    release(spark)
    hits = checkpointed(inverted(docs, last, percent).join(shared, "h").groupBy("h", "class").agg(F.first("n").alias("n"), F.first("pos").alias("pos")))
    release(spark)
    texts = _packed(docs)
    answers = spark.range(0).select(*[F.col("id").alias(c) for c in ("a", "b", "common", "total")])
    near = (100 * F.col("common") >= percent * F.col("total"))
    nodes = classes.select(F.col("class").alias("node"))
    labels = nodes.withColumn("label", F.col("node"))

    def fresh(candidates: DataFrame) -> DataFrame:
        """Each candidate pair once, not yet answered, near in size and bitmap."""
        pairs = candidates.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(answers, ["a", "b"], "left_anti")
        own = classes.select("class", F.col("n"), "bitmap")
        rows = pairs.join(own.withColumnsRenamed({"class": "a", "n": "na", "bitmap": "ba"}), "a").join(own.withColumnsRenamed({"class": "b", "n": "nb", "bitmap": "bb"}), "b")
        return checkpointed(_near_bitmaps(rows.select("a", "b", "na", "nb", "ba", "bb"), percent))

    def learn(pairs: DataFrame) -> None:
        nonlocal answers, labels
        if pairs.isEmpty():
            return
        answers = checkpointed(answers.union(_compared(pairs, classes, texts, percent)))
        labels = checkpointed(components(nodes, answers.where(near)))
        release(spark)

    def several(lists: DataFrame) -> DataFrame:
        """Entries of lists that hold several components, as h, size, label and m."""
        known = lists.join(labels, lists["class"] == labels["node"]).drop("node")
        undone = known.groupBy("h").agg(F.min("label").alias("one"), F.max("label").alias("two"), F.count(F.lit(1)).alias("size")).where("one <> two and size > 3")
        return checkpointed(known.join(undone, "h").select("h", "size", "label", F.struct("class", "n", "pos").alias("m"), F.col("label").isin(F.col("one"), F.col("two")).alias("outer")))

    member = hits.select("h", F.struct("class", "n", "pos").alias("m"))
    foremost = F.struct("m.pos", "m.class")
    leaders = member.groupBy("h").agg(F.min_by("m", foremost).alias("p"), F.max_by("m", foremost).alias("q")).where("p.class <> q.class").select("h", F.explode(F.array("p", "q")).alias("leader"))
    rest = None
    for turn in range(LEADER_ROUNDS):
        if turn:
            leaders = member.where("outer").groupBy("h", "label").agg(F.min_by("m", foremost).alias("leader"))
        stars = leaders.select("h", "leader").join(member.select("h", F.col("m").alias("member")), "h").where(F.col("leader.class") != F.col("member.class")).where(_possible("leader", "member", percent))
        learn(fresh(stars.select(F.col("leader.class").alias("a"), F.col("member.class").alias("b"))))
        # Pairs across components that the leaders' answers leave open.
        member = rest = several((rest.select("h", "m.*") if turn else hits))
        if rest.isEmpty():
            return signed, answers.where(near), labels
    learn(_not_far(fresh(_across(rest, percent)), answers, percent))
    return signed, answers.where(near), labels


def _not_far(pairs: DataFrame, answers: DataFrame, percent: int) -> DataFrame:
    """Drops pairs that known exact distances prove too far: d(x, y) >= d(l, y) - d(l, x) for the set l that is nearest to x.

    Each class has one nearest set among its answers, so every join here is by a key that is
    unique on one side."""
    d = 1 - F.col("common") / F.col("total")
    both = checkpointed(answers.select("a", "b", d.alias("d")).union(answers.select(F.col("b").alias("a"), F.col("a").alias("b"), d.alias("d"))))
    nearest = checkpointed(both.groupBy("a").agg(F.min_by(F.struct("b", "d"), F.struct("d", "b")).alias("l")).select("a", F.col("l.b").alias("l"), F.col("l.d").alias("dl")))
    known = both.select(F.col("a").alias("l"), F.col("b").alias("far_end"), F.col("d").alias("dy"))
    for x, y in (("a", "b"), ("b", "a")):
        near = nearest.select(F.col("a").alias(x), "l", "dl")
        tried = pairs.join(near, x, "left").withColumn("far_end", F.col(y)).join(known, ["l", "far_end"], "left")
        pairs = tried.where(F.coalesce(F.col("dy") - F.col("dl"), F.lit(0.0)) <= 1 - percent / 100 + 1e-9).select("a", "b")
    return checkpointed(pairs)


def join(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, row_key, n_shingles, component_id and component (null: linked with nothing) of every document."""
    docs = docs.select("doc_id", bk.row_key(), F.col("text").cast("string").alias("text"))
    signed, _, labels = links(docs, percent)
    placed = signed.select("doc_id", "row_key", "n", "class").join(labels, (F.col("class") == F.col("node")) & (F.col("n") > 0), "left")
    least = placed.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return placed.join(least, "label", "left").select("doc_id", "row_key", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.col("label").alias("component"))


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` with one document of each component: the one of the smallest id (null last).

    Documents without words are linked with nothing and stay; of repeated rows (same id and
    text) one stays."""
    placed = join(docs, percent)
    chosen = placed.where("n_shingles > 0").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")).alias("least")).select("least.doc_id", "least.row_key")
    keys = checkpointed(chosen.union(placed.where("n_shingles = 0").select("doc_id", "row_key")).distinct()).withColumnsRenamed({"doc_id": "k_id", "row_key": "k_key"})
    release(docs.sparkSession)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("doc_id").alias("r_id"), bk.row_key().alias("r_key"))
    kept = rows.join(keys, rows["r_id"].eqNullSafe(keys["k_id"]) & (rows["r_key"] == keys["k_key"]), "left_semi").dropDuplicates(["r_id", "r_key"])
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
