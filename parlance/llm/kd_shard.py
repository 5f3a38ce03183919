"""K-d tree partitioning by distributed weighted medians.

Documents are points of a few integer metadata dimensions with their bytes as weight.
Every node is split along the dimension in which its points are widest (relative to the
whole corpus) at the weighted median, until the leaves reach the target bytes.  All nodes
of a level are split at once.  A median is found by narrowing: a histogram of ``BINS``
bins of each node's interval is summed on the executors, the bin that holds the median
becomes the next interval, and where one value holds too much weight, points of that
value are divided by a hash of the row.  The driver sees a few bounded histograms per
level and never a row; no group of points, however large, is gathered in a task.

Law: ``bytes`` - the shards' sizes are near equal.  Equal texts of one document id share
their fate; other equal texts are divided where a large group would unbalance a shard.

Defined cases: a null text has no bytes (size 1); null metadata is its own value; an empty
table gives no rows; repeated rows each get a slot of their own; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from parlance.llm.cluster import checkpointed

BINS = 1024
#: Intervals stay below 2**52, so that bins are exact in 64-bit arithmetic.
SPAN = 1 << 52
TIE = "tie"
#: A median is near enough when the interval that is left holds this share of a leaf.
TOLERANCE = 1e-4
SLOT_ROWS = 2000


@dataclass
class Node:
    """An inner node with a cut, or a leaf (``shard``)."""

    leaves: int
    weight: int
    shard: int = -1
    dim: str = ""
    value: int = 0
    tie: int = 0
    left: Node | None = None
    right: Node | None = None

    def inside(self) -> Column:
        """Whether a row goes left."""
        return (F.col(self.dim) < self.value) | ((F.col(self.dim) == self.value) & (F.col(TIE) < self.tie))


def _open(node: Node) -> list[Node]:
    if node.left is None:
        return [] if node.leaves == 1 else [node]
    return _open(node.left) + _open(node.right)


def _leaf_number(node: Node, numbers: dict[int, int]) -> Column:
    """An expression of nested cuts: the number of the leaf or open node that a row reaches."""
    if node.left is None:
        return F.lit(numbers.get(id(node), node.shard))
    return F.when(node.inside(), _leaf_number(node.left, numbers)).otherwise(_leaf_number(node.right, numbers))


def _widest(points: DataFrame, root: Node, nodes: list[Node], dims: list[str], spans: dict[str, float]) -> None:
    numbers = {id(n): i for i, n in enumerate(nodes)}
    found = points.groupBy(_leaf_number(root, numbers).alias("node")).agg(*[f(d).alias(f"{name}_{d}") for d in dims for name, f in (("lo", F.min), ("hi", F.max))]).where(F.col("node") >= 0)
    for r in found.collect():  # one row for each open node
        n = nodes[r["node"]]
        n.dim = max(dims, key=lambda d: ((r[f"hi_{d}"] - r[f"lo_{d}"]) / spans[d], -dims.index(d)))
        n.low, n.high = r[f"lo_{n.dim}"], r[f"hi_{n.dim}"]


def _medians(spark, points: DataFrame, root: Node, nodes: list[Node], leaf_weight: float) -> None:
    """Sets each node's cut so that its left part holds its share of the leaves."""
    for n in nodes:
        n.below, n.goal, n.by_tie, n.fixed = 0, n.weight * (n.leaves // 2) / n.leaves, False, False
    while todo := [n for n in nodes if not n.fixed]:
        numbers = {id(n): i for i, n in enumerate(todo)}
        number = _leaf_number(root, numbers)
        lit = lambda f: F.element_at(F.array(*[F.lit(int(f(n))) for n in todo]), F.col("node") + 1)  # noqa: B023, E731
        value = F.element_at(F.array(*[F.col(TIE) if n.by_tie else F.col(n.dim) for n in todo]), F.col("node") + 1)
        on = F.element_at(F.array(*[F.col(n.dim) == n.value if n.by_tie else F.lit(True) for n in todo]), F.col("node") + 1)
        rows = points.withColumn("node", number).where(F.col("node") >= 0).where(on).withColumn("v", value).where((F.col("v") >= lit(lambda n: n.low)) & (F.col("v") <= lit(lambda n: n.high)))
        width = lit(lambda n: -(-(n.high - n.low + 1) // BINS))
        histogram = rows.groupBy("node", F.floor((F.col("v") - lit(lambda n: n.low)) / width).cast("int").alias("bin")).agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n"))
        bins: dict[int, list] = {}
        for r in histogram.collect():  # at most BINS rows for each node
            bins.setdefault(r["node"], []).append((r["bin"], r["weight"], r["n"]))
        for i, n in enumerate(todo):
            step = -(-(n.high - n.low + 1) // BINS)
            below = n.below
            for b, weight, count in sorted(bins.get(i, [])):
                if below + weight >= n.goal:
                    break
                below += weight
            else:
                b, weight, count = BINS, 0, 0
            low = n.low + b * step
            near = count <= 1 or weight <= TOLERANCE * leaf_weight
            if near or (step == 1 and n.by_tie):
                # The whole bin goes to the nearer side.
                cut = low + step if below + weight - n.goal <= n.goal - below else low
                n.value, n.tie = (n.value, cut) if n.by_tie else (cut, 0)
                n.fixed = True
            elif step == 1:
                n.value, n.below, n.by_tie, n.low, n.high = low, below, True, 0, SPAN - 1
            else:
                n.below, n.low, n.high = below, low, min(n.high, low + step - 1)


def grow(points: DataFrame, dims: list[str], target_bytes: float | None = None, leaves: int | None = None) -> Node:
    """The tree over ``points`` (columns of ``dims``, ``tie`` and ``weight``, all long, 0 to 2**52)."""
    total = points.agg(F.sum("weight").alias("w"), *[f(d).alias(f"{name}_{d}") for d in dims for name, f in (("lo", F.min), ("hi", F.max))]).head()
    weight = total["w"] or 0
    leaves = leaves or max(1, -(-weight // int(max(1, target_bytes or 1))))
    spans = {d: max(1.0, float((total[f"hi_{d}"] or 0) - (total[f"lo_{d}"] or 0))) for d in dims}
    root = Node(leaves, weight)
    if weight:
        while nodes := _open(root):
            _widest(points, root, nodes, dims, spans)
            lost = [n for n in nodes if not hasattr(n, "low")]
            for n in lost:  # a node without points
                n.dim, n.value = dims[0], 0
            _medians(points.sparkSession, points, root, [n for n in nodes if n not in lost], weight / leaves)
            for n in nodes:
                half = n.leaves // 2
                n.left, n.right = Node(half, round(n.weight * half / n.leaves)), Node(n.leaves - half, n.weight - round(n.weight * half / n.leaves))
    number = [0]

    def name(n: Node) -> None:
        if n.left is None:
            n.shard, number[0] = number[0], number[0] + 1
        else:
            name(n.left)
            name(n.right)

    name(root)
    return root


def shard(docs: DataFrame, leaves: int | None = 16, target_bytes: float | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null under this law) of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    code = lambda c: F.crc32(F.encode(F.coalesce(F.col(c), F.lit("\u0000")), "UTF-8"))
    meta = [c for c in ("source", "lang") if c in docs.columns]
    points = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        *[code(c).alias(f"dim_{c}") for c in meta],
        F.length(text).cast("long").alias("dim_chars"),
        F.xxhash64(F.col("doc_id"), text).bitwiseAND(F.lit(SPAN - 1)).alias(TIE),
    ).withColumn("weight", F.col("size"))
    points = checkpointed(points)
    dims = ["dim_chars", *[f"dim_{c}" for c in meta]]
    root = grow(points, dims, target_bytes, leaves)
    placed = points.withColumn("shard", _leaf_number(root, {}).cast("int"))
    return with_slots(placed).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast(T.IntegerType()).alias("grown_shard"))


def with_slots(placed: DataFrame) -> DataFrame:
    """Adds ``slot``, gapless from 0 in each shard.

    Rows are numbered inside hash buckets of a shard of about ``SLOT_ROWS`` rows; the
    buckets' counts give where each bucket begins."""
    rows = placed.count()
    buckets = max(1, rows // (16 * SLOT_ROWS))
    bucketed = placed.withColumn("bucket", F.pmod(F.col(TIE), F.lit(buckets)))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = bucketed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("shard", "bucket").orderBy(TIE, "doc_id", "text_crc32")
    numbered = bucketed.withColumn("row", F.row_number().over(inside) - 1)
    return numbered.join(starts, ["shard", "bucket"]).withColumn("slot", (F.col("start") + F.col("row")).cast("long"))
