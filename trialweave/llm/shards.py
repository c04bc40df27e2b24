"""Sharding by a k-d tree over document metadata."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialweave.llm.common import hash_cell, running_total
from trialweave.session import materialise

#: Histogram rows of one pass over all nodes, and the least bins of one node.
BINS, LEAST_BINS = 1 << 16, 64
#: Blocks of one shard's rows; bits of a metadata value and of the tie-breaking hash below it.
BLOCKS = 4096
VALUE_BITS, TIE_BITS = 30, 32
#: Bytes every document costs besides its text.
OVERHEAD = 16


@dataclass
class Tree:
    """Nodes as arrays: leaves below each, its first shard, and for inner nodes the cut.

    ``left`` is the first of a node's two children, or -1; keys of ``dimension`` from
    ``cut`` on go to the second.  ``low`` and ``high`` bound the keys of a node's box.
    """

    leaves: list[int]
    low: list[list[int]]
    high: list[list[int]]
    first: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    dimension: list[int] = field(default_factory=lambda: [0])
    cut: list[int] = field(default_factory=lambda: [0])
    depth: int = 0

    def split(self, node: int, dimension: int, cut: int) -> None:
        self.left[node], self.dimension[node], self.cut[node] = len(self.left), dimension, cut
        half = self.leaves[node] // 2
        for leaves, first in (
            (half, self.first[node]), (self.leaves[node] - half, self.first[node] + half)
        ):
            self.leaves.append(leaves)
            self.first.append(first)
            self.low.append(list(self.low[node]))
            self.high.append(list(self.high[node]))
            self.left.append(-1)
            self.dimension.append(0)
            self.cut.append(0)
        self.high[-2][dimension] = cut - 1
        self.low[-1][dimension] = cut

    def node_of(self, keys: Column) -> Column:
        """The node of a row: one step per level from the root, whatever the tree's size."""
        left, dimension, cut = _array(self.left), _array(self.dimension), _array(self.cut)

        def down(node: Column, _: Column) -> Column:
            key = F.get(keys, F.get(dimension, node).cast("int"))
            after = (key >= F.get(cut, node)).cast("int")
            return F.when(F.get(left, node) < 0, node).otherwise(
                F.get(left, node).cast("int") + after
            )

        if not self.depth:
            return F.lit(0)
        return F.aggregate(F.sequence(F.lit(1), F.lit(self.depth)), F.lit(0), down)


def _array(values: Sequence[int]) -> Column:
    """Numbers by node as one constant; at most two per shard and dimension."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def value_ranks(rows: DataFrame, column: str) -> DataFrame:
    """Each distinct value of a text column with its rank (from 0) in binary order.

    Values are sorted by ranges; a value's rank is its place in its range and the sizes of
    the ranges before, of which there are as many as partitions.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    in_order = materialise(
        rows.select(F.col(column).alias("value")).filter("value is not null").distinct()
        .orderBy("value")
        .select("value", F.spark_partition_id().alias("range"), place.alias("place")),
        "value-order",
    )
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = in_order.groupBy("range").agg(F.count(F.lit(1)).alias("held")).select(
        "range", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("start")
    )
    return in_order.join(starts, "range").select("value", (F.col("start") + F.col("place")).alias("rank"))


def _numbered(documents: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """doc_id, size, text_crc32 and v0, v1, ...: metadata as numbers in their order."""
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(
        "doc_id",
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        *[F.col(c).alias(f"m{i}") for i, c in enumerate(dimensions)],
    )
    kinds = dict(documents.dtypes)
    for i, c in enumerate(dimensions):
        if kinds[c] == "string":
            ranks = value_ranks(documents, c).select(
                F.col("value").alias(f"m{i}"), F.col("rank").cast("double").alias(f"v{i}")
            )
            rows = rows.join(ranks, f"m{i}", "left")
        else:
            value = F.col(f"m{i}").cast("double")
            rows = rows.withColumn(f"v{i}", F.nanvl(value, F.lit(None).cast("double")))
    return rows.select(
        "doc_id", "size", "text_crc32",
        *[F.coalesce(f"v{i}", F.lit(-1.0)).alias(f"v{i}") for i in range(len(dimensions))],
    )


def shard_documents(
    documents: DataFrame,
    dimensions: Sequence[str] = ("lang", "source", "n_chars"),
    shards: int | None = None,
    target_bytes: int | None = None,
    tolerance: float = 0.001,
) -> DataFrame:
    """Shards of near equal bytes that are boxes of metadata: a k-d tree's leaves.

    Needs doc_id, text and the dimensions; other columns are ignored.  A document weighs its
    UTF-8 bytes plus 16.  ``shards`` leaves are made, or as many as ``target_bytes`` asks.
    A node is split along its widest dimension (range of values over the table's range, the
    first of equals) at the weighted quantile that gives each side the bytes of its leaves;
    text counts by its rank among all values, and equal values are parted by a hash of the
    id, so one source may fill many shards.

    One row per input row: doc_id, size, text_crc32, shard (0 and up), slot (0 and up without
    gaps).  Null texts are empty, null or NaN metadata sorts first, repeated rows are
    documents of their own (equal keys stay together), an empty table gives no rows.  A
    document larger than a shard fills one alone; shards may be empty where documents are
    fewer than shards.

    All nodes of a level are cut together.  A pass sums bytes per node and key bin before
    the shuffle; a bin that holds the goal is binned again until its weight is below
    ``tolerance`` of a shard.  The tree travels as constant arrays, so no pass joins and no
    plan grows with the levels; the driver sees one row per node and pass.
    """
    count = len(dimensions)
    weighed = materialise(_numbered(documents, dimensions), "weighed")
    whole = weighed.agg(
        F.sum("size").alias("size"),
        *[f(f"v{i}").alias(f"{n}{i}") for i in range(count) for n, f in
          (("low", F.min), ("high", F.max))],
    ).first()
    total = whole["size"] or 0
    leaves = shards or max(1, -(-total // max(1, target_bytes or total or 1)))
    tie = F.xxhash64("doc_id", "text_crc32").bitwiseAND(F.lit((1 << TIE_BITS) - 1).cast("long"))
    keys = []
    for i in range(count):
        low, high = whole[f"low{i}"], whole[f"high{i}"]
        scaled = F.lit(0).cast("long")
        if total and high > low:
            scaled = F.floor(
                (F.col(f"v{i}") - low) / F.lit(high - low) * F.lit((1 << VALUE_BITS) - 1)
            )
        keys.append(scaled * F.lit(1 << TIE_BITS) + tie)
    rows = weighed.select("doc_id", "size", "text_crc32", F.array(*keys).alias("keys"))
    top = (1 << (VALUE_BITS + TIE_BITS)) - 1
    tree = Tree([leaves], [[0] * count], [[top] * count])
    open_nodes = [0] if leaves > 1 and total else []
    while open_nodes:
        cuts = _find_cuts(rows, tree, open_nodes, count, tolerance * total / leaves)
        born = len(tree.left)
        for node, (dimension, cut) in sorted(cuts.items()):
            tree.split(node, dimension, cut)
        tree.depth += 1
        # Nodes without rows were not cut: their shards stay empty.
        open_nodes = [n for n in range(born, len(tree.left)) if tree.leaves[n] > 1]
    shard = F.get(_array(tree.first), tree.node_of(F.col("keys")))
    assigned = materialise(
        rows.select(
            "doc_id", "size", "text_crc32", shard.cast("int").alias("shard"),
            hash_cell(BLOCKS, "doc_id", "text_crc32").alias("block"),
            F.lit(1).cast("long").alias("one"),
        ),
        "assigned",
    )
    return running_total(
        assigned, ["shard"], "block", [F.col("doc_id"), F.col("text_crc32")], {"slot": "one"}
    ).select("doc_id", "size", "text_crc32", "shard", "slot")


def _by_node(tree: Tree, values: dict[int, int], default: int = 0) -> Column:
    return F.get(_array([values.get(n, default) for n in range(len(tree.left))]), F.col("node"))


def _first_bin(bins: DataFrame, short: Column) -> DataFrame:
    """Per node the first bin whose running weight reaches ``short``."""
    upto = F.sum("held").over(
        Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        bins.withColumn("upto", upto).filter(F.col("upto") >= short)
        .groupBy("node", "size", "dimension")
        .agg(F.min(F.struct("bin", "held", "upto", "least", "most")).alias("hit"))
        .select("node", "size", "dimension", "hit.*")
    )


def _find_cuts(
    rows: DataFrame, tree: Tree, nodes: Sequence[int], count: int, slack: float
) -> dict[int, tuple[int, int]]:
    """Dimension and cut of every node with rows: keys below it hold the goal of the left
    side, to within ``slack`` or one key."""
    placed = rows.withColumn("node", tree.node_of(F.col("keys")))
    bins = max(LEAST_BINS, BINS // (len(nodes) * count))
    width = [[(h - low) // bins + 1 for low, h in zip(tree.low[n], tree.high[n], strict=True)]
             for n in range(len(tree.left))]
    at = F.col("node") * count + F.col("dimension")
    key = F.col("key")
    low = F.get(_array([v for box in tree.low for v in box]), at)
    step = F.get(_array([v for box in width for v in box]), at)
    sums = [F.sum("size").alias("held"), F.min("key").alias("least"), F.max("key").alias("most")]
    wanted = dict.fromkeys(nodes, 1)
    # One pass measures the node in all dimensions and bins it along each of them.
    measured = (
        placed.filter(_by_node(tree, wanted) == 1)
        .select("node", "size", F.posexplode("keys").alias("dimension", "key"))
        .groupBy("node", "dimension", F.call_function("div", key - low, step).alias("bin"))
        .agg(*sums)
        .repartition("node")  # for all the windows below
    )
    in_dimension = Window.partitionBy("node", "dimension")
    in_node = Window.partitionBy("node")
    span = F.shiftright(F.max("most").over(in_dimension), TIE_BITS) - F.shiftright(
        F.min("least").over(in_dimension), TIE_BITS
    )
    widest = (
        measured.withColumns({"span": span, "size": F.sum("held").over(in_dimension)})
        .withColumn("best", F.max(F.struct("span", -F.col("dimension"))).over(in_node))
        .filter("span = best.span and dimension = -best.col2")
    )
    half = {n: tree.leaves[n] // 2 for n in nodes}
    share = _by_node(tree, half) / _by_node(tree, {n: tree.leaves[n] for n in nodes}, 1)
    found = {r["node"]: r for r in _first_bin(widest, F.floor(F.col("size") * share)).collect()}
    cuts: dict[int, tuple[int, int]] = {}
    before = dict.fromkeys(found, 0)
    dimension = {n: r["dimension"] for n, r in found.items()}
    while found:
        for n, r in list(found.items()):
            goal = r["size"] * half[n] / tree.leaves[n]
            start = before[n] + r["upto"] - r["held"]
            if r["held"] <= slack or r["least"] == r["most"]:
                nearer = goal - start < start + r["held"] - goal
                cuts[n] = (dimension[n], r["least"] if nearer else r["most"] + 1)
                del found[n]
            else:  # the keys really there, so that sparse values take few passes
                before[n] = start
        if not found:
            break
        bins = max(LEAST_BINS, BINS // len(found))
        short = {n: int(r["size"] * half[n] / tree.leaves[n]) - before[n] for n, r in found.items()}
        low = _by_node(tree, {n: r["least"] for n, r in found.items()})
        high = _by_node(tree, {n: r["most"] for n, r in found.items()}, -1)
        step = _by_node(tree, {n: (r["most"] - r["least"]) // bins + 1 for n, r in found.items()}, 1)
        chosen = F.get("keys", _by_node(tree, dimension).cast("int"))
        refined = (
            placed.filter(_by_node(tree, dict.fromkeys(found, 1)) == 1)
            .select("node", "size", chosen.alias("key"))
            .filter(key.between(low, high))
            .groupBy("node", F.call_function("div", key - low, step).alias("bin"))
            .agg(*sums)
            .withColumns({
                "size": _by_node(tree, {n: r["size"] for n, r in found.items()}),
                "dimension": _by_node(tree, dimension),
            })
        )
        found = {r["node"]: r for r in _first_bin(refined, _by_node(tree, short)).collect()}
    return cuts
