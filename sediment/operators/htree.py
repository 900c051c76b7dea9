"""Hash trees: building from ordered addresses, walking as a recursive query, and reading by ranges.

A node lists (leaf count as little-endian u64, 32-byte child address) and is addressed by the SHA-256 of
these bytes. It closes once it has the minimum size and either its last child's address starts with two
bytes 255 or one more child would pass the maximum size. A level of one node ends the tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ENTRY = 40
MIN_NODE = 2 * ENTRY
MAX_NODE = 20 * 1024 * 1024
DEFAULT_MIN = 512 * 1024
#: A tree has at most this height.
MAX_HEIGHT = 10


class TreeBuilder:
    """Takes leaf addresses in order; `nodes` are (parent, pos, height, leaf_count, child) rows of closed nodes."""

    def __init__(self, min_size: int = DEFAULT_MIN, max_size: int = MAX_NODE):
        if not MIN_NODE <= min_size <= max_size:
            raise ValueError("node sizes")
        self.min_size, self.max_size = min_size, max_size
        self.levels: list[list[tuple[int, str]]] = []
        self.nodes: list[tuple[str, int, int, int, str]] = []
        self.leaves = self.inner = 0

    def add(self, address: str) -> None:
        self.leaves += 1
        self._push(0, 1, address)

    def _push(self, level: int, count: int, address: str) -> None:
        if level == len(self.levels):
            self.levels.append([])
        own = self.levels[level]
        own.append((count, address))
        size = len(own) * ENTRY
        if size >= self.min_size and (address.startswith("ffff") or size + ENTRY > self.max_size):
            self._close(level)

    def _close(self, level: int) -> None:
        own, self.levels[level] = self.levels[level], []
        if not own:
            return
        body = b"".join(n.to_bytes(8, "little") + bytes.fromhex(a) for n, a in own)
        parent = hashlib.sha256(body).hexdigest()
        self.nodes += [(parent, k, level + 1, n, a) for k, (n, a) in enumerate(own)]
        self.inner += 1
        self._push(level + 1, sum(n for n, _ in own), parent)

    def finish(self) -> tuple[str, int, int, int]:
        """(root address, height, leaves, leaves and inner nodes)."""
        if not self.leaves:
            raise ValueError("a tree has at least one leaf")
        level = 0
        while not (level == len(self.levels) - 1 and len(self.levels[level]) == 1):
            self._close(level)
            level += 1
        return self.levels[level][0][1], level, self.leaves, self.leaves + self.inner


def build(addresses: DataFrame, min_size: int = DEFAULT_MIN, max_size: int = MAX_NODE) -> DataFrame:
    """Edges and one root row (pos -1, child = root) for each tree of (tree_id string, pos, address).

    Rows of a tree stream through one task in order, batch by batch; only open nodes are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, builder = None, None

        def rows(last: bool):
            out = builder.nodes
            builder.nodes = []
            if last:
                root, height, leaves, _ = builder.finish()
                out = [*out, *builder.nodes, (None, -1, height, leaves, root)]
            return pa.RecordBatch.from_arrays([pa.array([tree] * len(out), pa.string()), *(pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string())))], names=["tree_id", "parent", "pos", "height", "leaf_count", "child"])

        for batch in batches:
            for t, a in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if builder is None or t != tree:
                    if builder is not None:
                        yield rows(True)
                    tree, builder = t, TreeBuilder(min_size, max_size)
                builder.add(a)
            if builder is not None and builder.nodes:
                yield rows(False)
        if builder is not None:
            yield rows(True)

    ordered = addresses.repartition("tree_id").sortWithinPartitions("tree_id", "pos").select("tree_id", "address")
    return ordered.mapInArrow(run, "tree_id string, parent string, pos int, height int, leaf_count long, child string")


def nodes(edges: DataFrame) -> DataFrame:
    """Distinct edges, without the root rows; equal nodes of several trees are one."""
    return edges.where("pos >= 0").dropDuplicates(["parent", "pos"]).select("parent", "pos", "height", "leaf_count", "child")


def roots(edges: DataFrame) -> DataFrame:
    return edges.where("pos < 0").select("tree_id", F.col("child").alias("root"), "height", F.col("leaf_count").alias("data_chunk_count"))


def reachable(tops: DataFrame, edges: DataFrame, height: int = MAX_HEIGHT) -> DataFrame:
    """Distinct addresses (address) of all nodes and leaves below the roots (root, height), which they include.

    One join for each level, each on distinct addresses only; shared sub-trees are walked once."""
    level = tops.select(F.col("root").alias("address"), "height").distinct()
    out = level.select("address")
    links = edges.select("parent", "child").distinct()
    top = min(height, tops.agg(F.max("height")).first()[0] or 0)
    for _ in range(top):
        level = level.where("height > 0").join(links, level["address"] == links["parent"]).select(F.col("child").alias("address"), (F.col("height") - 1).alias("height")).distinct()
        out = out.unionByName(level.select("address"))
    return out.distinct()


def leaf_positions(tops: DataFrame, edges: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    """(tree_id, idx, address) of the leaves of (tree_id, root, height), in order of idx, by descending with the leaf counts.

    ranges (tree_id, start_idx, end_idx), inclusive: sub-trees outside them are left out on the way down."""
    own = Window.partitionBy("parent").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    placed = edges.select("parent", "child", "leaf_count", F.coalesce(F.sum("leaf_count").over(own), F.lit(0)).alias("before"))
    level = tops.select("tree_id", F.col("root").alias("address"), F.col("height").alias("h"), F.lit(0).cast("long").alias("idx"), F.col("data_chunk_count").alias("n") if "data_chunk_count" in tops.columns else F.lit(1 << 62).alias("n"))
    spans = None if ranges is None else ranges.select(F.col("tree_id").alias("t"), "start_idx", "end_idx")
    top = min(MAX_HEIGHT, tops.agg(F.max("height")).first()[0] or 0)
    out = None
    for k in range(top + 1):
        if spans is not None:
            level = level.join(spans, (level["tree_id"] == spans["t"]) & (level["idx"] <= spans["end_idx"]) & (level["idx"] + level["n"] > spans["start_idx"]), "left_semi")
        found = level.where("h = 0").select("tree_id", "idx", "address")
        out = found if out is None else out.unionByName(found)
        if k < top:
            level = level.where("h > 0").join(placed, level["address"] == placed["parent"]).select("tree_id", F.col("child").alias("address"), (F.col("h") - 1).alias("h"), (F.col("idx") + F.col("before")).alias("idx"), F.col("leaf_count").alias("n"))
    return out


def verify(edges: DataFrame) -> DataFrame:
    """Parents whose bytes don't hash to their address."""
    body = F.transform(F.array_sort(F.collect_list(F.struct("pos", "leaf_count", "child"))), lambda e: F.concat(_le64(e["leaf_count"]), F.lower(e["child"])))
    checked = edges.groupBy("parent").agg(F.sha2(F.unhex(F.array_join(body, "")), 256).alias("found"))
    return checked.where("found <> parent").select("parent")


def _le64(n):
    text = F.lpad(F.lower(F.hex(n)), 16, "0")
    return F.concat(*(F.substring(text, 15 - 2 * k, 2) for k in range(8)))
