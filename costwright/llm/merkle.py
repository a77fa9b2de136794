"""Merkle manifest of a dataset, its subtrees stored in van Emde Boas order.

Each tree key (a source) has a tree over its leaves in their order; its root is a leaf of the top tree over all keys.
A tree is cut into aligned subtrees of BLOCK leaves. One group builds one subtree, and its root is a leaf of
the next layer, until each tree has one root left; so no task sees more than BLOCK nodes of a tree,
however many rows a key has. A subtree is stored as one value, recursively split at half its height: the upper half
first, then the lower subtrees from left to right, each laid out in the same way. The place of a node follows
from its depth and number alone, for building as for reading the siblings of a proof.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from costwright.llm.shared import removed, written

FANOUT = 16
#: Hash levels of a stored subtree, and its leaves.
LEVELS = 3
BLOCK = FANOUT**LEVELS
DIGEST = 32


def tree_size(height: int) -> int:
    """Nodes of a complete tree with that many levels of nodes."""
    return (FANOUT**height - 1) // (FANOUT - 1)


@lru_cache(maxsize=16)
def addresses(height: int) -> tuple[np.ndarray, ...]:
    """For each depth the places of its nodes in van Emde Boas order."""
    if height == 1:
        return (np.zeros(1, np.int64),)
    top = height // 2
    upper, lower = addresses(top), addresses(height - top)
    bottom = tree_size(top) + np.arange(FANOUT**top) * tree_size(height - top)
    return (*upper, *((bottom[:, None] + level).ravel() for level in lower))


def node_counts(leaves: int, height: int) -> list[int]:
    """Nodes that are there at each depth of a subtree with that many leaves, the last run shorter."""
    counts = [leaves]
    for _ in range(height - 1):
        counts.append(-(-counts[-1] // FANOUT))
    return counts[::-1]


def height_of(leaves: int, whole: bool) -> int:
    """Levels of nodes of a subtree: as many as its leaves need, all if it is one of several of its tree."""
    if not whole:
        return LEVELS + 1
    height = 1
    while leaves > 1:
        leaves, height = -(-leaves // FANOUT), height + 1
    return height


def hashed(hex_digests: str) -> bytes:
    return hashlib.sha256(hex_digests.encode()).digest()


class Subtree:
    """Nodes of one aligned subtree, 32 bytes each, in van Emde Boas order; absent nodes are zero."""

    def __init__(self, nodes: np.ndarray, leaves: int, height: int) -> None:
        self.nodes, self.height = nodes, height
        self.places, self.counts = addresses(height), node_counts(leaves, height)
        self._runs: dict[tuple[int, int], str] = {}

    @classmethod
    def built(cls, digests: np.ndarray, whole: bool) -> Subtree:
        """From the digests of its leaves, shape (leaves, 32)."""
        height = height_of(len(digests), whole)
        tree = cls(np.zeros((tree_size(height), DIGEST), np.uint8), len(digests), height)
        tree.nodes[tree.places[-1][: len(digests)]] = digests
        for depth in range(height - 2, -1, -1):
            parents = [hashed(tree.run(depth + 1, i)) for i in range(tree.counts[depth])]
            tree.nodes[tree.places[depth][: len(parents)]] = np.frombuffer(b"".join(parents), np.uint8).reshape(-1, DIGEST)
        return tree

    @classmethod
    def stored(cls, data: bytes, leaves: int, height: int) -> Subtree:
        return cls(np.frombuffer(data, np.uint8).reshape(-1, DIGEST), leaves, height)

    @property
    def root(self) -> bytes:
        return self.nodes[0].tobytes()

    def run(self, depth: int, parent: int) -> str:
        """The digests below a node, as hex text from left to right."""
        known = self._runs.get((depth, parent))
        if known is None:
            end = min((parent + 1) * FANOUT, self.counts[depth])
            known = self.nodes[self.places[depth][parent * FANOUT : end]].tobytes().hex()
            self._runs[depth, parent] = known
        return known

    def path(self, leaf: int) -> list[tuple[str, str]]:
        """Per level, from the leaf upwards, the siblings left and right of the node on its way to the root."""
        found = []
        for depth in range(self.height - 1, 0, -1):
            run, at = self.run(depth, leaf // FANOUT), leaf % FANOUT * 2 * DIGEST
            found.append((run[:at], run[at + 2 * DIGEST :]))
            leaf //= FANOUT
        return found


def _tree_key(column: Column) -> Column:
    """A key as text that sorts null first and then bytewise."""
    return F.when(column.isNull(), "").otherwise(F.concat(F.lit("="), column.cast("string")))


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with `pos`, their place in the order within `tree`, and `total`, the rows of their tree.

    Rows are sorted in ranges, numbered within each range, and the ranges of a tree are added
    up; only one row per range and tree meets in a window.
    """
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    names, schema = rows.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            trees = batch.column(names.index("tree")).dictionary_encode()
            code = trees.indices.to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
            seq = np.arange(len(code)) - np.repeat(starts, np.diff(np.append(starts, len(code))))
            head = int(starts[1]) if len(starts) > 1 else len(code)
            if trees.dictionary[int(code[0])].as_py() == last:
                seq[:head] += seen
            last, seen = trees.dictionary[int(code[-1])].as_py(), int(seq[-1]) + 1
            extra = [pa.array(np.full(len(code), part), pa.int64()), pa.array(seq, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*names, "part", "seq"])

    keys = ["tree", *order, "tie"]
    ranges = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    counted = written(ranges.mapInArrow(numbered, f"{schema}, part bigint, seq bigint"), "numbered")
    of_tree = Window.partitionBy("tree")
    starts = (
        counted.groupBy("tree", "part")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "tree",
            "part",
            (F.sum("n").over(of_tree.orderBy("part")) - F.col("n")).alias("start"),
            F.sum("n").over(of_tree).alias("total"),
        )
    )
    return counted.join(starts, ["tree", "part"]).withColumn("pos", F.col("start") + F.col("seq")).drop(
        "part", "seq", "start", "tie"
    )


_BLOCKS = "tree string, block bigint, blocks bigint, leaves int, height int, nodes binary, root binary"


def _built(leaves: DataFrame) -> DataFrame:
    """One row per subtree over `tree`, `pos`, `total` and `digest`."""

    def build(group: pa.Table) -> pa.Table:
        group = group.sort_by("pos")
        digests = np.frombuffer(b"".join(group["digest"].to_pylist()), np.uint8).reshape(-1, DIGEST)
        blocks = -(-group["total"][0].as_py() // BLOCK)
        tree = Subtree.built(digests, blocks == 1)
        row = {
            "tree": group["tree"][0].as_py(), "block": group["block"][0].as_py(), "blocks": blocks,
            "leaves": len(digests), "height": tree.height, "nodes": tree.nodes.tobytes(), "root": tree.root,
        }
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        return pa.table({k: pa.array([v], kind) for (k, v), kind in zip(row.items(), kinds)})

    block = F.expr(f"pos div {BLOCK}").alias("block")
    return leaves.select("tree", block, "pos", "total", "digest").groupBy("tree", "block").applyInArrow(build, _BLOCKS)


def _layers(leaves: DataFrame) -> list[DataFrame]:
    """The subtrees of all trees from the leaves up, written, a layer at a time, until each tree has one root."""
    layers = []
    while True:
        layers.append(written(_built(leaves), "subtrees"))
        if not layers[-1].filter("blocks > 1").limit(1).count():
            return layers
        leaves = layers[-1].filter("blocks > 1").select(
            "tree", F.col("block").alias("pos"), F.col("blocks").alias("total"), F.col("root").alias("digest")
        )


@dataclass
class Manifest:
    """Tables in the shared folder.

    leaves: tree, pos, total, order, digest and what was carried; layers: the subtrees of the trees, leaves first;
    subroots: the roots of the trees (key, digest) as leaves of the top tree; top: the subtrees of the top tree.
    """

    leaves: DataFrame
    layers: list[DataFrame]
    subroots: DataFrame
    top: list[DataFrame]
    order: str


def record_digest(*columns: Column) -> Column:
    """SHA-256 of a row: each value as `-` if null, else its UTF-8 byte count, a colon and the value."""
    parts = [
        F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
        for c in columns
    ]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def build(
    docs: DataFrame,
    digest: Column,
    tree: str = "source",
    order: str = "doc_id",
    carry: dict[str, Column] | None = None,
) -> Manifest:
    """The manifest of all rows: a tree per value of `tree`, its leaves ascending by `order`, a top tree over the trees.

    A null key has a tree of its own, the first; null orders come first; rows equal in both
    are ordered by their digest, so the manifest does not depend on how rows are stored, and repeated rows
    are leaves of their own. A lone leaf is its tree's root. carry names further columns of docs to keep
    with a leaf. An empty table has no leaves, no subtrees and no root. Nothing but the columns used is read.
    """
    carry = carry or {}
    leaves = docs.select(
        _tree_key(F.col(tree)).alias("tree"), F.col(order).alias("order"), digest.alias("digest"),
        *(c.alias(f"carry_{name}") for name, c in carry.items()),
    )
    leaves = written(leaves, "leaves")
    placed = written(_placed(leaves, ["order", "digest"]), "placed")
    removed(leaves)
    layers = _layers(placed)
    roots = [layer.filter("blocks = 1").select("tree", "root") for layer in layers]
    subroots = roots[0]
    for more in roots[1:]:
        subroots = subroots.unionByName(more)
    top = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("key"), F.col("root").alias("digest"))
    top = written(_placed(top, ["key"]), "subroots")
    return Manifest(placed, layers, top, _layers(top), order)


_SIDES = "lefts array<string>, rights array<string>"
#: What every leaf below a root gets from above.
_ABOVE = ["lefts", "rights", "subroot", "root"]


def _paths_below(blocks: DataFrame) -> DataFrame:
    """(tree, pos, lefts, rights, subroot, root): the way of each leaf of the given subtrees to the root, upper levels included."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = pa.list_(pa.string())
        for batch in batches:
            for row in batch.to_pylist():
                tree = Subtree.stored(row["nodes"], row["leaves"], row["height"])
                for first in range(0, row["leaves"], FANOUT * FANOUT):
                    numbers = range(first, min(first + FANOUT * FANOUT, row["leaves"]))
                    paths = [list(zip(*tree.path(i))) or [(), ()] for i in numbers]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row["tree"]] * len(numbers), pa.string()),
                            pa.array([row["block"] * BLOCK + i for i in numbers], pa.int64()),
                            pa.array([[*p[0], *row["lefts"]] for p in paths], strings),
                            pa.array([[*p[1], *row["rights"]] for p in paths], strings),
                            pa.array([row["subroot"]] * len(numbers), pa.binary()),
                            pa.array([row["root"]] * len(numbers), pa.binary()),
                        ],
                        names=["tree", "pos", *_ABOVE],
                    )

    chosen = blocks.select("tree", "block", "leaves", "height", "nodes", *_ABOVE)
    return chosen.mapInArrow(spread, f"tree string, pos bigint, {_SIDES}, subroot binary, root binary")


def _with_paths(layers: list[DataFrame], ends: DataFrame) -> DataFrame:
    """The lowest layer's subtrees with the way of their roots to the root; ends gives it for whole trees (by tree)."""
    below = None
    for layer in reversed(layers):
        layer = layer.withColumnRenamed("root", "own")
        found = layer.filter("blocks = 1").join(ends, "tree")
        if below is not None:
            ways = _paths_below(below).withColumnRenamed("pos", "block")
            found = found.unionByName(layer.filter("blocks > 1").join(ways, ["tree", "block"]))
        below = written(found, "paths")
    return below


def proofs(manifest: Manifest, claimed: str | None = None, siblings: bool = False) -> DataFrame:
    """Per leaf its order, what it carries, and its proof: leaf, subroot, root, proof_sha256, folded_root, verified.

    The siblings on the way to the root are read from the stored subtrees. folded_root is what
    they give with the carried digest `claimed` where that is not null, else with the stored leaf; verified tells whether
    that is the root. proof_sha256 hashes all siblings, level by level from the leaf up, left to right; with
    siblings they are returned too, as arrays `lefts` and `rights` with one text per level.
    """
    none = F.array().cast("array<string>")
    ends = manifest.top[-1].filter("blocks = 1").select(
        "tree", none.alias("lefts"), none.alias("rights"), F.lit(None).cast("binary").alias("subroot"), "root"
    )
    ways = _paths_below(_with_paths(manifest.top, ends)).drop("subroot")
    keys = manifest.subroots.select("tree", "pos", "key", F.col("digest").alias("subroot"))
    of_trees = ways.join(keys, ["tree", "pos"]).select(F.col("key").alias("tree"), *_ABOVE)
    blocks = _with_paths(manifest.layers, written(of_trees, "tree-paths"))
    blocks = blocks.select("tree", "block", "leaves", "height", "nodes", *_ABOVE)

    rows = manifest.leaves.withColumn("block", F.expr(f"pos div {BLOCK}")).drop("total")
    carried = [c for c in rows.columns if c.startswith("carry_")]
    kept = [f for f in rows.schema.fields if f.name == "order" or f.name in carried]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    claim = f"carry_{claimed}" if claimed else None

    def prove(group: pa.Table, block: pa.Table) -> pa.Table:
        (row,) = block.to_pylist()
        tree = Subtree.stored(row["nodes"], row["leaves"], row["height"])
        upper, subroot, root = list(zip(row["lefts"], row["rights"])), row["subroot"].hex(), row["root"].hex()
        upper_text = "".join([left + right for left, right in upper])
        group = group.sort_by("pos")
        given = (group[claim] if claim else pa.nulls(len(group), pa.binary())).to_pylist()
        leaves, digests, folded, lefts, rights = [], [], [], [], []
        for pos, leaf, other in zip(group["pos"].to_pylist(), group["digest"].to_pylist(), given):
            path = tree.path(pos % BLOCK)
            leaves.append(leaf.hex())
            digests.append(hashed("".join([left + right for left, right in path]) + upper_text).hex())
            path += upper
            node = (leaf if other is None else other).hex()
            for left, right in path:
                node = hashed(left + node + right).hex()
            folded.append(node)
            if siblings:
                lefts.append([p[0] for p in path])
                rights.append([p[1] for p in path])
        n = len(leaves)
        columns = {f.name: group[f.name] for f in kept} | {
            "leaf": pa.array(leaves), "subroot": pa.array([subroot] * n), "root": pa.array([root] * n),
            "proof_sha256": pa.array(digests), "folded_root": pa.array(folded),
            "verified": pa.array([f == root for f in folded]),
        }
        if siblings:
            columns |= {"lefts": pa.array(lefts, pa.list_(pa.string())), "rights": pa.array(rights, pa.list_(pa.string()))}
        return pa.table(columns)

    schema += ", leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    found = (
        rows.groupBy("tree", "block")
        .cogroup(blocks.groupBy("tree", "block"))
        .applyInArrow(prove, f"{schema}, {_SIDES}" if siblings else schema)
    )
    return found.select(
        *(F.col(c).alias(manifest.order if c == "order" else c.removeprefix("carry_")) for c in found.columns)
    )
