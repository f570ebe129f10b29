"""Merkle manifest of a dataset: a tree a source and one over the sources, and each document's proof folded again.

A node's digest is the SHA-256 of its children's, at most ``Shape.arity``. While a node's children are read, its running hash state
is copied before each of them. To fold a changed child the state before its slot is resumed with the replacement and
the siblings to its right only; what lies left of it is not hashed again.

Leaves are numbered per source without a global order: rows are ranged by (source, doc_id, leaf), written, counted per
range, and numbered inside it. Blocks of ``Shape.block`` consecutive nodes are a task's unit, however large a source is:
the way up turns a block into its top node, block after block until one node a source is left, and so once more over the sources. The
way down hands each block the siblings above it (a few per block, never per document), and the last step goes through the
leaves' blocks and folds every document to the root.

Defined results. A NULL column is `-`, others are their length in UTF-8 bytes, `:` and the value. The NULL source comes first, then
sources by their bytes. Leaves of equal doc_id, a NULL one before all, go by their digest; rows repeated in whole are leaves each. Tampering
lowers A-Z of the text where 5 divides the CRC-32 of the doc_id as text; a NULL id is never chosen, a NULL text stays.
Texts are hashed whole. An empty table has no root and no rows. Columns beyond the five are not part of a leaf.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, discard, partitions, table, written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left: string, right: string>>"


@dataclass(frozen=True)
class Shape:
    arity: int = 16
    levels: int = 3  # of a block

    @property
    def block(self) -> int:
        return self.arity ** self.levels


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(text: Column | None = None) -> Column:
    return F.sha2(F.concat(*[field(F.col(f) if f != "text" or text is None else text) for f in FIELDS]), 256)


class Parent:
    """A node over a run of children, with the hash state before each of them."""

    def __init__(self, children: list[str]):
        self.children, self.states = children, []
        state = hashlib.sha256()
        for child in children:
            self.states.append(state.copy())
            state.update(child.encode())
        self.digest = state.hexdigest()

    def folded(self, slot: int, replacement: str) -> str:
        state = self.states[slot].copy()
        state.update("".join([replacement, *self.children[slot + 1:]]).encode())
        return state.hexdigest()

    def siblings(self, slot: int) -> dict[str, str]:
        return {"left": "".join(self.children[:slot]), "right": "".join(self.children[slot + 1:])}


def tree(rows: list[dict[str, Any]], shape: Shape) -> list[list[Parent]]:
    """The levels over a block: until one node is left where the block is its whole tree, all of a block's else."""
    levels: list[list[Parent]] = []
    nodes = [row["digest"] for row in rows]
    while len(nodes) > 1 if rows[0]["n"] <= shape.block else len(levels) < shape.levels:
        levels.append([Parent(nodes[i:i + shape.arity]) for i in range(0, len(nodes), shape.arity)])
        nodes = [parent.digest for parent in levels[-1]]
    return levels


class Above:
    """A node on the way to the root that a block hangs under: its state with all left siblings read."""

    def __init__(self, left: str, right: str):
        self.state, self.right = hashlib.sha256(left.encode()), right.encode()
        self.siblings = left + right

    def folded(self, replacement: str) -> str:
        state = self.state.copy()
        state.update(replacement.encode() + self.right)
        return state.hexdigest()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict[str, Any]]]:
    """The rows of each (tree, block) of a partition sorted by them; a block is bounded."""
    held: list[dict[str, Any]] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and (row["tree"], row["block"]) != (held[0]["tree"], held[0]["block"]):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _tops(batches: Iterator[pa.RecordBatch], shape: Shape) -> Iterator[pa.RecordBatch]:
    for rows in _blocks(batches):
        levels = tree(rows, shape)
        top = levels[-1][0].digest if levels else rows[0]["digest"]
        yield pa.RecordBatch.from_pydict(
            {"tree": [rows[0]["tree"]], "at": pa.array([rows[0]["block"]], pa.int64()), "digest": [top],
             "n": pa.array([-(-rows[0]["n"] // shape.block)], pa.int64())})


def _paths(batches: Iterator[pa.RecordBatch], shape: Shape) -> Iterator[pa.RecordBatch]:
    """The siblings above every node of a block, those above the block behind them; the block's own come in a row at its front."""
    kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
    for above, *rows in _blocks(batches):
        levels = tree(rows, shape)
        paths = [[level[k // shape.arity ** (j + 1)].siblings(k // shape.arity ** j % shape.arity) for j, level in enumerate(levels)]
                 + above["path"] for k in range(len(rows))]
        yield pa.RecordBatch.from_arrays(
            [pa.array([row["tree"] for row in rows]), pa.array([row["at"] for row in rows], pa.int64()), pa.array(paths, kind)],
            ["tree", "at", "path"])


def _proofs(batches: Iterator[pa.RecordBatch], shape: Shape) -> Iterator[pa.RecordBatch]:
    for first, *rows in _blocks(batches):
        levels = tree(rows, shape)
        above = [Above(p["left"], p["right"]) for p in first["path"]]
        shared = "".join(a.siblings for a in above).encode()
        proofs, folded = [], []
        for k, row in enumerate(rows):
            proof, node = hashlib.sha256(), row["replaced"]
            for j, level in enumerate(levels):
                parent, slot = level[k // shape.arity ** (j + 1)], k // shape.arity ** j % shape.arity
                beside = parent.siblings(slot)
                proof.update((beside["left"] + beside["right"]).encode())
                node = parent.folded(slot, node)
            proof.update(shared)
            for parent in above:
                node = parent.folded(node)
            proofs.append(proof.hexdigest())
            folded.append(node)
        yield pa.RecordBatch.from_arrays(
            [pa.array([row["doc_id"] for row in rows], pa.int64()), pa.array([row["digest"] for row in rows]),
             pa.array([row["tree"] for row in rows]), pa.array(proofs), pa.array(folded)],
            ["doc_id", "leaf", "tree", "proof_sha256", "folded_root"])


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``at``, the place in its tree by ``order`` from 0, and ``n``, the tree's size."""
    ranged = written(rows.repartitionByRange(partitions(rows.sparkSession), "tree", *order).withColumn(
        "range", F.spark_partition_id()), "ranged")
    sizes = written(ranged.groupBy("tree", "range").agg(F.count("*").alias("own")), "sizes")
    tree_sizes = written(sizes.groupBy("tree").agg(F.sum("own").alias("n")), "tree-sizes")
    before = Window.partitionBy("tree").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(sizes.withColumn("start", F.coalesce(F.sum("own").over(before), F.lit(0))).join(tree_sizes, "tree").drop("own"), "starts")
    inside = F.row_number().over(Window.partitionBy("tree", "range").orderBy(*order)) - 1
    found = written(ranged.withColumn("inside", inside).join(starts, ["tree", "range"]).withColumn(
        "at", F.col("start") + F.col("inside")).drop("range", "start", "inside"), "numbered")
    discard(ranged, sizes, tree_sizes, starts)
    return found


def _in_blocks(nodes: DataFrame, shape: Shape) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"at div {shape.block}"))


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.repartition(partitions(rows.sparkSession), "tree", "block").sortWithinPartitions("tree", "block", "at")


def _up(nodes: DataFrame, shape: Shape) -> list[DataFrame]:
    """The nodes at every block's foot, level by level, until each tree is one node (tree, at 0, digest, n 1)."""
    layers = [nodes]
    while True:
        below = _in_blocks(layers[-1], shape).select("tree", "block", "at", "digest", "n")
        layers.append(written(_sorted(below).mapInArrow(
            lambda batches: _tops(batches, shape), "tree string, at bigint, digest string, n bigint"), "layer"))
        if layers[-1].where("n > 1").isEmpty():
            return layers


def _with_above(layer: DataFrame, paths: DataFrame, shape: Shape, *more: str) -> DataFrame:
    """A layer's rows by block, behind one row a block with the path above it."""
    rows = _in_blocks(layer, shape).select("tree", "block", "at", "digest", "n", *more, F.lit(None).cast(PATH).alias("path"))
    first = paths.select("tree", F.col("at").alias("block"), F.lit(-1).cast("long").alias("at"), F.lit(None).alias("digest"),
                         F.lit(None).cast("long").alias("n"), *[F.lit(None).alias(m) for m in more], "path")
    return _sorted(rows.unionByName(first.select(*rows.columns)))


def _below(layer: DataFrame, paths: DataFrame, shape: Shape) -> DataFrame:
    """The paths of a layer's nodes, from those of the blocks that they are in."""
    return _with_above(layer, paths, shape).mapInArrow(
        lambda batches: _paths(batches, shape), f"tree string, at bigint, path {PATH}")


def _down(layers: list[DataFrame], paths: DataFrame, shape: Shape) -> DataFrame:
    """From the paths of the trees' tops to those of the blocks of the lowest layer."""
    for layer in reversed(layers[1:-1]):
        paths = written(_below(layer, paths, shape), "paths")
    return paths


def manifest(docs: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every document."""
    chosen = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    leaves = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source"))).alias("tree"),
        leaf().alias("digest"), F.when(chosen, leaf(ascii_lower(F.col("text")))).otherwise(leaf()).alias("replaced"))
    leaves = numbered(leaves, "doc_id", "digest")
    by_source = _up(leaves, shape)
    subroots = by_source[-1]
    sources = numbered(subroots.select(F.lit("all").alias("tree"), F.col("tree").alias("name"), "digest"), "name")
    over = _up(sources, shape)
    top = over[-1].first()
    root = top.digest if top else ""
    start = over[-1].select("tree", "at", F.array().cast(PATH).alias("path"))
    own = _below(sources, _down(over, start, shape), shape)
    by_name = written(own.join(sources.select("at", "name"), "at").select(
        F.col("name").alias("tree"), F.lit(0).cast("long").alias("at"), "path"), "source-paths")
    paths = _down(by_source, by_name, shape)
    proofs = _with_above(leaves, paths, shape, "doc_id", "replaced").mapInArrow(
        lambda batches: _proofs(batches, shape), "doc_id bigint, leaf string, tree string, proof_sha256 string, folded_root string")
    return proofs.join(subroots.select("tree", F.col("digest").alias("subroot")), "tree").select(
        "doc_id", "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root",
        (F.col("folded_root") == root).alias("verified"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents").select(*FIELDS))
