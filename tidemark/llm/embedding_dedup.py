"""Embedding near-duplicates by a PCA-ordered tiled comparison.

Vectors are made unit length and turned into their principal axes, which changes no cosine. What
a pair's leading dimensions have added up to, plus the product of the two suffix norms, is an
upper bound of its cosine; a pair is left as soon as that bound cannot reach the threshold. The
same bound on the boxes around cells of vectors leaves out whole tiles before anything moves.

Equal vectors are collapsed first, so a vector that a third of all rows share is one member with
a count. Cells come from a bounded sample's medians along the leading axes, their number is
bounded, and each is packed into blocks of bounded size; a task compares two blocks. Tasks return link counts
per vector and a spanning star per linked group, never pairs.

Defined results. Vectors that are NULL, zero, of another length than the longest, or hold NULL or non-finite
components, and rows without an id, link with nothing: no links, their own component, kept. Rows repeating an id are
vectors of their own. A row without an id has no component and is not kept. An empty table gives an empty result.
Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import table, written
from tidemark.llm.components import components
from tidemark.llm.vectors import finite, matrix

THRESHOLD = 0.9
TILE = 2048  # vectors in a block: two blocks and their products are what a task holds
SAMPLE = 8192  # vectors that axes and cells are fitted on
CELLS = 4096  # at most so many cells, so boxes and their pairs stay small on the driver
AXES = 8  # leading axes that cells and boxes use
SLACK = 1e-9  # sums in another order differ by less; closer cases are computed again as given


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # no overflow of squares
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def principal_axes(sample: np.ndarray) -> np.ndarray:
    """Orthonormal columns, the strongest direction first."""
    return np.linalg.eigh(sample.T @ sample)[1][:, ::-1].copy()


def cell_splits(sample: np.ndarray, cells: int) -> list[tuple[int, float]]:
    """A balanced tree of (axis, median) splits, in heap order: the widest leading axis each time."""
    splits, members = [], [sample[:, :AXES]]
    while len(members) < cells:
        following = []
        for part in members:
            axis = int(np.argmax(np.ptp(part, axis=0))) if len(part) else 0
            cut = float(np.median(part[:, axis])) if len(part) else 0.0
            splits.append((axis, cut))
            following += [part[part[:, axis] < cut], part[part[:, axis] >= cut]]
        members = following
    return splits


def cell_of(turned: np.ndarray, splits: list[tuple[int, float]]) -> np.ndarray:
    node = np.zeros(len(turned), np.int64)
    axes, cuts = np.array([a for a, _ in splits], int), np.array([c for _, c in splits], float)
    for _ in range((len(splits) + 1).bit_length() - 1):
        node = 2 * node + 1 + (turned[np.arange(len(turned)), axes[node]] >= cuts[node])
    return node - len(splits)


def _assigned(batches: Iterator[pa.RecordBatch], axes: np.ndarray, splits: list) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            turned = _unit(matrix(batch.column("embedding"), len(axes))) @ axes
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell_of(turned, splits).astype(np.int32)), *batch.columns], ["cell", *batch.schema.names])


BLOCKS = "cell int, block bigint, ids binary, copies binary, vectors binary, low array<double>, high array<double>, rest double"


def _packed(batches: Iterator[pa.RecordBatch], axes: np.ndarray, kind: str) -> Iterator[pa.RecordBatch]:
    """Blocks of at most TILE vectors out of a partition that lies by cell, named by their first vector."""
    def block(cell: int, rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        ids = np.concatenate([r.column("node").to_numpy() for r in rows])
        copies = np.concatenate([r.column("copies").to_numpy() for r in rows])
        vectors = np.concatenate([matrix(r.column("embedding"), len(axes)) for r in rows])
        turned = _unit(vectors) @ axes
        lead = turned[:, :AXES]
        rest = float(np.sqrt((turned[:, AXES:] ** 2).sum(axis=1)).max())
        return pa.RecordBatch.from_pylist([{
            "cell": cell, "block": int(ids[0]), "ids": ids.tobytes(), "copies": copies.tobytes(),
            "vectors": vectors.astype(kind).tobytes(), "low": lead.min(axis=0).tolist(), "high": lead.max(axis=0).tolist(),
            "rest": rest}], schema=pa.schema([
                ("cell", pa.int32()), ("block", pa.int64()), ("ids", pa.binary()), ("copies", pa.binary()),
                ("vectors", pa.binary()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())),
                ("rest", pa.float64())]))

    held, count, current = [], 0, None
    for batch in batches:
        cells = batch.column("cell").to_numpy()
        edges = np.r_[0, np.flatnonzero(np.diff(cells)) + 1, len(cells)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            while a < b:
                if current is not None and (cells[a] != current or count == TILE):
                    yield block(current, held)
                    held, count = [], 0
                current = int(cells[a])
                take = min(b - a, TILE - count)
                held.append(batch.slice(a, take))
                count, a = count + take, a + take
    if count:
        yield block(current, held)


def linked(a: np.ndarray, b: np.ndarray, raw_a: np.ndarray, raw_b: np.ndarray,
           threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with cosine of at least ``threshold``, by leading dimensions and suffix norms."""
    dims = a.shape[1]
    tail = lambda m, k: np.sqrt((m[:, k:] ** 2).sum(axis=1))
    sums, done = np.zeros((len(a), len(b))), 0
    for upto in (max(1, dims // 4), max(1, dims // 2), dims):
        sums += a[:, done:upto] @ b[:, done:upto].T
        done = upto
        bound = sums if done == dims else sums + tail(a, done)[:, None] * tail(b, done)[None, :]
        alive = bound >= threshold - SLACK
        left = np.count_nonzero(alive)
        if not left or left < 0.05 * alive.size:
            break
    i, j = np.nonzero(alive)
    total = sums[i, j]
    for start in range(0, len(i) if done < dims else 0, 1 << 16):
        part = slice(start, start + (1 << 16))
        total[part] += np.einsum("ij,ij->i", a[i[part], done:], b[j[part], done:])
    close = np.abs(total - threshold) <= SLACK
    if close.any():  # as given: the plain quotient decides
        x, y = raw_a[i[close]], raw_b[j[close]]
        total[close] = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
    keep = total >= threshold
    return i[keep], j[keep]


def _stars(i: np.ndarray, j: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for all nodes of the linked pairs but the roots."""
    rows, ri = np.unique(i, return_inverse=True)
    cols, cj = np.unique(j, return_inverse=True)
    names = np.unique(np.r_[ids_a[rows], ids_b[cols]])
    at_a, at_b = np.searchsorted(names, ids_a[rows]), np.searchsorted(names, ids_b[cols])
    near = np.zeros((len(rows), len(cols)), bool)
    near[ri, cj] = True
    root = np.arange(len(names))
    while True:
        before = root.copy()
        low_a = np.minimum(root[at_a], np.where(near, root[at_b][None, :], len(names)).min(axis=1))
        np.minimum.at(root, at_a, low_a)
        low_b = np.minimum(root[at_b], np.where(near, root[at_a][:, None], len(names)).min(axis=0))
        np.minimum.at(root, at_b, low_b)
        root = root[root]
        if (root == before).all():
            break
    hung = root != np.arange(len(names))
    return names[hung], names[root[hung]]


def _compared(batches: Iterator[pa.RecordBatch], axes: np.ndarray, kind: str,
              threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            cell = {name: batch.column(name)[row].as_py() for name in batch.schema.names}
            sides = []
            for side in ("", "2"):
                raw = np.frombuffer(cell["vectors" + side], kind).astype(float).reshape(-1, len(axes))
                sides.append((np.frombuffer(cell["ids" + side], np.int64),
                              np.frombuffer(cell["copies" + side], np.int64), raw, _unit(raw) @ axes))
            (ids_a, n_a, raw_a, a), (ids_b, n_b, raw_b, b) = sides
            i, j = linked(a, b, raw_a, raw_b, threshold)
            same = cell["block"] == cell["block2"]
            if same:
                keep = i < j
                i, j = i[keep], j[keep]
            if not len(i):
                continue
            counts = {}
            for at, ids, other, weight in ((i, ids_a, j, n_b), (j, ids_b, i, n_a)):
                got = np.bincount(at, weights=weight[other].astype(float), minlength=len(ids)).astype(np.int64)
                for k in np.flatnonzero(got):
                    counts[int(ids[k])] = counts.get(int(ids[k]), 0) + int(got[k])
            nodes, roots = _stars(i, j, ids_a, ids_b)
            none = [None]
            yield pa.RecordBatch.from_arrays([
                pa.array([*counts, *nodes.tolist()], pa.int64()),
                pa.array([*counts.values(), *none * len(nodes)], pa.int64()),
                pa.array([*none * len(counts), *roots.tolist()], pa.int64())], ["node", "links", "root"])


def _cell_pairs(boxes: list, threshold: float) -> Iterator[tuple[int, int]]:
    """Pairs of cells whose boxes let a cosine reach the threshold."""
    cells = [b["cell"] for b in boxes]
    low, high = np.array([b["low"] for b in boxes]), np.array([b["high"] for b in boxes])
    rest = np.array([b["rest"] for b in boxes])
    for i in range(len(cells)):
        products = [x * y for x in (low[i], high[i]) for y in (low[i:], high[i:])]
        bound = np.maximum.reduce(products).sum(axis=1) + rest[i] * rest[i:]
        for j in np.flatnonzero(bound >= threshold - SLACK):
            yield cells[i], cells[i + int(j)]


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of (vec_id, embedding)."""
    spark = rows.sparkSession
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    usable = finite("embedding") & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    dims = rows.where(usable).agg(F.max(F.size("embedding"))).first()[0] or 0
    takes_part = usable & (F.size("embedding") == dims) & F.col("vec_id").isNotNull()
    keyed = rows.select("vec_id", "embedding", takes_part.alias("usable"), F.xxhash64("embedding").alias("k1"),
                        F.xxhash64(F.lit(1), "embedding").alias("k2"))
    members = written(
        keyed.where("usable").groupBy("k1", "k2")
        .agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("embedding").alias("embedding")),
        "members")
    found = written(_links(members, dims, threshold), "links")
    roots = written(components(found.where("root is not null").select(
        F.col("node").alias("a"), F.col("root").alias("b"))), "roots")
    links = written(found.where("links is not null").groupBy("node").agg(F.sum("links").alias("links")), "counts")
    named = written(
        members.select("k1", "k2", "node", "copies").join(links, "node", "left")
        .join(roots.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
        .select(F.col("k1").alias("m1"), F.col("k2").alias("m2"),
                (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"),
                F.coalesce("root", "node").alias("root")), "named")
    same = F.col("usable") & (F.col("k1") == F.col("m1")) & (F.col("k2") == F.col("m2"))
    return keyed.drop("embedding").join(named, same, "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).alias("n_links"),
        F.coalesce("root", "vec_id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _links(members: DataFrame, dims: int, threshold: float) -> DataFrame:
    """Link counts (node, links) and star edges (node, root) over the distinct vectors."""
    spark = members.sparkSession
    sample = members.orderBy("k2").limit(SAMPLE).select("embedding").toArrow().combine_chunks()
    if not sample.num_rows:
        return spark.createDataFrame([], "node bigint, links bigint, root bigint")
    unit = _unit(matrix(sample.column("embedding").combine_chunks(), dims))
    axes = principal_axes(unit)
    cells = min(CELLS, 1 << max(0, (-(-members.count() // TILE) - 1).bit_length()))
    splits = cell_splits(unit @ axes, cells)
    # Blocks travel as the vectors are stored; what is computed with them is in double precision.
    kind = "f4" if isinstance(members.schema["embedding"].dataType.elementType, T.FloatType) else "f8"
    schema = f"cell int, node bigint, copies bigint, embedding {members.schema['embedding'].dataType.simpleString()}"
    tiles = written(
        members.select("node", "copies", "embedding")
        .mapInArrow(lambda batches: _assigned(batches, axes, splits), schema)
        .repartition("cell").sortWithinPartitions("cell", "node")
        .mapInArrow(lambda batches: _packed(batches, axes, kind), BLOCKS), "tiles")
    by_axis = lambda f, c: F.array(*[f(F.col(c)[i]) for i in range(min(AXES, dims))]).alias(c)
    boxes = tiles.groupBy("cell").agg(by_axis(F.min, "low"), by_axis(F.max, "high"), F.max("rest").alias("rest"))
    pairs = spark.createDataFrame(list(_cell_pairs(boxes.orderBy("cell").collect(), threshold)), "c1 int, c2 int")
    names = tiles.select("cell", "block")
    tasks = (
        pairs.join(names.select(F.col("cell").alias("c1"), F.col("block").alias("b1")), "c1")
        .join(names.select(F.col("cell").alias("c2"), F.col("block").alias("b2")), "c2")
        .where("c1 < c2 or b1 <= b2").select("b1", "b2"))
    body = ["block", "ids", "copies", "vectors"]
    one, two = tiles.select(body), tiles.select([F.col(c).alias(f"{c}2") for c in body])
    return (
        tasks.join(one, F.col("b1") == F.col("block")).join(two, F.col("b2") == F.col("block2"))
        .select([*body, *[f"{c}2" for c in body]])
        .mapInArrow(lambda batches: _compared(batches, axes, kind, threshold), "node bigint, links bigint, root bigint"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


SQL = f"""
with recursive usable as (
    select vec_id, embedding::double[] as v, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x))) as norm
    from embeddings
    where vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), links as (
    select a.vec_id as a, b.vec_id as b
    from usable a join usable b on a.vec_id <> b.vec_id and a.norm > 0 and b.norm > 0
     and list_dot_product(a.v, b.v) / (a.norm * b.norm) >= {THRESHOLD}
), reach(a, b) as (
    select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a
), lowest as (
    select a, min(b) as low from reach group by a
), counted as (
    select a, count(*) as n from links group by a
)
select e.vec_id, coalesce(n, 0) as n_links, least(e.vec_id, coalesce(low, e.vec_id)) as component_id,
       e.vec_id = least(e.vec_id, coalesce(low, e.vec_id)) as kept
from embeddings e left join counted c on e.vec_id = c.a left join lowest w on e.vec_id = w.a
"""
