"""SimHash near-duplicates by covering locality-sensitive hashing.

Each of the 64 bit places gets a vector of r + 1 bits, none of them zero; every non-zero vector v
names a table whose mask keeps the places with an odd product with v. The r places at which two
fingerprints differ span at most r dimensions, so some v is orthogonal to them all: every pair
within the radius agrees on a whole mask of some table, and none can be missed. 15 tables cover
radius 3, each with about 34 of 64 bits kept.

Only distinct fingerprints are compared. A bucket too large for one task is covered again on the places its
mask left free (about 15), and again (about 7), so the last one cannot exceed 1024 members. Buckets
return a spanning star per group of linked members, never pairs.

Defined results. NULL text has no words. Without words the fingerprint is zero, linked like any other; fewer words
than a shingle are one shingle. A NULL id belongs to the component of its fingerprint but never names it unless the
whole component has no id. Rows repeating an id each keep their own fingerprint. An empty table gives an empty
result. Other columns are carried, never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import repacked, row_key, table, written
from tidemark.llm.components import components

SHINGLE = 3
RADIUS = 3
SEED = 42
BUCKET = 1024
FEW = 10  # free places that are not covered again: at most 1024 members agree on all others
BLOCK = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority bits of the words' shingle hashes, as an unsigned integer."""
    return majority((text or "").encode("utf-8", "surrogatepass").lower().split(), shingle)


def majority(words: list[bytes], shingle: int) -> int:
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    total = len(words) - shingle + 1
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for start in range(0, total, BLOCK):
        part = words[start:start + BLOCK + shingle - 1]
        rows = zip(*[part[i:] for i in range(shingle)], strict=False)
        hashes = np.fromiter([digest(s, SEED) for s in map(b" ".join, rows)], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text"))
        prints = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), np.uint64, len(texts))
        rest = [batch.column(i) for i, f in enumerate(batch.schema) if f.name != "text"]
        names = [f.name for f in batch.schema if f.name != "text"]
        yield pa.RecordBatch.from_arrays([*rest, pa.array(prints.view(np.int64))], [*names, "fp"])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, rid, fp): fp holds the 64 bits as a signed long."""
    rows = docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("rid"), "text")
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, rid bigint, fp bigint"
    return rows.mapInArrow(lambda batches: _fingerprints(batches, shingle), schema)


def covering_masks(places: list[int], radius: int = RADIUS) -> list[int]:
    """A mask for each non-zero vector; any ``radius`` places are all left out by one of them."""
    tables = (1 << (radius + 1)) - 1
    return [sum(1 << place for i, place in enumerate(places) if ((i % tables + 1) & v).bit_count() & 1)
            for v in range(1, tables + 1)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _stars(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Per bucket of a sorted partition, link members within the radius and emit spanning stars."""
    held, name = [], None
    for batch in batches:
        frame = batch.to_pydict()
        for bucket, fp in zip(zip(frame["path"], frame["key"], strict=True), frame["fp"], strict=True):
            if bucket != name:
                yield from _star(held, radius)
                held, name = [], bucket
            held.append(fp)
    yield from _star(held, radius)


def _star(members: list[int], radius: int) -> Iterator[pa.RecordBatch]:
    if len(members) < 2:
        return
    values = np.unique(np.array(members, np.int64))
    bits = values.view(np.uint64)
    root = np.arange(len(values))
    near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= radius
    if near.all():
        root[:] = 0
    else:
        while True:
            low = np.where(near, root[None, :], len(values)).min(axis=1)
            low = low[low]
            if (low == root).all():
                break
            root = low
    hung = np.flatnonzero(root != np.arange(len(values)))
    if len(hung):
        yield pa.RecordBatch.from_arrays([pa.array(values[hung]), pa.array(values[root[hung]])], ["a", "b"])


def links(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(a, b) edges spanning every group of distinct fingerprints linked within the radius."""
    tables = (1 << (radius + 1)) - 1
    members = prints.select("fp").distinct().select(
        "fp", F.lit(0).cast("long").alias("path"), F.lit(0).cast("long").alias("fixed"))
    free = {0: list(range(64))}  # by path: the places that no mask on the way has kept
    found = None
    while True:
        masks = {path: covering_masks(places, radius) for path, places in free.items()}
        rest = {path * tables + t + 1: [p for p in places if not masks[path][t] >> p & 1]
                for path, places in free.items() for t in range(tables)}
        last = all(len(places) <= FEW for places in rest.values())
        by_path = F.create_map(*[x for path, own in masks.items() for x in (
            F.lit(path).cast("long"), F.array(*[F.lit(_signed(m)) for m in own]))])
        rows = (
            members.select("fp", "path", "fixed", F.posexplode(by_path[F.col("path")]).alias("t", "mask"))
            .select("fp", (F.col("path") * tables + F.col("t") + 1).alias("path"),
                    F.col("fixed").bitwiseOR(F.col("mask")).alias("fixed"))
            .withColumn("key", F.col("fp").bitwiseAND(F.col("fixed")))
        )
        sizes = written(rows.groupBy("path", "key").count().where("count > 1"), "buckets")
        shared = written(rows.join(sizes, ["path", "key"]), "shared")
        small = shared if last else shared.where(F.col("count") <= bucket)
        stars = (small.select("path", "key", "fp").repartition("path", "key").sortWithinPartitions("path", "key")
                 .mapInArrow(lambda batches: _stars(batches, radius), "a bigint, b bigint"))
        found = stars if found is None else found.unionAll(stars)
        large = shared.where(F.col("count") > bucket)
        if last or large.isEmpty():
            return found
        paths = [r["path"] for r in large.select("path").distinct().collect()]  # 15 at most, then 225
        free = {path: rest[path] for path in paths}
        members = large.select("fp", "path", "fixed")


def suspects(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(a, b) names spanning every group of (name, fp) linked within the radius: a name hangs on the first one of its
    fingerprint, first ones hang on one another as their fingerprints' ``links`` do."""
    firsts = written(prints.groupBy("fp").agg(F.min("name").alias("first")), "firsts")
    same = prints.join(firsts, "fp").where("name <> first").select(F.col("name").alias("a"), F.col("first").alias("b"))
    a, b = (firsts.select(F.col("fp").alias(x), F.col("first").alias(f"first_{x}")) for x in ("a", "b"))
    linked = links(prints, radius, bucket).distinct().join(a, "a").join(b, "b").select(
        F.col("first_a").alias("a"), F.col("first_b").alias("b"))
    return same.unionAll(linked)


def grouped(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """The fingerprints with their component's root and component_id, the smallest document id in it."""
    roots = written(components(links(prints, radius, bucket)), "roots")
    firsts = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    named = written(firsts.join(roots, F.col("fp") == F.col("node"), "left").select(
        F.col("fp").alias("of"), "first", F.coalesce("root", "fp").alias("root")), "named")
    lowest = written(named.groupBy("root").agg(F.min("first").alias("component_id")), "lowest")
    members = written(named.select("of", "root").join(lowest, "root"), "members")
    return prints.join(members, F.col("fp") == F.col("of")).drop("of")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    return grouped(written(fingerprints(docs, shingle), "prints"), radius)


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One document of each component stays: that with the smallest id, a NULL id behind all others;
    of rows sharing that id the first by content, once."""
    best = near_duplicates(docs, shingle, radius).groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("anonymous"), "doc_id", "rid")).alias("best"))
    return first_rows(docs, best)


def first_rows(docs: DataFrame, best: DataFrame) -> DataFrame:
    """The documents that (anonymous, doc_id, rid) structs in ``best`` name, each once, with all their columns."""
    kept = written(best.select(F.col("best.doc_id").alias("kept_id"), F.col("best.rid").alias("kept")), "kept")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id",
                       row_key(F.col("doc_id"), F.col("text")).alias("rid"))
    stays = (F.col("rid") == F.col("kept")) & F.col("doc_id").eqNullSafe(F.col("kept_id"))
    repeat = F.row_number().over(Window.partitionBy("rid").orderBy("rid"))
    return repacked(rows.join(kept, stays).withColumn("repeat", repeat).where("repeat = 1"), "row")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
