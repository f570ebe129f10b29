"""Ranked lexical search for many items at once, their common terms evaluated once.

Items become sets of terms, read in one order (terms of most items first). Neighbouring pairs that two or more items
share become a node of their own, again and again, until no two items share a neighbouring pair: a graph in which a node is
the sum of two others and an item is the sum of the few nodes that are left of it. For a block of documents every term's
and every shared node's accumulators are made once, as a row of numbers, and every item adds up its own nodes. Sums
are of integers, so the order of adding changes nothing.

Documents are read and split once: how often each holds each of the items' terms is written, which gives counts for the weights
and then the scores. A task keeps the ``TOP`` best documents of each item; those of all tasks meet in one ranking.
Items are taken in blocks of ``ITEMS``; documents are scored ``ROWS`` at a time.

Defined results. Terms are runs of ASCII letters and digits and of everything beyond ASCII; only A-Z are lowered. NULL and
empty texts hold no term and are not counted. Rows that share an item's id are one item with the terms of all; rows of
documents that repeat an id are ranked each. Equal scores go by doc_id, a NULL id last. Texts are split whole. No
documents or no items, no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import discard, table, written

TOP = 50
ITEMS = 512
ROWS = 512
_KEPT = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(128, 256))
_SPLIT = bytes(b if b in _KEPT else 32 for b in bytes(range(256)).lower())


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_SPLIT).split()


def sharing(items: Sequence[Sequence[int]], size: int) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """Nodes beyond the ``size`` terms, each the pair it adds up, and every item as nodes.

    Each round counts neighbouring pairs over all items and replaces those of two or more, the most shared first.
    """
    held = Counter(term for item in items for term in set(item))
    rows = [sorted(set(item), key=lambda term: (-held[term], term)) for item in items]
    nodes: list[tuple[int, int]] = []
    while True:
        pairs = Counter(pair for row in rows for pair in pairwise(row))
        shared = {pair: k for k, (pair, n) in enumerate(pairs.most_common()) if n > 1}
        if not shared:
            return nodes, rows
        used: dict[tuple[int, int], int] = {}
        after = []
        for row in rows:
            out, at = [], 0
            while at < len(row):
                pair = tuple(row[at:at + 2])
                rank = shared.get(pair)
                if rank is None or shared.get(tuple(row[at + 1:at + 3]), rank) < rank:
                    out.append(row[at])
                    at += 1
                    continue
                if pair not in used:
                    used[pair] = size + len(nodes)
                    nodes.append(pair)
                out.append(used[pair])
                at += 2
            after.append(out)
        rows = after


def _matches(batches: Iterator[pa.RecordBatch], place: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """Per document its number of terms, and of the items' terms which it holds and how often."""
    for batch in batches:
        sizes, found, times = [], [], []
        for text in batch.column("text"):
            words = terms(text.as_py())
            own = sorted((place[w], c) for w, c in Counter(words).items() if w in place)
            sizes.append(len(words))
            found.append([p for p, _ in own])
            times.append([c for _, c in own])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int32())),
             pa.array(times, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "times"])


class _Best:
    """The highest (score, document) of every item so far."""

    def __init__(self, count: int):
        none = np.zeros(0, np.int64)
        self.scores, self.docs = [none] * count, [none] * count
        self.last = np.zeros(count, np.int64)  # a score below it cannot enter

    def add(self, scores: np.ndarray, docs: np.ndarray) -> None:
        for item, row in enumerate(scores):
            enters = np.flatnonzero((row > 0) & (row >= self.last[item]))
            if not len(enters):
                continue
            score, doc = np.r_[self.scores[item], row[enters]], np.r_[self.docs[item], docs[enters]]
            best = np.lexsort((doc, -score))[:TOP]
            self.scores[item], self.docs[item] = score[best], doc[best]
            if len(best) == TOP:
                self.last[item] = score[best[-1]]


def _ranked(batches: Iterator[pa.RecordBatch], weights: np.ndarray, nodes: list, items: list, n_all: int,
            l_all: int) -> Iterator[pa.RecordBatch]:
    best = _Best(len(items))
    size = len(weights)
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            batch = whole.slice(at, ROWS)
            ids = batch.column("doc_id").fill_null(np.iinfo(np.int64).max).to_numpy()
            m = np.array([50 + 50 * n * n_all // l_all for n in batch.column("n").to_pylist()], np.int64)
            held = batch.column("terms")
            row = np.repeat(np.arange(batch.num_rows), np.diff(held.offsets.to_numpy()))
            term, times = held.flatten().to_numpy(), batch.column("times").flatten().to_numpy()
            sums = np.zeros((size + len(nodes), batch.num_rows), np.int64)
            sums[term, row] = weights[term] * (1_000_000_000 * times // (1000 * times + 20 * m[row]))
            for k, (x, y) in enumerate(nodes):  # a shared node's accumulators, once for all items above it
                np.add(sums[x], sums[y], out=sums[size + k])
            scores = np.stack([sums[own].sum(axis=0) for own in items])
            best.add(scores, ids)
    for item in range(len(items)):
        if len(best.docs[item]):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(best.docs[item]), item), pa.int32()), pa.array(best.docs[item]),
                 pa.array(best.scores[item])], ["item", "doc_id", "score"])


def _search(docs: DataFrame, items: list[tuple]) -> DataFrame | None:
    """Rankings of one block of (id, text) items."""
    spark = docs.sparkSession
    by_id = defaultdict(set)
    for item_id, text in items:
        by_id[item_id].update(terms(text))
    by_id = {k: v for k, v in by_id.items() if v}
    if not by_id:
        return None
    words = sorted(set().union(*by_id.values()))
    place = {w: k for k, w in enumerate(words)}
    matches = written(docs.mapInArrow(
        lambda batches: _matches(batches, place), "doc_id bigint, n bigint, terms array<int>, times array<bigint>"), "matches")
    n_all, l_all = matches.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_all:
        return None
    df = dict(matches.select(F.explode("terms").alias("term")).groupBy("term").count().collect())  # the block's terms
    weights = np.array([math.floor(1000 * math.log((2 * n_all + 2) / (2 * df.get(k, 0) + 1))) for k in range(len(words))], np.int64)
    nodes, sums = sharing([[place[w] for w in own] for own in by_id.values()], len(words))
    ids = list(by_id)
    local = matches.where("n > 0").select("doc_id", "n", "terms", "times").mapInArrow(
        lambda batches: _ranked(batches, weights, nodes, sums, n_all, l_all), "item int, doc_id bigint, score bigint")
    local = written(local, "best")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
    names = spark.createDataFrame([(k, item_id) for k, item_id in enumerate(ids)], "item int, item_id bigint")
    found = written(local.withColumn("rank", rank).where(F.col("rank") <= TOP).join(F.broadcast(names), "item").select(
        "item_id", "rank", F.when(F.col("doc_id") < F.lit(np.iinfo(np.int64).max), F.col("doc_id")).alias("doc_id"), "score"), "found")
    discard(matches, local)
    return found


def search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``TOP`` best documents of every item, ids as long."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    blocks = max(1, math.ceil(items.count() / ITEMS))
    own = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    found = [_search(docs, [tuple(r) for r in items.where(own == k).collect()]) for k in range(blocks)]
    found = [f for f in found if f is not None]
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
with words as (
  select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
asked as (
  select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
sizes as (select doc_id, count(*) as n from words group by doc_id),
total as (select count(*)::bigint as n_all, sum(n)::bigint as l_all from sizes),
held as (select doc_id, term, count(*) as tf from words where term in (select term from asked) group by doc_id, term),
weights as (
  select term, floor(1000 * ln((2 * n_all + 2) / (2 * count(*) + 1)))::bigint as w from held, total group by term, n_all),
scores as (
  select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * n_all) // l_all)))))::bigint as score
  from asked join held using (term) join weights using (term) join sizes using (doc_id), total group by item_id, doc_id),
ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scores where score > 0)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 50
"""
