"""Exact top-k inner products by a three-phase uniform threshold over slices of the dimensions.

A score is the sum of its partial scores over m slices of the dimensions, each slice being one list of the threshold
algorithm. Phase one: every block of rows sends, per query and slice, its k best entries, and only these get totals; the k-th
best total of different entries found anywhere is a cutoff that the true k-th score cannot be below. Phase two: the
cutoff goes out to all partitions, which score one slice after the other. An entry is collected at the first slice
whose partial score is at least cutoff / m: a total that reaches the cutoff must do so in one of them. An entry whose score so far
and the norms of what is left cannot reach the cutoff any more is given up; slices go on for queries and rows that
still have entries neither collected nor given up. Phase three: the entries collected, and no others, get exact totals; those that
reach the cutoff are kept, and k per query and partition go to the final ranking.

Queries come in blocks of bounded size, so what is broadcast, a block and its cutoffs, does not
grow with the table; every block meets all candidates.

Defined results. Vectors that are NULL or hold NULL or non-finite components, and rows without an id, take no part.
Shorter vectors count as filled up with zeros. A query's candidates are all rows with another id; rows repeating id
and vector count once. Scores beyond 64 bits are held at the limit. Fewer than k candidates are all returned. An
empty table gives an empty result. Other columns are never read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import fresh_folder, table
from tidemark.llm.vectors import blocks, finite, matrix

K = 5
SLICES = 4
QUERY_BLOCK = 2048
ROWS = 2048
PAIRS = 1 << 22  # components held at once for totals
EXACT = float(1 << 53)
LONGEST = (1 << 63) - 1


def _integers(column: pa.Array, dims: int) -> np.ndarray:
    return np.floor(256.0 * matrix(column, dims))


def _exact_in_doubles(queries: np.ndarray, rows: np.ndarray) -> bool:
    """Whether every sum of products stays below 2**53."""
    return np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) * max(1, queries.shape[1]) < EXACT


def _all_totals(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Totals in Python's integers, held at 64 bits; only for blocks whose sums doubles cannot hold."""
    exact = lambda m: np.array([int(x) for x in m.ravel()], object).reshape(m.shape)
    return np.clip(np.dot(exact(queries), exact(rows).T), -LONGEST - 1, LONGEST)


def _totals(queries: np.ndarray, rows: np.ndarray, q: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Exact totals of the given entries alone."""
    step = max(1, PAIRS // max(1, queries.shape[1]))
    return np.concatenate([np.zeros(0), *[
        np.einsum("ij,ij->i", queries[q[i:i + step]], rows[at[i:i + step]]) for i in range(0, len(q), step)]])


def _highest(scores: np.ndarray, k: int) -> np.ndarray:
    """Marks the k highest of every row."""
    chosen, k = np.zeros(scores.shape, bool), min(k, scores.shape[1])
    if k:
        np.put_along_axis(chosen, np.argpartition(scores, -k, axis=1)[:, -k:], True, axis=1)
    return chosen


def _listed(queries: np.ndarray, rows: np.ndarray, other: np.ndarray, edges: list, k: int) -> np.ndarray:
    """Phase one: the entries that one of the slices' lists of k holds."""
    chosen = np.zeros(other.shape, bool)
    for a, b in edges:
        chosen |= _highest(np.where(other, queries[:, a:b] @ rows[:, a:b].T, -np.inf), k)
    return chosen & other


def _left(vectors: np.ndarray, edges: list) -> list[np.ndarray]:
    """Per slice the norms of what comes after it."""
    return [np.sqrt((vectors[:, b:] ** 2).sum(axis=1)) for _, b in edges]


def _sufficient(queries: np.ndarray, rows: np.ndarray, other: np.ndarray, edges: list, cutoff: np.ndarray,
                tally: Counter) -> tuple[np.ndarray, np.ndarray]:
    """Phase two: the entries with a sufficient partial score that can still reach the cutoff."""
    qs, xs = np.arange(len(queries)), np.arange(len(rows))
    pending, score, found = other.copy(), np.zeros(other.shape), []
    for (a, b), q_left, x_left in zip(edges, _left(queries, edges), _left(rows, edges), strict=True):
        part = queries[qs, a:b] @ rows[xs, a:b].T
        tally["partials"] += part.size
        score += part
        # norms are rounded, so a little is added: an entry too many costs a total, one too few would be lost
        pending &= score + np.outer(q_left[qs] * (1 + 1e-9), x_left[xs]) >= cutoff[qs, None] - 4
        part *= len(edges)
        enough = pending & (part >= cutoff[qs, None])
        q, at = np.nonzero(enough)
        found.append((qs[q], xs[at]))
        pending ^= enough
        some_q, some_x = pending.any(axis=1), pending.any(axis=0)
        if not some_q.any():
            break
        if some_q.mean() * some_x.mean() < 0.7:  # else a smaller matrix costs more than it saves
            here = np.ix_(some_q, some_x)
            qs, xs, pending, score = qs[some_q], xs[some_x], pending[here], score[here]
    return tuple(np.concatenate(side) for side in zip((qs[:0], xs[:0]), *found, strict=True))


def _best(q: np.ndarray, score: np.ndarray, vec: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k highest scores per query, ties to the smaller id, without repeats."""
    order = np.lexsort((vec, -score, q))
    q, score, vec = q[order], score[order], vec[order]
    same = np.zeros(len(q), bool)
    same[1:] = (q[1:] == q[:-1]) & (vec[1:] == vec[:-1]) & (score[1:] == score[:-1])
    q, score, vec = q[~same], score[~same], vec[~same]
    starts = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, bool)
    place = np.arange(len(q)) - np.maximum.accumulate(np.where(starts, np.arange(len(q)), 0))
    keep = place < k
    return q[keep], score[keep], vec[keep]


RESULT = pa.schema([("q", pa.int32()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _rows(ids: np.ndarray, found: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    q, score, vec = found
    return pa.RecordBatch.from_arrays(
        [pa.array(q.astype(np.int32)), pa.array(ids[q]), pa.array(vec), pa.array(score.astype(np.int64))], schema=RESULT)


def _phase(batches: Iterator[pa.RecordBatch], ids: np.ndarray, queries: np.ndarray, cutoffs: list | None, k: int,
           slices: int, tally: Counter | None = None) -> Iterator[pa.RecordBatch]:
    """Without cutoffs the local lists of phase one, with them phases two and three. ``tally`` counts partial scores
    of phase two and totals."""
    dims, tally = queries.shape[1], Counter() if tally is None else tally
    marks = np.linspace(0, dims, slices + 1).astype(int)
    edges = list(zip(marks[:-1], marks[1:], strict=True))
    best = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
    limit = None if cutoffs is None else np.array(cutoffs, object)
    rounded = None if cutoffs is None else limit.astype(float)  # doubles hold every cutoff that a double total can reach
    for batch in blocks(batches, ROWS):
        vec, rows = batch.column(0).to_numpy(), _integers(batch.column(1), dims)
        other = ids[:, None] != vec[None, :]
        if _exact_in_doubles(queries, rows):
            q, at = (np.nonzero(_listed(queries, rows, other, edges, k)) if cutoffs is None
                     else _sufficient(queries, rows, other, edges, rounded, tally))
            total = _totals(queries, rows, q, at)
            cutoff = rounded
        else:  # one list, of totals
            whole = _all_totals(queries, rows)
            q, at = np.nonzero(other & (_highest(np.where(other, whole, -(1 << 200)), k) if cutoffs is None
                                        else whole >= limit[:, None]))
            total = whole[q, at]
            cutoff = limit
        tally["totals"] += len(q)
        if cutoffs is not None:
            reached = total >= cutoff[q]
            q, at, total = q[reached], at[reached], total[reached]
        best = _best(*[np.r_[old, new] for old, new in zip(best, (q, total, vec[at]), strict=True)], k)
    if len(best[0]):
        yield _rows(ids, best)


def top_k(rows: DataFrame, queries: DataFrame, k: int = K, slices: int = SLICES,
          query_block: int = QUERY_BLOCK) -> DataFrame:
    """The k best (vec_id, embedding) rows for every query row, by integer inner product."""
    spark = rows.sparkSession
    usable = lambda df: df.where(finite("embedding") & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    rows, queries = usable(rows), usable(queries).distinct()
    dims = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    dims = max(dims, queries.agg(F.max(F.size("embedding"))).first()[0] or 0)
    in_blocks = max(1, -(-queries.count() // (query_block * 3 // 4)))
    block_of = F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(in_blocks))
    schema = "q int, query_id bigint, vec_id bigint, score bigint"
    out = fresh_folder(spark, "topk")
    ranking = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    for block in range(in_blocks):
        asked = queries.where(block_of == block).orderBy("vec_id", "embedding").toArrow().combine_chunks()
        if asked.num_rows:
            ids = asked.column("vec_id").to_numpy()
            matrix_ = _integers(asked.column("embedding").combine_chunks(), dims)
            held = spark.sparkContext.broadcast((ids, matrix_))
            run = lambda cut, held=held: rows.mapInArrow(
                lambda batches: _phase(batches, *held.value, cut.value if cut else None, k, slices), schema
            ).distinct()  # a row that several partitions hold takes one place
            local = run(None).withColumn("place", F.row_number().over(ranking)).where(F.col("place") == k)
            cutoffs = [float("-inf")] * len(ids)
            for q, score in local.select("q", "score").collect():  # one number per query of the block
                cutoffs[q] = score
            given = spark.sparkContext.broadcast(cutoffs)
            exact, sent = run(given), (held, given)
        else:
            exact, sent = spark.createDataFrame([], schema), ()
        (exact.withColumn("rank", F.row_number().over(ranking)).where(F.col("rank") <= k)
         .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
         .write.mode("append").parquet(out))
        for one in sent:  # the block is written, nothing reads it again
            one.destroy()
    return spark.read.schema("query_id bigint, rank int, vec_id bigint, score bigint").parquet(out)


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(rows, rows.where(F.col("vec_id") % 50 == 0))


SQL = f"""
with usable as (
    select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
    from embeddings
    where embedding is not null and vec_id is not null
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), parts as (
    select vec_id, unnest(v) as x, generate_subscripts(v, 1) as i from usable
), scores as (
    select q.vec_id as query_id, r.vec_id, sum(q.x * r.x)::bigint as score
    from parts q join parts r on q.i = r.i and q.vec_id <> r.vec_id
    where q.vec_id % 50 = 0 group by 1, 2
), ranked as (
    select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from scores
)
select query_id, rank, vec_id, score from ranked where rank <= {K}
"""
