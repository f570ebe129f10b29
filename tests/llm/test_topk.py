import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import topk

SCHEMA = "vec_id bigint, embedding array<float>, label int, score int, q int, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 1, 1) for i, v in rows], SCHEMA)


def slow(rows, asked, k):
    usable = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    import numpy as np
    whole = [(i, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v in rows if i is not None and usable(v)]
    out = []
    for q, a in set(whole):
        if asked(q):
            scores = {(-max(-2**63, min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=False)))), i)
                      for i, b in whole if i != q}
            out += [(q, place + 1, i, -s) for place, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def check(spark, rows, asked, k=5, **how):
    df = frame(spark, rows)
    queries = df.where(F.col("vec_id").isin([i for i, _ in rows if i is not None and asked(i)]))
    got = topk.top_k(df, queries, k, **how).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == slow(rows, asked, k)


@pytest.mark.parametrize("slices, block", [(1, 100), (4, 100), (4, 5), (7, 16)])
def test_agrees_with_all_scores(spark, slices, block):
    rng = random.Random(slices)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(200)]
    check(spark, rows, lambda i: i % 10 == 0, slices=slices, query_block=block)


def test_ties_negative_scores_and_few_candidates(spark):
    check(spark, [(i, [1.0, 1.0]) for i in range(40)], lambda i: i % 7 == 0)
    check(spark, [(i, [-1.0, 1.0] if i % 2 else [1.0, -1.0]) for i in range(9)], lambda i: i < 3)
    check(spark, [(1, [1.0]), (2, [2.0])], lambda i: True)
    check(spark, [(1, [1.0])], lambda i: True)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [3.0, 4.0]), (1, [3.0, 4.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]),
            (6, []), (7, [2.0]), (None, [9.0, 9.0]), (8, [0.0, 0.0]), (9, [1e30, 1e30]), (10, [-1e30, 1e29])]
    check(spark, rows, lambda i: True)


def test_a_row_that_several_partitions_hold_counts_once(spark):
    rest = [(i, [float(i), 1.0]) for i in range(12)]
    rows = [(20, [50.0, 1.0])] * 6 + [(21, [40.0, 1.0])] * 6 + rest
    df = spark.createDataFrame(spark.sparkContext.parallelize([(i, v, 0, 1, 1, 1) for i, v in rows], len(rows)), SCHEMA)
    assert df.rdd.getNumPartitions() == len(rows)
    got = topk.top_k(df, df.where("vec_id in (1, 20)")).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == slow(rows, lambda i: i in (1, 20), 5)


def batch(ids, vectors):
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array([list(v) for v in vectors], pa.list_(pa.float64()))], ["vec_id", "embedding"])


def test_totals_are_computed_for_collected_entries_only():
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (40, 32))
    vectors = centres[rng.integers(0, 40, 4000)] + rng.normal(0, 0.2, (4000, 32))
    ids = np.arange(4000)
    asked, queries = ids[::50], np.floor(256 * vectors[::50])
    one, two = Counter(), Counter()
    (listed,) = topk._phase(iter([batch(ids, vectors)]), asked, queries, None, 5, 4, one)
    every = queries @ np.floor(256 * vectors).T
    every[asked[:, None] == ids[None, :]] = -np.inf
    kth = np.sort(every, axis=1)[:, -5]
    cutoffs = [sorted(s for q, s in zip(listed["q"].to_pylist(), listed["score"].to_pylist()) if q == i)[0]
               for i in range(len(asked))]
    assert (np.array(cutoffs) <= kth).all()
    (found,) = topk._phase(iter([batch(ids, vectors)]), asked, queries, cutoffs, 5, 4, two)
    assert sorted(found["score"].to_pylist()) == sorted(np.sort(every, axis=1)[:, -5:].ravel().astype(int).tolist())
    pairs = every.size
    assert one["totals"] <= 2 * 4 * 5 * len(asked)  # two blocks of rows, four lists of five
    assert two["totals"] < pairs / 4 and two["partials"] < 4 * pairs / 2
    assert two["totals"] >= (every >= np.array(cutoffs)[:, None]).sum()


def test_no_vectors(spark):
    assert topk.top_k(frame(spark, []), frame(spark, [])).count() == 0
