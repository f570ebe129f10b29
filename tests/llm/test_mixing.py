import math
import random

import pytest
from pyspark.sql import functions as F

from tests.llm.cases import TEXTS, awkward, nothing
from tidemark.llm import mixing


def slow_targets(words, weights=(5, 2, 1), most=3):
    """Share by weight, cut at capacity, share the excess again until nothing is above."""
    order = sorted(words, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full = {}
    while True:
        left = sum(words.values()) - sum(full.values())
        rest = [s for s in order if s not in full]
        if not rest:
            return full
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] >= most * words[s]]
        if not over:
            return full | share
        full |= {s: float(most * words[s]) for s in over}


def made(spark, seed, n=600):
    rng = random.Random(seed)
    sources = ["a", "b", "é", "Z", None, "hot"]
    rows = []
    for i in range(n):
        size = int(rng.lognormvariate(3, 1.5)) if rng.random() > 0.05 else 0
        rows.append((i, " ".join(["w"] * size), rng.choice(sources) if rng.random() > 0.4 else "hot"))
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string, source string")


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_are_met_and_caps_hold(spark, seed):
    rows, docs = made(spark, seed)
    got = mixing.plan(docs, bucket_rows=100).collect()
    words, taken = {}, {}
    for r in got:
        words[r.source] = words.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert 0 <= r.taken <= 3 * r.size and 0 <= r.copies <= 3
        assert r.copies in (math.floor(r.rate), math.ceil(r.rate))
    wanted = slow_targets(words)
    for r in got:
        assert r.words == words[r.source] and r.target == pytest.approx(wanted[r.source])
    for source, target in wanted.items():
        assert abs(taken[source] - target) <= 1
    again = mixing.plan(docs.repartition(5), bucket_rows=100).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_rates_solve_the_dual(spark):
    rows, docs = made(spark, 3)
    by = {}
    for r in mixing.plan(docs).collect():
        by.setdefault(r.source, []).append(r)
    for rs in by.values():
        total = sum(r.rate * r.size for r in rs)
        assert total == pytest.approx(rs[0].target, rel=1e-6, abs=1e-2)
        tilts = [math.log(r.rate) / r.size for r in rs if r.size and r.rate < 3]
        assert all(t == pytest.approx(tilts[0], rel=1e-6) for t in tilts)  # one exponential tilt per source


def test_mixed_rows_hold_the_words_taken(spark):
    rows, docs = made(spark, 4, 200)
    chosen = mixing.plan(docs).groupBy("source").agg(F.sum("taken").alias("n"))
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    mixed = out.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n"))
    assert sorted(map(str, chosen.collect())) == sorted(map(str, mixed.collect()))


def test_awkward_rows(spark):
    docs = awkward(spark)
    chosen = mixing.plan(docs)
    assert chosen.agg(F.sum("rows")).first()[0] == len(TEXTS)
    assert all(0 <= r.taken <= 3 * r.size for r in chosen.collect())
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.plan(nothing(spark)).count() == 0 and mixing.mix(nothing(spark)).count() == 0


def test_sources_without_words(spark):
    docs = spark.createDataFrame([(1, "", "a"), (2, None, "b"), (3, " ", None)], "doc_id bigint, text string, source string")
    assert [(r.target, r.taken) for r in mixing.plan(docs).collect()] == [(0.0, 0)] * 3


def test_no_python_on_the_main_path(spark):
    _, docs = made(spark, 5, 50)
    plan = mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))
