import numpy as np
import pytest

from tidemark.llm import embedding_dedup as dedup

SCHEMA = "vec_id bigint, embedding array<float>, label int, node bigint, copies int, links int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 1, 1) for i, v in rows], SCHEMA)


def slow(rows, threshold):
    usable = [(n, i, np.array(v, np.float32).astype(float)) for n, (i, v) in enumerate(rows)
              if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    dims = max((len(v) for *_, v in usable), default=0)
    usable = [u for u in usable if len(u[2]) == dims]
    links = {n: set() for n in range(len(rows))}
    for a, (n, _, x) in enumerate(usable):
        for m, _, y in usable[a + 1:]:
            if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                links[n].add(m)
                links[m].add(n)
    out = []
    for n, (i, _) in enumerate(rows):
        seen, todo = {n}, [n]
        while todo:
            for m in links[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        low = min((rows[m][0] for m in seen if rows[m][0] is not None), default=None)
        out.append((i, len(links[n]), low, i is not None and i == low))
    return sorted(out, key=str)


def check(spark, rows, threshold):
    got = dedup.near_duplicates(frame(spark, rows), threshold).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=str) == slow(rows, threshold)


@pytest.mark.parametrize("seed, threshold", [(1, 0.9), (2, 0.5), (3, 0.2)])
def test_links_and_components_agree_with_all_pairs(spark, seed, threshold, monkeypatch):
    monkeypatch.setattr(dedup, "TILE", 16)  # many tiles out of few vectors
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, 12)) * rng.uniform(0.1, 3, 12)
    rows = [(int(i), (centres[i % 9] + rng.normal(size=12) * 0.3 * (i % 4)).tolist()) for i in rng.permutation(150)]
    check(spark, rows, threshold)


def test_awkward_vectors_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 0.0]),
            (7, [None, 1.0]), (8, []), (9, [1.0]), (None, [1.0, 0.0]), (10, [1e-30, 0.0]), (11, [3e38, 1e38]), (12, [-1.0, 0.0])]
    check(spark, rows, 0.9)


def test_a_hot_vector_is_one_member(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(400)] + [(1000 + i, [float(i), -1.0, 0.5]) for i in range(30)]
    check(spark, rows, 0.9)


def test_no_vectors(spark):
    assert dedup.near_duplicates(frame(spark, [])).count() == 0


def test_bounds_never_rule_out_a_pair():
    rng = np.random.default_rng(9)
    for dims in (1, 2, 3, 7, 32):
        raw_a, raw_b = rng.normal(size=(40, dims)), rng.normal(size=(50, dims))
        raw_b[:20] = raw_a[:20] + rng.normal(size=(20, dims)) * 0.1
        a, b = dedup._unit(raw_a), dedup._unit(raw_b)
        axes = dedup.principal_axes(np.r_[a, b])
        got = set(zip(*[x.tolist() for x in dedup.linked(a @ axes, b @ axes, raw_a, raw_b, 0.8)], strict=True))
        assert got == set(zip(*[x.tolist() for x in np.nonzero(a @ b.T >= 0.8)], strict=True))
