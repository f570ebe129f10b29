import random

import pytest

from tidemark.llm.components import components


def slow(edges):
    root = {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is None or b is None or a == b:
            continue
        root.setdefault(a, a)
        root.setdefault(b, b)
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return {x: find(x) for x in root}


@pytest.mark.parametrize("edges", [
    [], [(1, 1)], [(None, 2), (3, None)], [(5, 4), (4, 5), (4, 5)], [(i, i + 1) for i in range(60)],
    [(0, i) for i in range(1, 50)], [(i, 100) for i in range(50)] + [(-7, 100)],
    [(random.Random(i).randrange(200), random.Random(i + 999).randrange(200)) for i in range(150)],
])
def test_roots_are_the_smallest_nodes_reachable(spark, edges):
    rows = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r.node: r.root for r in rows} == slow(edges)
    assert len(rows) == len({r.node for r in rows})
