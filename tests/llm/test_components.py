"""Components against a plain search."""

import random

import pytest

from censemble.llm.components import connected_components


def plain(edges):
    around = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            around.setdefault(a, set()).add(b)
            around.setdefault(b, set()).add(a)
    out = {}
    for start in sorted(around):
        todo = [start]
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = start
                todo += around[x]
    return out


@pytest.mark.parametrize("edges", [
    [],
    [(1, 1), (None, 2), (3, None)],
    [(i, i + 1) for i in range(60)],
    [(0, i) for i in range(1, 200)] + [(5, 500), (500, 501)],
    [(1, 2), (2, 1), (1, 2), (4, 3)],
    [(a, b) for r in [random.Random(3)] for a, b in ((r.randrange(300), r.randrange(300)) for _ in range(200))],
])
def test_components(spark, edges):
    got = connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r.node: r.component for r in got} == plain(edges) and len(got) == len(plain(edges))
