import random

import numpy as np
import pytest

from tidewire.llm.common import Links
from tidewire.llm.components import components


def expected(links):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


def graphs():
    rng = random.Random(1)
    yield "chain", [(i, i + 1) for i in range(200)]
    yield "star", [(0, i) for i in range(1, 300)]
    yield "random", [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]
    yield "negative", [(-5, 3), (3, -9), (7, 8), (8, 8)]


@pytest.mark.parametrize("name,links", list(graphs()))
def test_smallest_point_of_each_group(spark, name, links):
    found = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    joined = {x for a, b in links if a != b for x in (a, b)}
    assert found == {x: y for x, y in expected(links).items() if x in joined}


def test_no_links_and_null_ends(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert components(spark.createDataFrame([(1, None), (None, 2), (3, 3)], "a long, b long")).count() == 0


def test_links_of_a_shard():
    rng = np.random.default_rng(2)
    for points in (1, 5, 300):
        a, b = rng.integers(0, points, (2, 200))
        links = Links(points, room=16)
        for i in range(0, 200, 7):
            links.add(a[i : i + 7], b[i : i + 7])
        want = expected([*zip(a.tolist(), b.tolist()), *((i, i) for i in range(points))])
        assert links.settle().tolist() == [want[i] for i in range(points)]
