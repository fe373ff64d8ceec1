"""Components found at once, and joined later by further edges, against a plain union of sets."""

import random

from textloom.llm.common import Scratch
from textloom.llm.components import connected_components, joined_components

KIND = "a long, b long"


def plain(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return {x: find(x) for x in root}


def found(rows):
    got = [tuple(r) for r in rows.select("node", "root").collect()]
    assert len(got) == len(dict(got)), "a node stands once"
    return dict(got)


def test_further_edges_join_components(spark):
    draw = random.Random(3)
    first = [(draw.randrange(-60, 60), draw.randrange(-60, 60)) for _ in range(45)] + [(1, 1), (7, 9), (7, 9)]
    first = [(a, b) for a, b in first if a != b]
    scratch = Scratch(spark, "joined")
    roots = connected_components(spark.createDataFrame(first, KIND), scratch, "first")
    assert found(roots) == plain(first)
    more = [(draw.randrange(-90, 90), draw.randrange(-90, 90)) for _ in range(50)]
    more = [(a, b) for a, b in more if a != b] + [(200, 201), (201, 202), (202, 200), (200, 201)]
    assert found(joined_components(roots, spark.createDataFrame(more, KIND), scratch, "more")) == plain(first + more)


def test_edges_that_join_nothing_change_nothing(spark):
    scratch = Scratch(spark, "joined")
    first = [(k, k + 1) for k in range(40)]
    roots = connected_components(spark.createDataFrame(first, KIND), scratch, "path")
    for edges in ([], [(0, 40), (5, 17), (3, 3)]):
        assert joined_components(roots, spark.createDataFrame(edges, KIND), scratch, f"same{len(edges)}") is roots
    none = connected_components(spark.createDataFrame([], KIND), scratch, "none")
    assert found(joined_components(none, spark.createDataFrame([(4, 2)], KIND), scratch, "one")) == {4: 2, 2: 2}
