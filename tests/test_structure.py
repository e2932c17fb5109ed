"""Nearest anchors, labels and levels against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_graph_queries import reach
from tidewrack.functions import paths
from tidewrack.operators import graphs, ranges


@pytest.mark.parametrize("width", [5, 10_000])
def test_nearest(spark, width):
    rng = random.Random(1)
    points = [(i, rng.choice("ab"), rng.randrange(100)) for i in range(60)] + [(60, "none", 5)]
    anchors = [(rng.choice("ab"), rng.randrange(0, 100, 4), 1000 - k) for k in range(20)]
    found = ranges.nearest(spark.createDataFrame(points, "id int, key string, at long"), spark.createDataFrame(anchors, "key string, at long, anchor int"), "key", "at", "anchor", "nearest", width)
    assert found.columns == ["id", "key", "at", "nearest"]
    for r in found.collect():
        mine = [(abs(at - r.at), at, a) for key, at, a in anchors if key == r.key]
        assert r.nearest == (min(mine)[2] if mine else None)


def test_labels_go_to_all_sources(spark):
    rng = random.Random(2)
    links = {(rng.randrange(30), rng.randrange(30)) for _ in range(40)}
    seeds = [(rng.randrange(30), 1 << rng.randrange(3)) for _ in range(6)] + [(3, 0), (99, 4)]
    got = {r.node: r.labels for r in graphs.spread_labels(spark.createDataFrame(seeds, "node int, labels int"), spark.createDataFrame(sorted(links), "src int, dst int")).collect()}
    want = {}
    for bit in (1, 2, 4):
        for node in reach(links, [n for n, b in seeds if b == bit]):
            want[node] = want.get(node, 0) | bit
    assert got == want


def test_levels(spark):
    rng = random.Random(3)
    edges = {tuple(sorted(rng.sample(range(25), 2))) for _ in range(40)}
    level = {}
    for node in range(25):
        if any(node in e for e in edges):
            level[node] = max((level[a] + 1 for a, b in edges if b == node), default=0)
    got = graphs.topological_levels(spark.createDataFrame(sorted(edges), "src int, dst int"))
    assert {r.node: r.level for r in got.collect()} == level
    ring = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src int, dst int")
    with pytest.raises(ValueError, match="cycle"):
        graphs.topological_levels(ring)
    parts = graphs.strong_components(ring)
    assert sorted(map(tuple, graphs.condensed(ring, parts).collect())) == [(1, 4)]
    assert graphs.topological_levels(ring.limit(0)).count() == 0


def test_normal_paths(spark):
    cases = [("/a/./b//c", "/a/b/c"), ("a/../b", "b"), ("../a", "../a"), ("a/../../b", "../b"), ("./", ""), ("/", "/"), ("", ""), (None, None)]
    assert [r[0] for r in spark.createDataFrame([c[:1] for c in cases], "p string").select(paths.normalise(F.col("p"))).collect()] == [c[1] for c in cases]
