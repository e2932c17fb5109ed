"""Components and strong components of random graphs, long chains and stars against brute force."""

import random

import pytest

from tests.test_graph_queries import reach
from tidewrack.operators import graphs


def strong(edges):
    nodes = {x for e in edges for x in e}
    ahead = {a: reach(edges, {b for x, b in edges if x == a}) for a in nodes}
    mates = {a: [b for b in ahead[a] if a in ahead[b]] for a in nodes}
    return sorted((a, min(m), len(m)) for a, m in mates.items() if m)


def graph(rng, kind):
    if kind == "random":
        return {(rng.randrange(40), rng.randrange(40)) for _ in range(rng.randrange(20, 70))}
    names = rng.sample(range(1000), 60)
    chain = set(zip(names, names[1:]))
    if kind == "chain":
        return chain
    if kind == "rings on a chain":  # small cycles that one path leads through
        return chain | {(names[k + 3], names[k]) for k in range(0, 50, 7)} | {(5000, 5000), (names[9], names[9])}
    return chain | {(names[-1], names[0])}


@pytest.mark.parametrize("kind", ["random", "random", "random", "chain", "rings on a chain", "ring"])
def test_strong_components(spark, kind):
    edges = graph(random.Random(len(kind)), kind)
    got = graphs.strong_components(spark.createDataFrame(sorted(edges), "src long, dst long"))
    assert sorted(map(tuple, got.collect())) == strong(edges)


@pytest.mark.parametrize("kind", ["random", "chain", "ring"])
def test_components(spark, kind):
    edges = graph(random.Random(3), kind) | {(7000, 7000)}
    both = edges | {(b, a) for a, b in edges}
    got = graphs.components(spark.createDataFrame(sorted(edges), "src long, dst long"))
    assert sorted(map(tuple, got.collect())) == sorted((a, min(reach(both, [a]))) for a in {x for e in edges for x in e})


def test_empty_graphs(spark):
    none = spark.createDataFrame([], "src long, dst long")
    assert graphs.strong_components(none).count() == 0 and graphs.components(none).count() == 0
