"""Kernels over fact tables, names and mappings on small cases."""

import random

import pytest
from pyspark.sql import functions as F

from tidewrack.functions import names
from tidewrack.operators import facts, graphs, ranges
from tidewrack.sources import mappings


def test_planned_paths(spark):
    def plan(*names, **kept):
        rows = spark.createDataFrame([(n,) for n in names], "path string")
        return {r.path: r.public_path for r in facts.planned_paths(rows, "path", **kept).collect()}

    assert plan("/a/b/x.js", "/a/b/y.js", "rel/z.js") == {"/a/b/x.js": "x.js", "/a/b/y.js": "y.js", "rel/z.js": "rel/z.js"}
    assert plan("/a/b/x.js", "/a/./bc/../bc/y.js") == {"/a/b/x.js": "b/x.js", "/a/./bc/../bc/y.js": "bc/y.js"}
    assert plan("src/x.js", "../../pkg/y.js", "./src//z.js") == {"src/x.js": "src/x.js", "../../pkg/y.js": "pkg/y.js", "./src//z.js": "src/z.js"}
    assert plan("/a/x.js", "/b/y.js", claims=F.col("path") == "/b/y.js") == {"/a/x.js": None, "/b/y.js": "b/y.js"}
    assert plan("/a/x.js") == {"/a/x.js": None} and plan() == {}
    for clash in (("/a/./x.js", "/a/x.js"), ("/a/b/x.js", "X.js", "/a/b/y.js"), ("lib/x.js", "../lib/x.js")):
        with pytest.raises(ValueError, match="2 modules claim"):
            plan(*clash)
    with pytest.raises(ValueError, match="no public path"):
        plan("..", "a.js")


def test_default_repairs(spark):
    providers = spark.createDataFrame(
        [("star", True, True, True), ("none", False, False, True), ("object", False, True, True), ("attached", False, True, False)],
        "provider string, export_all boolean, has_default boolean, default_object boolean",
    )
    imports = spark.createDataFrame([(p, n) for p in ("star", "none", "object", "attached", "unknown") for n in ("a", "b")], "provider string, name string")
    named = spark.createDataFrame([("object", "b")], "provider string, name string")
    attached = spark.createDataFrame([("attached", "a"), ("object", "a"), ("star", "a")], "provider string, name string")
    assert sorted(map(tuple, facts.default_repairs(imports, providers, named, attached).collect())) == [("attached", "a"), ("object", "a")]


def test_names(spark):
    texts = ["a", "$x_1", "1a", "class", "a b", "", None, "été", "a-b.c"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", names.is_identifier(F.col("t")).alias("ok"), names.to_identifier(F.col("t")).alias("made")).collect()
    assert [r.t for r in rows if r.ok] == ["a", "$x_1", "été"]
    assert [r.made for r in rows] == ["a", "$x_1", "_1a", "_class", "ab", "_", None, "été", "abc"]


def encode(values):
    out = ""
    for v in values:
        v = (-v << 1 | 1) if v < 0 else v << 1
        while True:
            v, digit = v >> 5, v & 31
            out += mappings.DIGITS[digit | (32 if v else 0)]
            if not v:
                break
    return out


def test_mappings_round_trip(spark):
    rng = random.Random(3)
    want, lines, last = [], [], [0, 0, 0, 0]
    for line in range(30):
        segments, column = [], 0
        for _ in range(rng.randrange(4)):
            step = rng.randrange(200)
            column += step
            size = rng.choice([1, 4, 5])
            fields = [rng.randrange(0, 5000) for _ in range(size - 1)]
            segments.append(encode([step] + [f - x for f, x in zip(fields, last)]))
            last[: size - 1] = fields
            want.append((line, column, *fields, *[None] * (5 - size)))
        lines.append(",".join(segments))
    maps = spark.createDataFrame([("m", ";".join(lines)), ("empty", "")], "map string, mappings string")
    got = mappings.mapping_rows(maps, "map").where("map = 'm'").select("line", "column", "source", "source_line", "source_column", "name").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert mappings.mapping_rows(maps, "map").where("map = 'empty'").count() == 0


def shortest_cycle(edges, start, members):
    paths = [[start]]
    while paths:
        paths = sorted([*p, b] for p in paths for a, b in edges if a == p[-1] and b in members and a != b and b not in p[1:])
        for p in paths:
            if p[-1] == start:
                return p
    return None


def test_witnesses(spark):
    rng = random.Random(8)
    edges = {(rng.randrange(14), rng.randrange(14)) for _ in range(22)} | {(20, 20), (30, 31), (31, 30), (30, 30)}
    reach = {a: {a} for a in range(40)}
    for _ in range(40):
        for a, b in edges:
            reach[a] |= {b}
        for a in reach:
            reach[a] |= set().union(*(reach[b] for b in reach[a]))
    want = {}
    for a in range(40):
        members = {b for b in range(40) if b in reach[a] and a in reach[b]}
        if min(members) == a and (len(members) > 1 or (a, a) in edges):
            want[a] = (len(members), shortest_cycle(sorted(edges), a, members) if len(members) > 1 else [a, a])
    got = graphs.cycle_witnesses(spark.createDataFrame(sorted(edges), "src long, dst long")).collect()
    assert {r.component: (r["size"], r.witness) for r in got} == want


def test_ranges_do_not_depend_on_buckets(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(3), s := rng.randrange(1000), s + rng.randrange(1, 60)) for _ in range(120)]
    spans = spark.createDataFrame(rows, "k int, b long, e long")
    results = {w: sorted(map(tuple, ranges.coalesce_ranges(spans, ["k"], "b", "e", w).collect())) for w in (7, 100, 10_000)}
    assert results[7] == results[100] == results[10_000]
    left = spark.createDataFrame([(k, t, t * 10 + k) for k in range(3) for t in range(0, 1000, 37)], "k int, at long, id long")
    right = spark.createDataFrame([(k, b, i) for i, (k, b, _) in enumerate(rows)], "k int, at long, v long")
    found = {w: sorted(map(repr, ranges.as_of(left, right.withColumn("o", F.col("v")), "k", "at", "o", "v", "last", w).collect())) for w in (7, 100, 10_000)}
    assert found[7] == found[100] == found[10_000]
    assert any("last=None" not in r for r in found[7])
