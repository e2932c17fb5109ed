"""The driver's contract, and kernels that the tables do not exercise."""

import __spark_entry__ as entry
from pyspark.sql import functions as F

from tidewrack.functions import paths
from tidewrack.operators import graphs, keys, ranges
from tidewrack.sources import scripts, sinks
from tidewrack.streaming import intake


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_names_agree():
    assert entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).limit(3).count() == 3


def test_base36_graph(spark):
    out = spark.createDataFrame([("base/feature:0/lazy:0,1",), ("a:1/b",), ("a/a",), ("a/b:!",)], "g string")
    got = out.select(paths.decode_graph(F.col("g")).alias("m")).collect()
    assert [[(e.pos, e.id, e.deps) for e in r.m] if r.m else None for r in got] == [[(0, "base", []), (1, "feature", [0]), (2, "lazy", [0, 1])], None, None, None]


def test_relative_paths(spark):
    cases = [("a/b/c.js", "./d.js", "a/b/d.js"), ("a/b/c.js", "../d.js", "a/d.js"), ("c.js", "../d.js", None), ("a/c.js", "d", None), ("a/c.js", "./x/./../y", "a/y")]
    df = spark.createDataFrame([c[:2] for c in cases], "b string, s string")
    assert [r[0] for r in df.select(paths.resolve_relative(F.col("b"), F.col("s"))).collect()] == [c[2] for c in cases]


def test_variants_prefer_the_exact_name(spark):
    facts = spark.createDataFrame([("a",), ("a.js",), ("b.jsx",), ("c",)], "key string")
    specs = spark.createDataFrame([("./a",), ("a.js",), ("b",), ("c.js",), ("d",)], "spec string")
    assert rows(keys.lookup_by_variants(specs, facts, "spec", "key")) == [("./a", "a"), ("a.js", "a.js"), ("b", "b.jsx"), ("c.js", "c"), ("d", None)]


def test_suffix_collisions_are_found(spark):
    df = spark.createDataFrame([(1, "a"), (2, "A"), (3, "a_2")], "k int, n string")
    named = keys.suffix_duplicates(df, "n", ["k"])
    assert rows(named.select("unique_name")) == [("A_2",), ("a",), ("a_2",)] and keys.suffix_collisions(named).count() == 1


def test_ranges_that_touch_merge(spark):
    df = spark.createDataFrame([("k", 0, 5), ("k", 5, 7), ("k", 9, 10), ("k", 1, 2)], "k string, s int, e int")
    assert rows(ranges.coalesce_ranges(df, ["k"], "s", "e", 4)) == [("k", 0, 7, 3), ("k", 9, 10, 1)]


def test_pure_cycles_stay_pure(spark):
    nodes = spark.createDataFrame([(1, True), (2, True), (3, True), (4, False), (5, True)], "node int, pure boolean")
    imports = spark.createDataFrame([(1, 2), (2, 1), (3, 4), (5, 99)], "src int, dst int")
    assert rows(graphs.transitively_pure(nodes, imports)) == [(1,), (2,)]


def test_one_missing_report_stops_the_cascade(spark):
    schema, imports = "node int, helper boolean, entry boolean, pure boolean", spark.createDataFrame([(2, 3), (3, 2)], "src int, dst int")
    full = [(1, False, True, True), (2, True, False, True), (3, True, False, True)]
    assert rows(graphs.drop_cascade(spark.createDataFrame(full, schema), imports)) == [(2,), (3,)]
    assert rows(graphs.drop_cascade(spark.createDataFrame([*full, (4, True, False, None)], schema), imports)) == []


def test_chains_and_cycles(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (6, 5), (7, 5)], "src int, dst int")
    assert rows(graphs.follow_chain(links)) == [(1, 3), (2, 3)]
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (4, 4), (3, 5)], "src int, dst int")
    assert rows(graphs.strong_components(edges)) == [(1, 1, 2), (2, 1, 2), (4, 4, 1)]


def test_reference_edges(spark):
    items = spark.createDataFrame([(0, ["a"], ["b"]), (1, ["b", "a"], ["a", "b"]), (2, [], ["a", "z"])], "i int, d array<string>, r array<string>")
    assert rows(graphs.reference_edges(items, "i", "d", "r")) == [(0, 1), (2, 1)]


def test_sources_and_sinks(spark, tmp_path):
    for name in ("b.js", "a.mjs", "node_modules/x.js", ".hidden/y.js", "note.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    found = scripts.script_files(spark, str(tmp_path))
    assert [(i, c) for i, _, c in rows(found.select("input_id", "filename", "code"))] == [(0, "a.mjs"), (1, "b.js")]
    maps = spark.createDataFrame([('{"version":3,"sources":["a.js","../b.js","c.js"],"sourcesContent":["x","y",null]}',)], "source_map string")
    assert rows(scripts.embedded_sources(maps)) == [("a.js", "x")]
    old = spark.createDataFrame([("f", "1"), ("g", "2")], "filename string, code string")
    new = spark.createDataFrame([("f", "1"), ("g", "3"), ("h", "4")], "filename string, code string")
    assert rows(sinks.changed(new, old)) == [("g", "3"), ("h", "4")]


def test_intake_counts_every_file_once(spark, tmp_path):
    source, seen = str(tmp_path / "in"), []
    cases = [("amd", F.col("code").contains("define("))]
    args = (spark, source, "filename string, code string", str(tmp_path / "out"), str(tmp_path / "state"), cases, "skip", lambda df: seen.append(rows(df.select("filename", "format", "code"))))
    for name, code in (("a", "define(1)"), ("b", "plain")):
        spark.createDataFrame([(name, code)], "filename string, code string").write.mode("append").parquet(source)
        intake.intake(*args)
    assert seen == [[("a", "amd", "define(1)")], [("a", "amd", "define(1)"), ("b", "plain", None)]]
