"""Export resolution and findings of module graphs: named cases, and random graphs against plain recursion."""

import random

import pytest

from tidewrack.operators import exports, keys
from tidewrack.plans.modules import QUERIES

EXPORTS = "module string, place int, name string, spec string, imported string, binding string"
IMPORTS = "module string, place int, local string, spec string, name string"
OWN, FROM = (lambda m, n, at=1: (m, at, n, None, None, n)), (lambda m, n, spec, imported, at=1: (m, at, n, spec, imported, None))

#: name: imports, exports, stars, and the findings of entry.js.
CASES = {
    "stars pass names on": ([("entry.js", 1, "deep", "./a.js", "deep")], [OWN("b.js", "deep")], [("a.js", 1, "./b.js")], 0),
    "two origins are ambiguous": ([("entry.js", 1, "x", "./f.js", "x")], [OWN("l.js", "x"), OWN("r.js", "x")], [("f.js", 1, "./l.js"), ("f.js", 2, "./r.js")], 1),
    "an explicit export settles it": ([("entry.js", 1, "x", "./f.js", "x")], [OWN("l.js", "x"), OWN("r.js", "x"), FROM("f.js", "x", "./l.js", "x")], [("f.js", 1, "./l.js"), ("f.js", 2, "./r.js")], 0),
    "one origin on two ways": ([("entry.js", 1, "x", "./f.js", "x")], [OWN("b.js", "x")], [("f.js", 1, "./l.js"), ("f.js", 2, "./r.js"), ("l.js", 1, "./b.js"), ("r.js", 1, "./b.js")], 0),
    "ambiguity is passed on": ([("entry.js", 1, "x", "./t.js", "x")], [OWN("l.js", "x"), OWN("r.js", "x")], [("t.js", 1, "./f.js"), ("f.js", 1, "./l.js"), ("f.js", 2, "./r.js")], 1),
    "imported, then exported": (
        [("entry.js", 1, "x", "./f.js", "x"), ("l.js", 1, "x", "./b.js", "x"), ("r.js", 1, "x", "./b.js", "x")], [OWN("b.js", "x"), OWN("l.js", "x"), OWN("r.js", "x")], [("f.js", 1, "./l.js"), ("f.js", 2, "./r.js")], 0),
    "imported from two, then exported": (
        [("entry.js", 1, "x", "./f.js", "x"), ("l.js", 1, "x", "./b.js", "x"), ("r.js", 1, "x", "./c.js", "x")], [OWN("b.js", "x"), OWN("c.js", "x"), OWN("l.js", "x"), OWN("r.js", "x")], [("f.js", 1, "./l.js"), ("f.js", 2, "./r.js")], 1),
    "a namespace on two ways": (
        [("entry.js", 1, "ns", "./f.js", "ns"), ("l.js", 1, "ns", "./b.js", None), ("r.js", 1, "ns", "./b.js", None)], [OWN("b.js", "x"), OWN("l.js", "ns"), OWN("r.js", "ns")], [("f.js", 1, "./l.js"), ("f.js", 2, "./r.js")], 0),
    "from outside, then exported": (
        [("entry.js", 1, "x", "./f.js", "x"), ("l.js", 1, "x", "some-pkg", "x"), ("r.js", 1, "x", "some-pkg", "x")], [OWN("l.js", "x"), OWN("r.js", "x")], [("f.js", 1, "./l.js"), ("f.js", 2, "./r.js")], 0),
    "default does not come through stars": ([("entry.js", 1, "a", "./f.js", "default")], [OWN("b.js", "default")], [("f.js", 1, "./b.js")], 1),
    "a star to outside hides what is missing": ([("entry.js", 1, "x", "./f.js", "x")], [], [("f.js", 1, "some-pkg")], 0),
    "a cycle gives nothing": ([("entry.js", 1, "x", "./f.js", "x")], [FROM("f.js", "x", "./l.js", "x"), FROM("l.js", "x", "./f.js", "x")], [], 1),
    "renamed on the way": ([("entry.js", 1, "x", "./f.js", "y")], [FROM("f.js", "y", "./l.js", "z"), OWN("l.js", "z")], [], 0),
    "renamed to what is missing": ([("entry.js", 1, "x", "./f.js", "y")], [FROM("f.js", "y", "./l.js", "y"), OWN("l.js", "z")], [], 1),
}


def findings(spark, imports=(), listed=(), stars=(), writes=(), constants=(), free=(), references=(), modules=()):
    said = list(references) + [(i[0], i[1], i[3]) for i in imports] + [(e[0], e[1], e[3]) for e in listed if e[3]] + list(stars)
    files = sorted({"entry.js", *modules, *(x[0] for x in [*imports, *listed, *stars]), *(s[2].removeprefix("./") for s in stars if s[2].startswith("./"))})
    make = spark.createDataFrame
    found = exports.graph_findings(
        make([(f,) for f in files], "module string"), make(said, "module string, place int, spec string"), make(list(imports), IMPORTS), make(list(listed), EXPORTS), make(list(stars), "module string, place int, spec string"),
        make(list(writes), "module string, place int, name string"), make(list(constants), "module string, name string"), make(list(free), "module string, place int, name string, probe boolean"),
    )
    return sorted(map(tuple, found.collect()))


@pytest.mark.parametrize("case", CASES)
def test_missing_names(spark, case):
    imports, listed, stars, expected = CASES[case]
    got = findings(spark, imports, listed, stars)
    assert [f[:3] for f in got if f[0] == "entry.js"] == [("entry.js", 1, "missing_imported_name")] * expected
    assert not [f for f in got if f[2] != "missing_imported_name"]


def test_other_kinds(spark):
    got = findings(
        spark,
        imports=[("a.js", 1, "x", "./b", "x"), ("a.js", 2, "y", "./nowhere.js", "y"), ("a.js", 3, "p", "pkg", "p")],
        listed=[OWN("b.js", "x", 1), OWN("b.js", "x", 5), OWN("b.js", "x", 3), OWN("b.js", "z", 4)],
        writes=[("a.js", 7, "x"), ("a.js", 8, "k"), ("a.js", 9, "free")], constants=[("a.js", "k"), ("a.js", "x")],
        free=[("a.js", 4, "module", False), ("a.js", 5, "exports", True), ("script.js", 1, "module", False), ("b.js", 2, "require", False)],
        references=[("script.js", 2, "../up.js")], modules=["script.js"],
    )
    assert got == [
        ("a.js", 2, "dangling_relative_ref", "./nowhere.js"), ("a.js", 4, "esm_commonjs_residual", "module"), ("a.js", 7, "assign_to_import", "x"), ("a.js", 8, "assign_to_const", "k"),
        ("b.js", 3, "duplicate_export", "x"), ("script.js", 2, "dangling_relative_ref", "../up.js"),
    ]
    assert findings(spark) == []


def plain(given, stars, modules, module, name, on):
    """What one key means, by recursion: unknown, or a set of origins."""
    if (module, name) in on:
        return set()
    if module not in modules:
        return {"unknown"}
    on = on | {(module, name)}
    mine = sorted((r for r in given if r[:2] == (module, name)), key=lambda r: r[2])
    if mine:
        _, _, _, target, imported, binding = mine[0]
        if target is None:
            return {(module, binding)}
        return {(target, exports.NAMESPACE)} if imported is None else plain(given, stars, modules, target, imported, on)
    if name == "default":
        return set()
    out = set()
    for m, target in stars:
        if m == module:
            out |= {"unknown"} if target not in modules else plain(given, stars, modules, target, name, on)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    modules, names = [f"m{i}" for i in range(9)], ["a", "b", "c", "default"]
    given = []
    for k in range(16):
        target, imported = rng.choice([(None, None), (rng.choice([*modules, "out"]), rng.choice(names)), (rng.choice(modules), None)])
        given.append((rng.choice(modules), rng.choice(names), k, target, imported, rng.choice(names)))
    stars = [(rng.choice(modules), rng.choice([*modules, *modules, None, "out"] if k == 0 else modules)) for k in range(rng.randrange(2, 14))]
    wanted = [(m, n) for m in [*modules, "out"] for n in names]
    make = spark.createDataFrame
    got = exports.resolve_exports(make(given, "module string, name string, place int, target string, imported string, binding string"), make(stars, "module string, target string"), make(wanted, "module string, name string"), make([(m,) for m in modules], "module string"))
    for r in got.collect():
        found = plain(given, stars, modules, r.module, r.name, frozenset())
        state = "unknown" if "unknown" in found else "ambiguous" if len(found) > 1 else "found" if found else "not_found"
        assert (r.state, (r.origin_module, r.origin_binding)) == (state, next(iter(found)) if state == "found" else (None, None)), r


def shuffled(spark):
    """Rows that this session's stages have written to shuffles so far."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}


def test_a_long_chain_shuffles_the_exports_once(spark):
    many, depth = 4000, 8
    given = spark.range(many).selectExpr("'m0' AS module", "'n' || id AS name", "1 AS place", "string(null) AS target", "string(null) AS imported", "'b' AS binding")
    chain = spark.createDataFrame([(f"m{i}", f"m{i - 1}") for i in range(1, depth)], "module string, target string")
    wanted, modules = spark.createDataFrame([(f"m{depth - 1}", "n7")], "module string, name string"), spark.createDataFrame([(f"m{i}",) for i in range(depth)], "module string")
    before = shuffled(spark)
    assert [tuple(r) for r in exports.resolve_exports(given, chain, wanted, modules).collect()] == [("m7", "n7", "found", "m0", "b")]
    assert sum(n for s, n in shuffled(spark).items() if s not in before) < 2 * many


def test_export_resolution_shuffles_less_than_its_lines(spark):
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    before = shuffled(spark)
    assert QUERIES["export_resolution"](spark, "/root/testdata/sf0.001").count() == 1228
    assert sum(n for s, n in shuffled(spark).items() if s not in before) < lines


def test_nothing_wanted(spark):
    make = spark.createDataFrame
    empty = make([], "module string, name string, place int, target string, imported string, binding string")
    assert exports.resolve_exports(empty, make([], "module string, target string"), empty, make([], "module string")).count() == 0


def test_specifiers_mean_a_path_first(spark):
    files = spark.createDataFrame([("src/a.js",), ("src/lib/b.js",), ("b.js",), ("c",), ("src/d.jsx",), ("react",), ("src/e",), ("up.js",)], "file string")
    cases = [  # importing file, specifier, found, found by the narrow search
        ("src/x.js", "./a", "src/a.js", "src/a.js"), ("src/x.js", "./a.js", "src/a.js", "src/a.js"), ("src/lib/x.js", "./b", "src/lib/b.js", "src/lib/b.js"), ("src/x.js", "./b", "b.js", None),
        ("src/x.js", "./c.js", "c", None), ("src/x.js", "./d", "src/d.jsx", None), ("src/x.js", "react", "react", None), ("src/x.js", "./e.js", "src/e", None), ("src/x.js", "../up", "up.js", "up.js"),
        ("x.js", "../up", None, None), ("src\\lib\\x.js", "../a", "src/a.js", "src/a.js"), ("src/x.js", "nothing", None, None), ("src/x.js", "././a", "src/a.js", "src/a.js"),
    ]
    specs = spark.createDataFrame([c[:2] for c in cases], "module string, spec string")
    for narrow in (False, True):
        got = {(r.module, r.spec): r.resolved for r in keys.lookup_by_variants(specs, files, "spec", "file", base="module", narrow=narrow).collect()}
        assert got == {c[:2]: c[3] if narrow else c[2] for c in cases}
