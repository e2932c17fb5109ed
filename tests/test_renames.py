"""Source-map texts and renames, and namespace imports, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from tidewrack.functions import names
from tidewrack.operators import namespaces, ranges, renames
from tidewrack.sources import mappings

TOKENS = "module string, line int, column long, source long, source_line long, source_column long, name long"


def segments(rng, module, lines):
    out = []
    for line in sorted(rng.sample(range(lines), rng.randrange(1, lines))):
        for column in sorted(rng.sample(range(5000), rng.randrange(1, 6))):
            fields = [rng.randrange(1 << rng.choice([2, 10, 30])) for _ in range(4)]
            size = rng.choice([0, 3, 4])
            out.append((module, line, column, *fields[:size], *[None] * (4 - size)))
    return out


@pytest.mark.parametrize("lines", [1, 3, 1000])
def test_maps_read_as_they_were_written(spark, lines):
    rng = random.Random(lines)
    rows = [r for m in "abc" for r in segments(rng, m, 40)]
    text = mappings.encode_mappings(spark.createDataFrame(rng.sample(rows, len(rows)), TOKENS), "module", lines)
    got = mappings.mapping_rows(text, "module", lines=lines)
    assert sorted(map(repr, map(tuple, got.select(TOKENS.replace(" string", "").replace(" int", "").replace(" long", "").split(", ")).collect()))) == sorted(map(repr, rows))


def test_a_known_text(spark):
    rows = [("m", 0, 0, 0, 0, 0, None), ("m", 0, 4, 0, 0, 6, 0), ("m", 2, 2, 1, 5, 0, None), ("m", 2, 3, None, None, None, None), ("m", 3, 1, 0, 20, 3, 1)]
    (got,) = mappings.encode_mappings(spark.createDataFrame(rows, TOKENS), "module").collect()
    assert got.mappings == "AAAA,IAAMA;;ECKN,C;CDeGC"
    assert mappings.encode_mappings(spark.createDataFrame([], TOKENS), "module").count() == 0


def test_numbers_and_sums_do_not_depend_on_buckets(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.randrange(300), k, rng.choice([None, rng.randrange(-9, 9)])) for k in range(80)]
    df = spark.createDataFrame(rows, "key string, at long, id long, v long")
    for width in (7, 1000):
        got = {r.id: (r.k, r.v_before, r.total) for r in ranges.with_running_sums(ranges.with_last_before(ranges.numbered(df, ["key"], ["at", "id"], width, "k"), "key", ["at", "id"], width, ["v"]).withColumn("total", F.col("v")), "key", ["at", "id"], width, ["total"]).collect()}
        for key in "ab":
            mine = sorted(r[1:] for r in rows if r[0] == key)
            last, total = None, 0
            for k, (_, i, v) in enumerate(mine, 1):
                total += v or 0
                assert got[i] == (k, last, total)
                last = last if v is None else v


def test_renames(spark):
    make = spark.createDataFrame
    tokens = make([
        ("m", 0, 0, 0, 0, 0, 0), ("m", 0, 10, 0, 0, 4, None), ("m", 0, 20, 0, 1, 0, 1), ("m", 0, 30, None, None, None, None), ("m", 1, 5, 0, 1, 6, None), ("m", 2, 0, 0, 0, 99, None),
    ], TOKENS)
    names_of = make([("m", 0, "alpha"), ("m", 1, "")], "module string, number long, text string")
    lines = make([("m", 0, 0, "let beta = 1"), ("m", 0, 1, "gamma 2x class")], "module string, source long, source_line long, text string")
    mentions = [  # binding, line, column
        (1, 0, 0), (1, 0, 3), (1, 0, 12), (2, 0, 10), (2, 0, 25), (3, 0, 2), (4, 0, 5), (5, 0, 14), (6, 0, 31), (7, 1, 0), (8, 1, 7), (9, 2, 1), (10, 0, 9), (11, 0, 8), (12, 0, 1), (12, 0, 13),
    ]
    bindings = [  # binding, symbol, top, declared
        (1, "a", True, 5), (2, "b", True, 6), (3, "c", True, 2), (4, "d", False, 1), (5, "beta", True, 9), (6, "f", True, 3), (7, "g", True, 4), (8, "h", True, 7), (9, "i", True, 8), (10, "alpha_3", True, 40), (11, "k", True, 10), (12, "alpha", True, 12),
    ]
    got = renames.source_map_renames(
        make([("m", *x) for x in mentions] + [("other", 1, 0, 0)], "module string, binding int, line int, column int"), make([("m", *b) for b in bindings] + [("other", 1, "z", True, 1)], "module string, binding int, symbol string, top boolean, declared long"), tokens, names_of, lines, width=4
    )
    # 1: alpha twice, beta once. 2: beta and gamma once each. 5 has its name. 6 and 7 meet a token without a source. 8: "2x" is no name. 9: beyond the line.
    # 12: alpha is its own name, so beta stands.
    want = {3: ("c", "alpha"), 1: ("a", "alpha_2"), 11: ("k", "alpha_3"), 10: ("alpha_3", "alpha_4"), 4: ("d", "alpha"), 2: ("b", "beta"), 12: ("alpha", "beta_2")}
    assert {r.binding: (r.old, r.new) for r in got.collect()} == want


def test_names_that_are_made(spark):
    cases = [("a", "a"), ("1a", "_1a"), ("class", "_class"), ("cl-ass", "_class"), ("a b", "ab"), ("", "_"), ("é́t", "é́t"), ("-.", "_"), ("eval", "_eval"), ("́x", "_́x"), ("x\n", "x"), (None, None)]
    got = spark.createDataFrame([(a,) for a, _ in cases], "t string").select(names.to_identifier(F.col("t")).alias("n"), names.is_identifier(F.col("t")).alias("ok")).collect()
    assert [r.n for r in got] == [b for _, b in cases]
    assert [r.ok for r in got] == [a is not None and a == b for a, b in cases]


RESERVED = {*names.RESERVED, *names.STRICT_BINDINGS}


def plain(module):
    """One module, import by import and property by property."""
    held, out = set(module["bindings"]), []
    for number, (local, exported, uses, reused) in sorted(module["imports"].items()):
        if None in uses or not uses or not set(uses) <= exported:
            continue
        props, inserted, fresh = [], set(), 0
        for p in sorted(set(uses)):
            if p in reused:
                props.append((p, reused[p], False))
                continue
            fresh += 1
            name = p
            if p != local and (p in held or p in RESERVED):
                k = 1
                while f"{p}_{k}" in held:
                    k += 1
                name = f"{p}_{k}"
            if name not in held:
                held.add(name)
                inserted.add(name)
            props.append((p, name, name != p))
        keeps = fresh > 1 and 2 * sum(a for *_, a in props) > fresh
        if keeps:
            gone = [x for x in props if x[2] or x[1] == local]
            held -= {x[1] for x in gone} & inserted
            props = [x for x in props if x not in gone]
        out += [(number, *x, keeps) for x in props]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_namespaces(spark, seed):
    rng = random.Random(seed)
    words = ["a", "b", "c", "a_1", "b_1", "a_1_1", "delete", "ns"]
    modules = {}
    for m in range(60):
        imports = {}
        for i in range(rng.randrange(1, 4)):
            exported = set(rng.sample(words, rng.randrange(5, 9)))
            uses = [rng.choice([*exported] * 6 + [*words, None]) for _ in range(rng.randrange(5))]
            imports[i] = (rng.choice(["ns", f"n{i}", "a"]), exported, uses, {w: f"own_{w}" for w in rng.sample(words, rng.choice([0, 0, 1]))})
        modules[m] = {"imports": imports, "bindings": {*rng.sample([*words, "a_2", "x"], rng.randrange(5)), *(x[0] for x in imports.values())}}
    make, each = spark.createDataFrame, [(m, i, x) for m, d in modules.items() for i, x in d["imports"].items()]
    got = namespaces.decompositions(
        make([(m, i, x[0], f"{m}/{i}") for m, i, x in each], "module int, import_id int, local string, provider string"), make([(m, i, u) for m, i, x in each for u in x[2]], "module int, import_id int, prop string"),
        make([(f"{m}/{i}", n) for m, i, x in each for n in x[1]], "provider string, name string"), make([(m, i, n, w) for m, i, x in each for n, w in x[3].items()], "module int, import_id int, name string, local string"),
        make([(m, b) for m, d in modules.items() for b in d["bindings"]], "module int, name string"),
    )
    want = sorted((m, *x) for m, d in modules.items() for x in plain(d))
    assert sorted(map(tuple, got.collect())) == want and any(x[-1] for x in want) and any(x[4] for x in want)
