"""Suffixes that skip taken names, against one pass over the rows in order."""

import random

import __spark_entry__ as entry

from tidewrack.operators import keys


def brute(names, extension="", seen=()):
    seen, out = {s.lower() for s in seen}, []
    for n in names:
        k = 1
        dot = n.rfind(".")
        dot = dot if dot > n.rfind("/") + 1 and dot < len(n) - 1 else len(n)
        while (c := n if k == 1 else f"{n[:dot]}_{k}{n[dot:] or extension}").lower() in seen:
            k += 1
        seen.add(c.lower())
        out.append(c)
    return out


def check(spark, names, extension="", reserved=None):
    df = spark.createDataFrame(list(enumerate(names)), "k int, n string")
    seeds = None if reserved is None else spark.createDataFrame([(r,) for r in reserved], "path string")
    got = sorted(tuple(r) for r in keys.unique_suffixes(df, "n", ["k"], extension=extension, reserved=seeds).select("k", "unique_name").collect())
    assert [x for _, x in got] == brute(names, extension, reserved or ())


def test_taken_names_are_skipped(spark):
    check(spark, ["a", "A", "a_2", "b_2", "b", "B", "b", "c_2", "c_2_2", "c_2", "d", "d", "e_1", "e_3", "x_02", "x", "X"])


def test_suffixes_go_before_extensions(spark):
    check(spark, ["a.js", "A.js", "a_2.js", "a.js", "a", "a", "d.x/a", "d.x/a", "d/.js", "d/.js", "a.", "a.", ".js", ".js", "a.b.js", "a.b.js", "a.b_2.js"])
    rng = random.Random(3)
    check(spark, [rng.choice(["a", "b/a"]) + rng.choice(["", "_2", "_3"]) + rng.choice(["", ".js", ".JS", ".x.js", "_2.js"]) for _ in range(200)])


def test_random_names(spark):
    rng = random.Random(2)
    check(spark, [rng.choice("abAB") + rng.choice(["", "", "_2", "_3", "_2_2", "_x", "_2\n"]) for _ in range(300)])


def test_query_skips_taken_names(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "A"), (3, "a_2"), (4, None)], "p_partkey int, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    got = sorted(tuple(r) for r in entry.queries()["dedup_suffix"](spark, str(tmp_path)).collect())
    assert got == [(1, "a"), (2, "A_2"), (3, "a_2_2"), (4, None)]


def test_reserved_names_and_a_default_extension(spark):
    check(spark, ["Index", "Index", "index.js", "index_2.js", "a", "b"], ".js")
    check(spark, ["lib/a.js", "lib/A.js", "lib/b", "c", "c", "alone"], ".js", ["lib/a.js", "LIB/B", "c_2.js", "unused.js", "lib/a.js"])
    check(spark, ["x", "y"], ".js", [])
    rng = random.Random(6)
    some = [rng.choice(["a", "b/a"]) + rng.choice(["", "_2", "_3"]) + rng.choice(["", ".js", ".JS"]) for _ in range(120)]
    check(spark, some, ".js", some[:9])
