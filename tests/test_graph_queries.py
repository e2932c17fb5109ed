"""The graph queries over every order, against brute force on the smallest tables."""

import __spark_entry__ as entry
import pytest

SF = "/root/testdata/sf0.001"


def reach(edges, seeds):
    out, todo, after = set(seeds), list(seeds), {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
    while todo:
        for b in after.get(todo.pop(), []):
            if b not in out:
                out.add(b)
                todo.append(b)
    return out


@pytest.fixture(scope="module")
def tables(spark):
    customers = spark.read.parquet(f"{SF}/customer.parquet").collect()
    orders = spark.read.parquet(f"{SF}/orders.parquet").select("o_custkey", "o_orderkey").collect()
    return customers, {(r.o_custkey, r.o_orderkey * 7919 % len(customers) + 1) for r in orders}


def run(spark, name):
    return sorted(tuple(r) for r in entry.queries()[name](spark, SF).collect())


def test_components_of_all_orders(spark, tables):
    _, edges = tables
    both = {(a, b) for x, y in edges if x != y for a, b in ((x, y), (y, x))}
    assert run(spark, "reference_components_all") == sorted((a, min(reach(both, [a]))) for a in {a for a, _ in both})


def test_cycles_of_all_orders(spark, tables):
    _, edges = tables
    nodes = {x for e in edges for x in e}
    ahead = {a: reach(edges, {b for x, b in edges if x == a}) for a in nodes}
    mates = {a: [b for b in ahead[a] if a in ahead[b]] for a in nodes}
    assert run(spark, "scc_cycles_all") == sorted((a, min(m), len(m)) for a, m in mates.items() if m)


def test_what_all_orders_reach(spark, tables):
    customers, edges = tables
    assert run(spark, "alive_declarations_all") == sorted((x,) for x in reach(edges, [c.c_custkey for c in customers if c.c_acctbal > 9500]))
    known = {c.c_custkey for c in customers}
    bad = {c.c_custkey for c in customers if c.c_acctbal >= 9000} | {a for a, b in edges if b not in known}
    assert run(spark, "transitive_purity_all") == sorted((x,) for x in known - reach({(b, a) for a, b in edges}, bad))
    going = {c.c_custkey for c in customers if c.c_acctbal > 0 and c.c_mktsegment != "BUILDING" and c.c_acctbal < 9000}
    assert run(spark, "drop_cascade_all") == sorted((x,) for x in going - reach(edges, known - going))
