"""Both vector searches against brute force."""

import numpy as np

from tidewrack.llm import ann, topk

SCHEMA = "vec_id long, embedding array<float>, score int, v string"


def rows_of(rng, n, dim=16):
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[::7] = x[0]  # a hot vector
    rows = [(i, v.tolist(), 1, "x") for i, v in enumerate(x)]
    odd = [None, [], [None] * dim, [float("nan")] * dim, [float("inf")] * dim, [0.0] * dim]
    return rows + [(n + i, v, 1, "x") for i, v in enumerate(odd)] + [rows[3], (None, rows[4][1], 1, "x")]


def test_exact_topk(spark):
    rng = np.random.default_rng(1)
    rows = rows_of(rng, 400)
    got = topk.search(spark.createDataFrame(rows, SCHEMA), k=5, query_step=50, candidate_block=64, query_block=3).collect()
    part = {r[0]: np.floor(256 * np.asarray(r[1], dtype=np.float64)).astype(np.int64) for r in rows if r[0] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all()}
    want = []
    for q in (i for i in part if i % 50 == 0):
        scores = sorted((-int(part[q] @ v), i) for i, v in part.items() if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk.search(spark.createDataFrame([], SCHEMA)).count() == 0
    few = topk.search(spark.createDataFrame(rows[:3], SCHEMA)).collect()
    assert [(r.query_id, r["rank"]) for r in few] == [(0, 1), (0, 2)]


def test_multiprobe_recall_and_scores(spark):
    rng = np.random.default_rng(2)
    rows = rows_of(rng, 600)
    got = ann.search(spark.createDataFrame(rows, SCHEMA), query_step=20, cell_rows=40).collect()
    unit = {r[0]: np.asarray(r[1], dtype=np.float64) for r in rows if r[0] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and np.any(r[1])}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    found = {}
    for r in got:
        assert abs(r.score - float(unit[r.query_id] @ unit[r.vec_id])) < 1e-12 and r.vec_id != r.query_id
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    hits = total = 0
    for q in (i for i in unit if i % 20 == 0):
        want = [i for _, i in sorted((-round(float(unit[q] @ v), 12), i) for i, v in unit.items() if i != q)[:5]]
        hits += len(set(want) & {v for _, v in found[q]})
        total += 5
        assert sorted(k for k, _ in found[q]) == list(range(1, 6))
    assert hits >= 0.9 * total
    hot = [v for _, v in sorted(found[0])]
    assert hot == [7, 14, 21, 28, 35]  # ties go to the smaller ids
    assert ann.search(spark.createDataFrame([], SCHEMA)).count() == 0


def test_queries_without_enough_finds_get_all(spark):
    """One narrow table finds next to nothing, so that the second step has to fill every query."""
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist(), 1, "x") for i, v in enumerate(rng.normal(size=(120, 16)).astype(np.float32))]
    got = ann.search(spark.createDataFrame(rows, SCHEMA), query_step=20, tables=1, width=0.2, probes=1, cell_rows=30).collect()
    unit = {i: np.asarray(v, dtype=np.float64) / np.linalg.norm(np.asarray(v, dtype=np.float64)) for i, v, *_ in rows}
    for q in range(0, 120, 20):
        want = sorted(unit, key=lambda i: (-float(unit[q] @ unit[i]), i))
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == [i for i in want if i != q][:5]
    few = ann.search(spark.createDataFrame([(0, [1.0, 0.0], 1, "x"), (1, [-1.0, 0.0], 1, "x"), (1, [0.0, 2.0], 1, "x")], SCHEMA)).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in sorted(few, key=lambda r: r["rank"])] == [(0, 1, 1, 0.0)]


def test_repeated_ids_with_different_vectors(spark):
    rows = [(0, [1.0, 0.0], 1, "x"), (0, [0.0, 1.0], 1, "x"), (7, [1.0, 1.0], 1, "x"), (7, [2.0, 1.0], 1, "x"), (8, [3.0, 3.0], 1, "x")]
    got = topk.search(spark.createDataFrame(rows, SCHEMA), k=5).collect()
    assert sorted((r.query_id, r.vec_id, r.score) for r in got) == sorted([(0, 8, 768 * 256), (0, 8, 768 * 256), (0, 7, 512 * 256), (0, 7, 256 * 256), (0, 7, 256 * 256), (0, 7, 256 * 256)])


def test_probe_order_is_by_expected_distance():
    order = ann.probe_order(4, 30)
    assert order[0] == () and order[1] == (0,) and len(set(order)) == 30
    assert all(not any(7 - j in s for j in s) for s in order)


def test_default_recall_on_a_whole_table(spark):
    """The query's own parameters on all 2,000 vectors of sf0.1."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = table.collect()
    x = np.array([r.embedding for r in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.array([r.vec_id for r in rows])
    found = {}
    for r in ann.search(table).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = total = 0
    for i in np.flatnonzero(ids % 50 == 0):
        scores = x @ x[i]
        scores[i] = -2
        want = ids[np.argsort(-scores, kind="stable")[:5]]
        hits += len(found[ids[i]] & set(want.tolist()))
        total += 5
    assert hits >= 0.95 * total, hits / total
    print("recall", hits / total)
