"""Mixing and sharding: exact properties of their results."""

import zlib

import numpy as np

from tidewrack.llm import mixing, sharding

SCHEMA = "doc_id long, text string, source string, size int, shards string"


def documents(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(["word"] * int(rng.integers(1, 90))), rng.choice(["a", "a", "a", "b", "c", "ä", "Z"]), 1, "x") for i in range(600)]
    rows += [(1000, None, "a", 1, "x"), (1001, " \t", "b", 1, "x"), (1002, "two words", None, 1, "x"), (None, "no id", None, 1, "x"), rows[5], rows[5]]
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_targets_are_water_filled():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == [187.5, 75.0, 37.5]
    capped = mixing.targets([10, 1000], [5, 1])
    assert capped == [30.0, 980.0]
    assert mixing.targets([0, 0], [1, 1]) == [0.0, 0.0]
    many = mixing.targets([1, 5, 50, 500], [5, 2, 1, 5])
    assert abs(sum(many) - 556) < 1e-9 and all(t <= 3 * s + 1e-9 for t, s in zip(many, [1, 5, 50, 500]))


def level_targets(sizes, weights):
    """Targets by bisection of the level at which all sources together take what there is."""
    low, high = 0.0, 3.0 * sum(sizes) + 1
    for _ in range(200):
        level = (low + high) / 2
        if sum(min(3 * s, level * w) for s, w in zip(sizes, weights)) < sum(sizes):
            low = level
        else:
            high = level
    return [min(3 * s, high * w) for s, w in zip(sizes, weights)]


def test_targets_against_a_level():
    rng = np.random.default_rng(9)
    for _ in range(200):
        sizes = [int(x) for x in rng.choice([0, 1, 7, 60, 900, 20_000], size=rng.integers(1, 12))]
        weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
        assert np.allclose(mixing.targets(sizes, weights), level_targets(sizes, weights), atol=1e-6)


def test_split_is_exact():
    quota = np.array([1000, 7, 0, 33])
    parts = mixing.split_quotas(quota, 16, 1)
    assert (parts.sum(axis=0) == quota).all() and np.ptp(parts.sum(axis=1)) <= 4
    assert (mixing.split_quotas(quota, 16, 1) == parts).all()


def test_mix(spark):
    rows, docs = documents(spark)
    report = mixing.mix_report(docs, blocks=64).collect()
    assert len(report) == len(rows)
    order = sorted({r[2] for r in rows if r[2]}) + [None]
    words = lambda t: len((t or "").split())
    sizes = [sum(words(r[1]) for r in rows if r[2] == s) for s in order]
    want = level_targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(order))])
    source = {r[0]: r[2] for r in rows}
    taken = dict.fromkeys(order, 0)
    for r in report:
        s = source[r.doc_id]
        assert r.source_size == sizes[order.index(s)] and abs(r.target - want[order.index(s)]) < 1e-6
        assert r.taken == r.copies * r["size"] <= 3 * r["size"]
        taken[s] += r.taken
    for s, t in zip(order, want):
        assert abs(taken[s] - t) <= 5
    again = mixing.mix_report(docs.repartition(7), blocks=64).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, report))
    mixed = mixing.mix(docs, blocks=64).collect()
    assert sum(words(r.text) for r in mixed) == sum(taken.values())
    assert mixing.mix_report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shards(spark):
    rows, docs = documents(spark)
    out = sharding.shard_documents(docs, shards=5).collect()
    assert len(out) == len(rows)
    places, weight, moved = {}, {}, {}
    for r in out:
        places.setdefault(r.shard, []).append(r.slot)
        weight[r.shard] = weight.get(r.shard, 0) + r["size"]
        assert r.grown_shard is None and r.law == "bytes" and (r.next_shard == r.shard or r.next_shard == 5)
        moved[r.next_shard] = moved.get(r.next_shard, 0) + r["size"]
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert max(weight.values()) - min(weight.values()) < 500 and len(moved) == 6
    by_id = {r.doc_id: r for r in out}
    for doc_id, text, *_ in rows:
        assert by_id[doc_id]["size"] == len((text or "").encode()) + 1 and by_id[doc_id].text_crc32 == zlib.crc32((text or "").encode())
    assert sharding.shard_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shards_against_a_plain_placing(spark):
    rows, docs = documents(spark)
    out = sharding.shard_documents(docs, shards=5, slots=64).collect()
    weight, shard_of = {}, {}
    for r in out:
        weight[r.vslot] = weight.get(r.vslot, 0) + r["size"]
        assert shard_of.setdefault(r.vslot, r.shard) == r.shard and 0 <= r.vslot < 64
    assert len({r.vslot for r in out if r.doc_id == rows[5][0]}) == 1  # repeated rows stay together
    load = [0] * 5  # the heaviest slot goes to the lightest shard
    for slot in sorted(weight, key=lambda s: (-weight[s], s)):
        load[load.index(min(load))] += weight[slot]
    got = [sum(w for s, w in weight.items() if shard_of[s] == k) for k in range(5)]
    assert sorted(got) == sorted(load) and sum(got) == sum(len((t or "").encode()) + 1 for _, t, *_ in rows)
    for k in range(5):
        mine = sorted((r for r in out if r.shard == k), key=lambda r: (r.vslot, r.doc_id is not None, r.doc_id or 0, r.text_crc32, r["size"]))
        assert sorted((r.vslot, r.doc_id or 0, r.slot) for r in mine) == sorted((r.vslot, r.doc_id or 0, i) for i, r in enumerate(mine))


def test_maps_are_versions(spark, tmp_path):
    first = sharding.new_map({k: 10 + k for k in range(64)}, 4, 64)
    grown = sharding.add_shard(first, {k: 10 + k for k in range(64)})
    for m in (first, grown):
        sharding.save_map(spark, m, str(tmp_path / "map"))
    assert sharding.load_map(spark, str(tmp_path / "map"), 1) == first
    assert sharding.load_map(spark, str(tmp_path / "map"), 2) == grown
    assert all(b in (a, 4) for a, b in zip(first.shard_of, grown.shard_of)) and 4 in grown.shard_of


def test_nearest_subset():
    rng = np.random.default_rng(1)
    for _ in range(50):
        sizes, want = rng.integers(0, 60, size=9), float(rng.integers(0, 300)) + 0.3
        sums = [sum(int(s) for k, s in enumerate(sizes) if m >> k & 1) for m in range(1 << 9)]
        assert abs(sizes[mixing.nearest_subset(sizes, want)].sum() - want) == min(abs(x - want) for x in sums)
    assert not mixing.nearest_subset(np.array([], dtype=int), 3.0).any()
    sizes = np.array([9_000_000, 5_000_001, 17])
    assert list(mixing.nearest_subset(sizes, 5e6)) == [False, True, False]


def test_large_blocks_are_bounded_by_ranges(spark):
    rows = [(k, "w " * (1 + k * 7 % 41), "a" if k % 3 else "b", 1, "x") for k in range(6000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    report = mixing.mix_report(docs, blocks=2).collect()
    for s in "ab":
        mine = [r for r in report if rows[r.doc_id][2] == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 2 and all(r.taken <= 3 * r["size"] for r in mine)
    assert sum(r.copies for r in report if rows[r.doc_id][2] == "a") > 4000
