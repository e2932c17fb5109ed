"""Slices bound the text in memory, and heavy shingles are never missed."""

import random

import numpy as np
import pyarrow as pa

from tidewrack.llm.ngram_join import Heavy
from tidewrack.llm.tables import slices


def test_slices_cover_a_batch_in_order():
    texts = ["a" * n for n in (0, 5, 3000, 1, 1, 900, 900, 900)] + [None, "ä" * 500]
    batch = pa.RecordBatch.from_pydict({"k": list(range(len(texts))), "text": texts})
    parts = list(slices(batch, 1000))
    assert [k for p in parts for k in p.column("k").to_pylist()] == batch.column("k").to_pylist()
    sizes = [sum(len((t or "").encode()) for t in p.column("text").to_pylist()) for p in parts]
    assert all(s <= 1000 or p.num_rows == 1 for s, p in zip(sizes, parts)) and len(parts) < len(texts)
    assert list(slices(batch.slice(0, 0))) == []


def test_heavy_shingles_are_counted():
    rng = random.Random(1)
    share, heavy, seen = 0.02, Heavy(0.02), {}
    for _ in range(60):
        sets = [np.unique(np.array([rng.randrange(5) if rng.random() < 0.1 else rng.randrange(1000, 90_000) for _ in range(20)], dtype=np.uint64)) for _ in range(40)]
        for s in sets:
            for x in s.tolist():
                seen[x] = seen.get(x, 0) + 1
        heavy.add(sets)
    found = dict(zip(heavy.keys.tolist(), heavy.low.tolist()))
    assert {x for x, n in seen.items() if n > share * heavy.docs} <= found.keys()
    assert all(seen[x] - share * heavy.docs <= n <= seen[x] for x, n in found.items()) and len(found) < 3000
