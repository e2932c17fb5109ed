"""The n-gram join against all pairs, on families of near copies and on odd rows."""

import random

from tidewrack.llm import ngram_join

SCHEMA = "doc_id long, text string, lang string, component string"


def brute(rows):
    """component of every doc_id by comparing all pairs."""
    sets = []
    for _, text, *_ in rows:
        words = [w for w in (text or "").encode().lower().split()]
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 75 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, *_) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted(((r[0], len(s), least.get(find(i))) for i, (r, s) in enumerate(zip(rows, sets))), key=repr)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        kind = rng.random()
        if kind < 0.5:
            words[at] = f"new{rng.randrange(10**6)}"
        elif kind < 0.75:
            del words[at]
        else:
            words.insert(at, f"ins{rng.randrange(10**6)}")
    return words


def family(rng, name, copies, length):
    base = [f"{name}{rng.randrange(400)}" for _ in range(length)]
    variant = edited(rng, base, length // 14)
    out = [base, variant]
    for _ in range(copies):
        source = rng.choice([base, base, variant])
        words = edited(rng, source, rng.randrange(0, length // 12))
        if rng.random() < 0.2:
            words = words[: len(words) - rng.randrange(len(words) // 4)]
        out.append(words)
    return out


def corpus(seed):
    """Families of near copies, texts that are mostly one passage, and copies of a family that have a passage of their own in common."""
    rng = random.Random(seed)
    passage = [f"p{rng.randrange(50)}" for _ in range(30)]
    texts = []
    for k in range(4):
        texts += family(rng, f"f{k}x", 25, rng.randrange(40, 160))
    base = [f"b{rng.randrange(400)}" for _ in range(90)]
    for group in range(3):  # far from the base, near one another
        own = [f"g{group}_{i}" for i in range(rng.randrange(18, 34))]
        texts += [base] + [edited(rng, base + own, rng.randrange(0, 4)) for _ in range(15)]
    for k in range(30):
        texts.append(passage + [f"own{k}_{i}" for i in range(rng.randrange(1, 14))])
    texts += [passage, passage[:-1], ["one"], ["one"], ["one", "two"]]
    return [" ".join(f"s{seed}{w}" for w in t) for t in texts]


def test_twenty_corpora_against_all_pairs(spark):
    rows, want = [], []
    for seed in range(20):
        mine = [(seed * 10_000 + i * 7 % 1009, t, "en", "x") for i, t in enumerate(corpus(seed))]
        want += brute(mine)
        rows += mine
    random.Random(0).shuffle(rows)
    got = ngram_join.similar_groups(spark.createDataFrame(rows, SCHEMA).repartition(4), part_shingles=20_000)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_odd_rows(spark):
    long_text = " ".join(f"w{i}" for i in range(50_000))
    rows = [
        (1, None, None, None), (2, "", "en", None), (3, " \t\n\x0b", "en", "s"), (4, "A b c D", "en", "s"), (5, "a B C d", None, "s"),
        (5, "a b c d", "en", "s"), (None, "a b c d", "en", "s"), (6, long_text, "en", "s"), (7, long_text + " end", "en", "s"), (8, " ", "en", "s"),
    ]
    got = sorted(map(tuple, ngram_join.similar_groups(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    assert got == brute(rows)
    empty = ngram_join.similar_groups(spark.createDataFrame([], SCHEMA))
    assert empty.columns == ["doc_id", "n_shingles", "component_id"] and empty.count() == 0


def test_prefix_choice_keeps_the_bound():
    import numpy as np

    for n, dfs in ((10, [2] * 9), (100, [2] * 60 + [5000] * 40), (7, [])):
        matches, held = ngram_join.choose_prefix(n, np.array(dfs))
        assert 1 <= matches <= ngram_join.MOST_MATCHES
        assert held == max(0, min(len(dfs), n - -(-3 * n // 4) + matches - (n - len(dfs))))
