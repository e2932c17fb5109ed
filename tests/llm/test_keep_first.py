"""Which row of each component stays: null ids, repeated ids with different texts, groups of null ids only."""

import random

from tidewrack.llm import ngram_join

SCHEMA = "doc_id long, text string, lang string"


def text(name, changed=0):
    return " ".join(f"{name}{i}" for i in range(40 - changed)) + f" end{changed}" * changed


def kept(spark, rows):
    return sorted(((r.doc_id, r.text) for r in ngram_join.keep_first(spark.createDataFrame([(*r, "en") for r in rows], SCHEMA)).collect()), key=repr)


def test_rows_and_not_ids_decide(spark):
    a, b, c, d, e, f = map(text, ("a", "b", "c", "d", "e", "f"))
    rows = [
        (1, a), (None, text("a", 1)),  # a linked null id takes no other null id along
        (None, f), (None, ""), (None, None),
        (3, b), (5, text("b", 1)), (5, c), (9, text("c", 1)),  # 5 loses with one text and leads with the other
        (None, d), (None, text("d", 1)), (None, text("d", 2)),  # one of a group of null ids stays
        (7, e), (7, e), (7, e.upper()),  # equal ids and sets: one stays
    ]
    got = kept(spark, rows)
    assert [x for x in got if x[0] is not None and x[0] != 7] == [(1, a), (3, b), (5, c)]
    nulls = [t for i, t in got if i is None]
    assert f in nulls and "" in nulls and None in nulls and text("a", 1) not in nulls
    assert len([t for t in nulls if t and t.startswith("d0 ")]) == 1 and len(nulls) == 4
    assert [t.lower() for i, t in got if i == 7] == [e]


def linked(s, t):
    s, t = ({tuple(x.split()[i : i + 5]) for i in range(len(x.split()) - 4)} for x in (s, t))
    return 4 * len(s & t) >= 3 * len(s | t)


def linked_texts(s, t):
    """As ``linked``, with fewer than five words as one shingle."""
    s, t = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (s.lower().split(), t.lower().split()))
    return 4 * len(s & t) >= 3 * len(s | t)


def test_one_of_every_component(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(12)]), text(f"n{rng.randrange(14)}x", rng.randrange(5))) for _ in range(90)]
    groups = []
    for row in dict.fromkeys(rows):
        near = [g for g in groups if any(linked(row[1], x[1]) for x in g)]
        groups = [g for g in groups if g not in near] + [sum(near, [row])]
    got = kept(spark, rows)
    assert len(got) == len(set(got)) == len(groups)
    for g in groups:
        ids = [i for i, _ in g if i is not None]
        (one,) = [x for x in got if x in g]
        assert one[0] == (min(ids) if ids else None)
