"""The chain against enumeration of all labellings, and accuracy on held-out documents."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from tidewrack.llm import toxicity

SCHEMA = "doc_id long, text string, spans string, most string"


def test_marginals_by_enumeration():
    rng = np.random.default_rng(1)
    lengths, moves = np.array([1, 4, 6]), (-0.7, 0.4, 1.1)
    odds = np.exp(rng.normal(size=int(lengths.sum())))
    forward, backward = toxicity.chain(odds, lengths, moves)
    p = forward * backward / (1 + forward * backward)
    at = 0
    for n in lengths:
        weights = np.zeros(n)
        total = 0.0
        for labels in itertools.product((0, 1), repeat=int(n)):
            score = sum(np.log(odds[at + i]) for i in range(n) if labels[i])
            score += sum({(0, 0): 0.0, (0, 1): moves[0], (1, 0): moves[1], (1, 1): moves[2]}[pair] for pair in itertools.pairwise(labels))
            weights += np.exp(score) * np.array(labels)
            total += np.exp(score)
        assert np.allclose(p[at : at + n], weights / total)
        at += n


def corpus():
    rng = random.Random(2)
    rows, labels = [], []
    for d in range(900):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(5, 60))]
        toxic = d % 3 == 0
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["zorgling", "plomf", "krang" + rng.choice("abcdefgh")]))
        rows.append((d, " ".join(words), "x", "y"))
        labels.append((d, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_spans(spark):
    rows, labels = corpus()
    odd = [(5000, None, "x", "y"), (5001, "", "x", "y"), (5002, " \n", "x", "y"), (None, "a plomf here", "x", "y"), (5003, "ok " * 30_000 + "krangzz", "x", "y"), (5004, "\u0130\u0130\u0130\u0130 plomf", "x", "y"), rows[0]]
    docs = spark.createDataFrame(rows + odd, SCHEMA)
    table = spark.createDataFrame([*labels, (None, 1), (3, None), labels[0]], "doc_id long, toxic int")
    model = toxicity.fit(docs, table)
    found = toxicity.score(docs, model).withColumn("held", toxicity.in_test_fold(F.col("doc_id"))).collect()
    got = {r.doc_id: r for r in found}
    assert len(found) == len(rows) + len(odd) and len({(r.toxicity, str(r.spans)) for r in found if r.doc_id == rows[0][0]}) == 1
    held = [(got[d].toxicity >= toxicity.THRESHOLD) == bool(t) for d, t in labels if got[d].held]
    assert len(held) > 200 and sum(held) >= 0.98 * len(held)
    for d in (5000, 5001, 5002):
        assert got[d].toxicity < 0.5 and not got[d].spans
    assert [(s.start, s.end) for s in got[None].spans] == [(2, 7)]
    assert got[5003].spans[-1].end == 90_007
    assert [(s.start, s.end) for s in got[5004].spans] == [(5, 10)]  # the lower case of the first letters is longer
    assert all(0 <= r.toxicity <= 1 for r in got.values())


def test_normaliser_by_enumeration():
    rng = np.random.default_rng(3)
    lengths, moves = np.array([1, 3, 5]), (-0.4, 0.2, 0.9)
    odds = np.exp(rng.normal(size=int(lengths.sum())))
    forward, _ = toxicity.chain(odds, lengths, moves)
    at, want = 0, []
    for n in lengths:
        total = 0.0
        for labels in itertools.product((0, 1), repeat=int(n)):
            score = sum(np.log(odds[at + i]) for i in range(n) if labels[i])
            total += np.exp(score + sum({(0, 0): 0.0, (0, 1): moves[0], (1, 0): moves[1], (1, 1): moves[2]}[pair] for pair in itertools.pairwise(labels)))
        want.append(np.log(total))
        at += n
    assert np.allclose(toxicity.log_normaliser(forward, lengths, moves), want)


def test_context_decides_where_words_do_not(spark):
    """A word that clean documents have once and toxic ones several times is a span in the latter only."""
    rng = random.Random(4)
    rows, labels = [], []
    for d in range(900):
        words = [f"w{rng.randrange(3000)}" for _ in range(60)]
        toxic = d % 3 == 0
        for _ in range(rng.randrange(4, 7) if toxic else d % 3 == 1):
            words.insert(rng.randrange(len(words)), "grumbal" + rng.choice("abc"))
        rows.append((d, " ".join(words), "x", "y"))
        labels.append((d, int(toxic)))
    docs = spark.createDataFrame(rows, SCHEMA)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = [r for r in toxicity.score(docs, model).withColumn("held", toxicity.in_test_fold(F.col("doc_id"))).collect() if r.held]
    assert sum((r.toxicity >= toxicity.THRESHOLD) == (r.doc_id % 3 == 0) for r in got) >= 0.97 * len(got)
    listed = sum("grumbal" in r.text for r in got if r.doc_id % 3)
    assert listed > 80 and sum(bool(r.spans) for r in got if r.doc_id % 3) < 0.2 * listed
    assert sum(bool(r.spans) for r in got if r.doc_id % 3 == 0) > 0.9 * sum(r.doc_id % 3 == 0 for r in got)


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "some text", "x", "y")], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.fit(docs, none)).collect()
    assert [(r.toxicity, r.spans) for r in out] == [(0.0, [])]
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), none)).count() == 0


def test_portions_follow_characters():
    for lengths in ([], [5], [900, 0, 0, 50, 60], [40] * 30, [0, 0], [3, 900]):
        parts = list(toxicity._portions(lengths, 100))
        assert [n for p in parts for n in lengths[p]] == lengths
        assert all(sum(lengths[p]) <= 100 or p.stop - p.start == 1 or not any(lengths[p][:-1]) for p in parts)
