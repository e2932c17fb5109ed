"""Periodic runs against brute force over all lags."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest

from tidewrack.llm import registry, runs

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, runs string, collapsed int, n_words string"


def brute(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > start and i - start + q >= max(6, 4 * q):
                part = w[start : i + q]
                if not any(part[p:] == part[:-p] for p in range(1, q)):
                    out.append((start, len(part), q))
            i = max(i, start + 1)
    return sorted(out)


def text(rng):
    draw = lambda k, n: [b"%d" % rng.randrange(k) for _ in range(n)]
    words = []
    for _ in range(rng.randrange(1, 6)):
        kind = rng.randrange(4)
        if kind == 0:
            words += draw(rng.choice([1, 2, 3, 50]), rng.randrange(30))
        elif kind == 3:
            words += ([b"a"] * rng.randrange(1, 40) + [b"b"]) * rng.randrange(1, 6)
        else:
            block = draw(rng.choice([1, 2, 9, 99]), rng.randrange(1, 9) if kind == 1 else rng.randrange(30, 60))
            words += (block * 8)[: rng.randrange(1, 8 * len(block))]
    return words


@pytest.mark.parametrize("seed", range(20))
def test_all_runs_are_found(seed):
    rng = random.Random(seed)
    for _ in range(15):
        words = text(rng)
        assert runs.runs_of(words) == brute(words), words


def test_segments_hold_every_run_and_only_frequent_words():
    rng = random.Random(7)
    for _ in range(100):
        words = text(rng)
        numbers = [sorted(set(words)).index(w) for w in words]
        segments = runs.split(runs.np.array(numbers, dtype=runs.np.int64))
        for start, stop in segments:
            assert all(numbers[start:stop].count(x) >= 4 for x in numbers[start:stop])
        assert all(any(a <= s and s + n <= b for a, b in segments) for s, n, _ in brute(words))


def test_long_texts_of_one_word_and_of_long_periods():
    assert runs.runs_of([b"a"] * 300_000) == [(0, 300_000, 1)]
    block = [b"%d" % random.Random(1).randrange(10**6) for _ in range(1)] + [b"%d" % (i * i % 7919) for i in range(30_000)]
    got = runs.runs_of([b"x"] + block * 5)
    assert [(s, n, p) for s, n, p in got if p == len(block)] == [(1, 5 * len(block), len(block))]
    nested = ([b"a"] * 70 + [b"b"]) * 400
    assert runs.runs_of(nested) == sorted([(0, len(nested), 71), *((71 * i, 70, 1) for i in range(400))])


def digests(doc_id, body):
    w = re.findall("[^ \t-\r]+", body or "")
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute(w)
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return len(found), *best, milli, sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))


def test_query_on_whole_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in registry.op11_runs(spark, SF).collect()}
    short = [d for d in docs if len((d[1] or "").split()) < 3000]
    assert len(got) == len(docs) and len(short) > 150
    for d, body in short:
        assert got[d] == digests(d, body), d
    assert any(v[0] for v in got.values())


def test_planted_ends(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randrange(60)}" for _ in range(rng.randrange(0, 90)))) for i in range(150)] + [(None, "a b"), (140 + 10**6, None), (7 + 10**6, " \t"), (7 + 10**6, " \t")]
    changed = registry.with_periodic_ends(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(changed) == len(rows)
    for d, body in rows[:150]:
        mine = next(r.text for r in changed if r.doc_id == d)
        w = body.split()
        h = zlib.crc32(str(d).encode())
        if h % 10 == 0 and w:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
            assert mine == " ".join(w)
        else:
            assert mine == body


def test_odd_rows(spark):
    rows = [(1, None), (None, ""), (2, " \n "), (3, "x " * 50_000), (4, "y" * 2_000_000), (3, "x " * 50_000), (5, "é\u00a0é " * 8)]
    out = runs.detect(spark.createDataFrame([(*r, "clash", 7, "n") for r in rows], SCHEMA))
    assert sorted(out.columns) == ["collapsed", "doc_id", "n_words", "runs", "strongest", "text"]
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.strongest and tuple(r.strongest), r.collapsed[:9]) for r in out.collect()), key=repr)
    want = [(1, 0, [], None, ""), (None, 0, [], None, ""), (2, 0, [], None, ""), (3, 50_000, [(0, 50_000, 1)], (0, 50_000, 1), "x"), (3, 50_000, [(0, 50_000, 1)], (0, 50_000, 1), "x"), (4, 1, [], None, "y" * 9), (5, 8, [(0, 8, 1)], (0, 8, 1), "é\u00a0é")]
    assert got == sorted(want, key=repr)
    assert runs.detect(spark.createDataFrame([], SCHEMA)).count() == 0


def test_the_strongest_run_of_equal_ones():
    words = b"a b a b a b a b x c c c c c c y d d d d d d".split()
    assert runs.runs_of(words) == [(0, 8, 2), (9, 6, 1), (16, 6, 1)]
    assert runs.collapsed(words, runs.runs_of(words)) == b"a b x c y d"
