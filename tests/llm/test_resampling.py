"""Weights, scores and draws against a plain version."""

import hashlib
import math
import re
import zlib
from collections import Counter

from tidewrack.llm import registry, resampling

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(docs, target, percent=5, least=20):
    ours, theirs = Counter(b for _, t in docs for b in features(t)[1]), Counter(b for t in target for b in features(t)[1])
    S, T = sum(ours.values()), sum(theirs.values())
    gain = [math.floor(1000 * math.log((theirs[b] + 1) * (S + 10000) / ((ours[b] + 1) * (T + 10000)))) for b in range(10000)]
    rows = []
    for d, text in docs:
        n, found = features(text)
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        rows.append([d, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    drawn = able[: len(able) * percent // 100]
    rank = {id(r): i for i, r in enumerate(drawn, 1)}
    return sorted(((*r[:4], rank.get(id(r))) for r in rows), key=repr)


def test_query_on_whole_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = registry.op13_resampling(spark, SF)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, target)


def odd(spark):
    many = [(i, f"Word{i % 7} " * (15 + i % 20) + "É-x_9 'quoted' 日本") for i in range(60)]
    rows = [*many, (1000, None), (None, ""), (1001, "-- !"), (None, "null id " * 30), (None, "null id " * 30), (7, many[7][1]), (1002, "tar get " * 200_000)]
    docs = spark.createDataFrame([(*r, "own", [1], 5) for r in rows], "doc_id long, text string, score string, bucket array<int>, n_words int")
    return rows, docs


def test_odd_rows(spark):
    rows, docs = odd(spark)
    target = spark.createDataFrame([("target Word3",), (None,), ("",)], "text string")
    for percent, least in ((5, 20), (50, 0), (100, 25)):
        got = resampling.report(docs, target, percent, least).select("doc_id", "n_features", "weight", "score", "rank").collect()
        assert sorted(map(tuple, got), key=repr) == brute(rows, ["target Word3", None, ""], percent, least)
    empty = docs.limit(0)
    assert resampling.report(empty, target).count() == 0 and resampling.draw(empty, target).count() == 0
    assert [r.weight for r in resampling.report(docs, target.limit(0)).where("doc_id = 1000").collect()] == [0]


def test_drawn_rows_keep_their_columns(spark):
    rows, docs = odd(spark)
    target = spark.createDataFrame([("target Word3",)], "text string")
    got = resampling.draw(docs, target, percent=40)
    want = [r for r in brute(rows, ["target Word3"], 40) if r[4]]
    assert got.columns == docs.columns
    kept = [(r.doc_id, r.score, r.bucket, r.n_words) for r in got.collect()]
    assert sorted(map(repr, kept)) == sorted(repr((r[0], "own", [1], 5)) for r in want)
