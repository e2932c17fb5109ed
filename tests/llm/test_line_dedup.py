"""Line dedup against all pairs of lines."""

import random

import pytest

from tests.llm.test_ngram_join import edited
from tidewrack.llm import line_dedup

SCHEMA = "doc_id long, text string, line string, cls string"


def brute(rows):
    lines = []
    for r, (doc_id, text, *_) in enumerate(rows):
        for k, line in enumerate(text.split("\n") if text is not None else []):
            words = line.lower().split()
            if words:
                lines.append((r, k, {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}))
    order = sorted(range(len(lines)), key=lambda i: (rows[lines[i][0]][0] is None, rows[lines[i][0]][0] or 0, lines[i][1]))
    gone = {}
    for at, i in enumerate(order):
        r, k, a = lines[i]
        if any(100 * len(a & b) >= 75 * len(a | b) for b in (lines[j][2] for j in order[:at])):
            gone.setdefault(r, []).append(k)
    return [sorted(gone.get(r, [])) for r in range(len(rows))]


def test_against_all_pairs(spark):
    rng = random.Random(5)
    base = [[f"w{rng.randrange(300)}" for _ in range(rng.randrange(3, 40))] for _ in range(60)]
    rows = []
    for d in range(80):
        lines = [" ".join(edited(rng, rng.choice(base), rng.choice([0, 0, 1, 1, 2]))) for _ in range(rng.randrange(1, 6))]
        lines.insert(rng.randrange(len(lines) + 1), rng.choice(["", "  ", "\tSame  short line", "same short line"]))
        rows.append((d, "\n".join(lines), "x", "y"))
    got = {r.doc_id: r for r in line_dedup.report(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = brute(rows)
    assert [got[r[0]].removed for r in rows] == want
    assert all(got[r[0]].n_lines == len(r[1].split("\n")) and got[r[0]].n_removed == len(w) for r, w in zip(rows, want))
    clean = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert clean == {r[0]: "\n".join(x for k, x in enumerate(r[1].split("\n")) if k not in w) for r, w in zip(rows, want)}


def test_twenty_corpora_on_few_words(spark):
    """Lines of very few words match by chance too; corpora share no word, so each is its own."""
    rows, want = [], []
    for seed in range(20):
        rng = random.Random(seed)
        vocabulary = rng.choice([6, 40, 200])
        base = [[f"{rng.randrange(vocabulary)}" for _ in range(rng.choice([3, 5, 6, 9, 20, 60]))] for _ in range(25)]
        mine = []
        for d in range(25):
            lines = [" ".join(f"s{seed}w{w}" for w in edited(rng, rng.choice(base), rng.choice([0, 1, 2]))) for _ in range(rng.randrange(1, 7))]
            mine.append((seed * 100 + d, "\n".join(lines), "x", "y"))
        want += zip((r[0] for r in mine), brute(mine))
        rows += mine
    random.Random(0).shuffle(rows)
    got = {r.doc_id: r.removed for r in line_dedup.report(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    assert got == dict(want) and sum(map(len, got.values())) > 300


@pytest.mark.parametrize("crowd", [0, 2, 6, 32])
def test_crowded_tokens(spark, monkeypatch, crowd):
    """Which tokens are crowded changes no result, though pairs share some that are and some that are not; one base line is in most documents."""
    monkeypatch.setattr(line_dedup, "CROWD", crowd)
    rng = random.Random(11)
    base = [[f"w{rng.randrange(120)}" for _ in range(rng.choice([6, 9, 20, 40]))] for _ in range(20)]
    rows = []
    for d in range(60):
        lines = [" ".join(edited(rng, base[0] if rng.random() < 0.4 else rng.choice(base), rng.choice([0, 1, 2, 3]))) for _ in range(rng.randrange(1, 5))]
        rows.append((d, "\n".join(lines), "x", "y"))
    got = {r.doc_id: r.removed for r in line_dedup.report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[r[0]] for r in rows] == brute(rows)


def test_words_are_hashed_once(spark, capsys):
    """A filter or an explode on the hashes must not compute them again, which it did for every line."""
    line_dedup.first_prefixes(line_dedup.lines_of(spark.createDataFrame([(1, "a b c d e f", "x", "y")], SCHEMA))).explain()
    assert capsys.readouterr().out.count("transform(") == 1


def test_prefixes_start_with_long_words(spark):
    """Short words repeat within a line, and every repetition would be one more row."""
    line = " ".join(f"{('the', 'of', 'and', 'in')[k % 4]} longword{k:02d}" for k in range(20))
    rows = line_dedup.first_prefixes(line_dedup.lines_of(spark.createDataFrame([(1, line, "x", "y")], SCHEMA)))
    assert rows.count() == 36 // 4 + line_dedup.MATCHES


def test_tokens_copy_no_line(spark, capsys):
    """A slice of the words for every token takes the square of a line's length."""
    lines = line_dedup.lines_of(spark.createDataFrame([(1, "a b c d e f", "x", "y")], SCHEMA))
    line_dedup.candidates_of(lines, lines.selectExpr("cls", "false as in_crowd")).explain()
    assert capsys.readouterr().out.count("slice(") == 1


def test_odd_rows(spark):
    rows = [(1, None, "a", "b"), (2, "", None, None), (3, "one line\n\none line", "a", "b"), (3, "one line\n\none line", "a", "b"), (None, "one line\nother", "a", "b")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r.doc_id, r.n_lines, r.removed) for r in line_dedup.report(docs).collect()), key=repr)
    assert got == [(1, 0, []), (2, 1, []), (3, 3, [2]), (3, 3, [2]), (None, 2, [0])]
    clean = line_dedup.dedup_lines(docs)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    empty = spark.createDataFrame([], SCHEMA)
    assert line_dedup.report(empty).count() == 0 and line_dedup.dedup_lines(empty).count() == 0
