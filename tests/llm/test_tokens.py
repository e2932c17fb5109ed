"""Encoding and edit-aware counts against the library on whole texts."""

import hashlib
import random

import public_tokenizers
import pytest

from tidewrack.llm import bpe, token_counts

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
SCHEMA = "doc_id long, text string, decoded string, n_tokens int"


def pieces(rng, n):
    return "".join(rng.choice(["word", " word", "  ", "\n", " ", "12", " 345", "é", "日本", "'s", "!?", "\t\n", " don't", "x" * 50, "ﬁ", " "]) for _ in range(n))


def test_chunks_and_blank_runs():
    rng, enc = random.Random(1), bpe.encoding(PATH, PATTERN)
    for n in (0, 1, 50, 3000, 60_000):
        text = pieces(rng, n)
        assert "".join(bpe.safe_chunks(text, 1000)) == text
        assert bpe.encode_text(text, enc).tolist() == enc.encode_ordinary(text)
    for blanks in (" " * 6000, "\n" * 6000, " \n\t" * 3000):
        for text in (blanks, "a" + blanks, blanks + "a", "a" + blanks + "b c" + blanks + "."):
            assert bpe.encode_text(text, enc).tolist() == enc.encode_ordinary(text)
    huge = "a" + " " * 2_000_000 + "b"
    assert enc.decode(bpe.encode_text(huge, enc).tolist()) == huge


def test_round_trip_and_odd_rows(spark):
    rng = random.Random(2)
    texts = [None, "", " ", "<|endoftext|>", "\u0000", "z" * 100_000, *(pieces(rng, 200) for _ in range(20))]
    rows = [(i if i != 3 else None, t, "clash", 7) for i, t in enumerate(texts)] + [(1, "", "clash", 7)]
    out = bpe.decode(bpe.encode(spark.createDataFrame(rows, SCHEMA), PATH, PATTERN), PATH, PATTERN)
    assert sorted(out.columns) == ["decoded", "doc_id", "n_tokens", "text", "token_ids"]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        assert bytes(r.decoded).decode() == (r.text or "") and r.n_tokens * 4 == len(r.token_ids)
    assert hashlib.sha256(got[0].token_ids).hexdigest() == hashlib.sha256(b"").hexdigest()
    assert bpe.encode(spark.createDataFrame([], SCHEMA), PATH, PATTERN).count() == 0


def test_edits_equal_encoding_anew(spark):
    rng, enc = random.Random(3), bpe.encoding(PATH, PATTERN)
    rows = []
    for d in range(40):
        text = rng.choice([None, "", pieces(rng, rng.randrange(1, 900)), " ".join(f"word{rng.randrange(99)}" for _ in range(rng.randrange(900)))])
        n = len(text or "")
        edits = [(rng.randrange(-3, n + 9), rng.choice([0, 1, 3, 700]), rng.choice([None, "", " ", "x", " new words here", "\n\n", pieces(rng, 300)])) for _ in range(rng.randrange(6))]
        rows.append((d, text, rng.choice([edits, None]) if d % 7 == 0 else edits))
    docs = spark.createDataFrame(rows, f"doc_id long, text string, edits {token_counts.EDITS}")
    got = token_counts.apply_edits(token_counts.build(docs, PATH, PATTERN), PATH, PATTERN).collect()
    for r, (_, text, edits) in zip(sorted(got, key=lambda r: r.doc_id), rows):
        text = text or ""
        assert r.n_tokens == len(enc.encode_ordinary(text))
        for start, removed, inserted in edits or []:
            start = min(max(start, 0), len(text))
            text = text[:start] + (inserted or "") + text[min(start + removed, len(text)) :]
        assert r.edited_text == text and r.edited_tokens == len(enc.encode_ordinary(text))


def test_few_characters_are_encoded_again():
    enc = bpe.encoding(PATH, PATTERN)
    text = "some words " * 20_000
    leaves = token_counts.cut_leaves(text)
    tree = token_counts.SegmentTree(leaves, [len(enc.encode_ordinary(x)) for x in leaves])
    assert tree.tokens[1] == len(enc.encode_ordinary(text))
    assert tree.edit(100_000, 3, "abc", lambda t: len(enc.encode_ordinary(t))) < 3 * token_counts.LEAF_CHARS


def test_edits_from_a_table(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, "three")], "doc_id long, text string")
    edits = spark.createDataFrame([(1, 2, 0, 0, "x"), (1, 1, 3, 4, "")], "doc_id long, seq int, start int, removed int, inserted string")
    joined = token_counts.with_edits(token_counts.build(docs, PATH, PATTERN), edits)
    assert {r.doc_id: r.edited_text for r in token_counts.apply_edits(joined, PATH, PATTERN).collect()} == {1: "xone", 2: "three"}


def test_other_patterns_are_refused(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert bpe.PATTERN == PATTERN
    with pytest.raises(ValueError, match="one pattern"):
        bpe.encode(docs, PATH, r"\w+|\W")
