"""Every stage of the pipeline on the smallest tables, against what it should leave."""

import hashlib

import corpus_pipeline
import public_tokenizers
import pytest

from tests.llm import test_line_dedup, test_ngram_join
from tidewrack.llm import bpe, mixing
from tidewrack.session import materialize

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], SF), name))
    return out


def test_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard_join", "mixing", "byte_bpe"]
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_toxicity_keeps_whole_documents(stages):
    before, after = ({r.doc_id: r.text for r in s.collect()} for s in stages[:2])
    assert after.items() <= before.items() and len(after) >= 0.7 * len(before)


def test_lines(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].orderBy("doc_id").collect()]
    gone = test_line_dedup.brute(rows)
    want = {d: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in w) for (d, t), w in zip(rows, gone)}
    got = stages[2].collect()
    assert {r.doc_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_one_of_each_group(stages):
    rows = [(r.doc_id, r.text) for r in stages[2].collect()]
    first = {d for d, _, component in test_ngram_join.brute(rows) if d == component}
    assert sorted(r.doc_id for r in stages[3].collect()) == sorted(first)


def test_mix_comes_near_its_targets(stages):
    words = lambda rows: {s: sum(len(r.text.split()) for r in rows if r.source == s) for s in {r.source for r in rows}}
    before, after = stages[3].collect(), stages[4].collect()
    held, taken = words(before), words(after)
    order = sorted(held)
    want = mixing.targets([held[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))])
    assert all(abs(taken.get(s, 0) - t) <= max(20, 0.05 * t) for s, t in zip(order, want))


def test_tokens(stages):
    enc = bpe.encoding(public_tokenizers.path(corpus_pipeline.RANK_FILE), public_tokenizers.PATTERN)
    texts = {r.doc_id: r.text for r in stages[4].collect()}
    for r in stages[5].collect():
        assert r.n_tokens == len(enc.encode_ordinary(texts[r.doc_id]))
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() and r.ids_sha256 == hashlib.sha256(r.token_ids).hexdigest()
