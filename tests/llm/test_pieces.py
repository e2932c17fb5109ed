"""SentencePiece ids and texts against the library on whole texts."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

from tidewrack.llm import pieces, registry

PATH = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, token_ids int, decoded long, extra array<string>"
PARTS = [*"abcdefghij   ▁▁.,\n\t0129éüßñ日本語語テ😀\x00'-_=()<>", "the", "ing", " of", " and", "tion", "    ", " " * 20, "<s>", "</s>", "<0x0A>", "Ⅷ", "e\u0301"]


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=PATH)


@pytest.mark.parametrize("seed", range(10))
def test_ids_and_texts(library, seed):
    rng, model = random.Random(seed), pieces.pieces(PATH)
    for _ in range(400):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(60)))
        want = library.encode(text, add_bos=True, add_eos=True)
        got = np.frombuffer(model.encode(text), dtype="<u4")
        assert got.tolist() == want, text
        assert model.decode(got) == library.decode(want)


def test_any_ids_decode_as_the_library_does_in_chunks(library, monkeypatch):
    monkeypatch.setattr(pieces, "CHUNK_IDS", 7)
    rng, model = random.Random(1), pieces.pieces(PATH)
    for _ in range(300):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), 0, 1, 2, 28705, 264]) for _ in range(rng.randrange(40))]
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(60)))
        for some in (ids, library.encode(text)):
            if some and some[0] in (1, 2) and len(some) > 7:
                some = some[1:]
            assert model.decode(np.array(some, dtype="<u4")) == library.decode(some), some


def test_long_texts_and_words(library):
    model = pieces.pieces(PATH)
    for text in (" " * 70_000, "x" * 70_000, "日" * 30_000 + "\n" * 30_000, "ab" * 40_000, "ÿ" * 30_000, "aaa b" * 30_000):
        want = library.encode(text, add_bos=True, add_eos=True)
        got = np.frombuffer(model.encode(text), dtype="<u4")
        assert got.tolist() == want and model.decode(got) == text


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 10)
    model = pieces.Pieces(PATH)
    texts = [f"word{i} and more{i % 7}" for i in range(200)]
    assert [model.encode(t) for t in texts] == [pieces.pieces(PATH).encode(t) for t in texts]
    assert len(model.segments) <= 10 and len(model.pairs) <= 10


def test_other_models_are_refused(tmp_path):
    proto = sentencepiece_model_pb2.ModelProto()
    with open(PATH, "rb") as file:
        proto.ParseFromString(file.read())
    changed = sentencepiece_model_pb2.ModelProto.FromString(proto.SerializeToString())
    changed.trainer_spec.model_type = sentencepiece_model_pb2.TrainerSpec.UNIGRAM
    (tmp_path / "unigram.model").write_bytes(changed.SerializeToString())
    proto.pieces[300].type = sentencepiece_model_pb2.ModelProto.SentencePiece.USER_DEFINED
    (tmp_path / "own.model").write_bytes(proto.SerializeToString())
    for name in ("unigram.model", "own.model"):
        with pytest.raises(ValueError):
            pieces.Pieces(str(tmp_path / name))


def test_query_on_whole_documents(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = registry.op12_pieces(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode(docs[r.doc_id] or "", add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_odd_rows(spark):
    rows = [(1, None), (None, ""), (2, "\u0000"), (3, "same"), (3, "same"), (4, "long " * 300_000)]
    out = pieces.decode(pieces.encode(spark.createDataFrame([(*r, 5, 6, ["e"]) for r in rows], SCHEMA), PATH), PATH)
    assert sorted(out.columns) == ["decoded", "doc_id", "extra", "n_tokens", "text", "token_ids"]
    got = out.collect()
    assert sorted((r.doc_id or 0, r.decoded, r.extra) for r in got) == sorted((d or 0, t or "", ["e"]) for d, t in rows)
    assert sorted(r.n_tokens for r in got if not r.text) == [2, 2]
    assert pieces.encode(spark.createDataFrame([], SCHEMA), PATH).count() == 0
