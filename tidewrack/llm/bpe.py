"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Rows are independent, so the whole operator is one map without a shuffle. Each
Python worker loads the rank file once. Long texts are cut at places where no
match of the split pattern can span, which bounds what one library call sees;
very long runs of white space, on which the library's look-ahead overflows its
stack, are cut out by rule and merged as the single pieces that they are.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidewrack.llm.tables import map_batches

#: Fixed value: the split pattern that the cuts and the rule for blanks are derived from; others are refused.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A long text is cut near multiples of this many characters.
CHUNK_CHARS = 1 << 16
#: White-space runs at least this long are merged as one piece without the library's pattern.
LONG_BLANK = 4096

_BLANKS = regex.compile(r"\p{White_Space}{%d,}" % LONG_BLANK)
#: A letter before a plain space: every match ends there, and the next one starts with the space.
_SAFE = regex.compile(r"(?<=\p{L}) ")


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a local rank file (lines of base64 token and rank); one per worker process."""
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_chunks(text: str, size: int = CHUNK_CHARS) -> list[str]:
    """Parts of ``text`` that encode separately to the same ids as the whole."""
    if len(text) <= size:
        return [text]
    parts, start = [], 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if cut is None:
            break
        parts.append(text[start : cut.start()])
        start = cut.start()
    parts.append(text[start:])
    return parts


def encode_text(text: str | None, enc: tiktoken.Encoding) -> np.ndarray:
    """Ids of a whole text as unsigned 32-bit integers. Null and empty texts have none."""
    if not text:
        return np.empty(0, dtype="<u4")
    ids: list[int] = []
    start = 0
    for run in _BLANKS.finditer(text):
        for part in safe_chunks(text[start : run.start()]):
            ids += enc.encode_ordinary(part)
        # A run before other text gives up its last character; a run at the end is whole.
        end = run.end() if run.end() == len(text) else run.end() - 1
        ids += enc._encode_single_piece(text[run.start() : end].encode())
        start = end
    for part in safe_chunks(text[start:]):
        ids += enc.encode_ordinary(part)
    return np.array(ids, dtype="<u4")


def encode(df: DataFrame, rank_file: str, pattern: str, text_col: str = "text") -> DataFrame:
    """Add ``n_tokens`` (long) and ``token_ids`` (binary: ids as little-endian unsigned 32-bit integers).

    Null and empty texts get 0 and an empty binary. Every row is kept, repeated
    rows and null ids too; an empty table gives an empty result. Very long texts
    are encoded whole, part by part. Other columns pass through, and one already
    named like an added column is replaced. ``rank_file`` must exist on every
    executor.
    """
    if pattern != PATTERN:
        raise ValueError("the cuts of long texts are known to be safe for one pattern only")

    def make(batch: pa.RecordBatch) -> list[list]:
        enc = encoding(rank_file, pattern)
        ids = [encode_text(x.as_py(), enc) for x in batch.column(batch.schema.get_field_index(text_col))]
        return [[len(x) for x in ids], [x.tobytes() for x in ids]]

    return map_batches(df, [("n_tokens", T.LongType()), ("token_ids", T.BinaryType())], [pa.int64(), pa.binary()], make)


def decode(df: DataFrame, rank_file: str, pattern: str, ids_col: str = "token_ids") -> DataFrame:
    """Add ``decoded`` (binary), the raw bytes of the ids in ``ids_col``; null ids decode to no bytes."""

    def make(batch: pa.RecordBatch) -> list[list]:
        enc = encoding(rank_file, pattern)
        column = batch.column(batch.schema.get_field_index(ids_col))
        return [[enc.decode_bytes(np.frombuffer(x.as_py() or b"", dtype="<u4").tolist()) for x in column]]

    return map_batches(df, [("decoded", T.BinaryType())], [pa.binary()], make)
