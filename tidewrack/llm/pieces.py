"""SentencePiece encoding and decoding (models of merge type) by a table of every prefix's last token.

A merge tokenization is right exactly when each two neighbouring tokens are what
their joint text merges to: merges inside two neighbours run in the same order
alone and within the whole, so a wrong border would show in the pair. Hence
every prefix of a text has one last token, which depends on what ends there and
on the last token of the shorter prefix:

1. An Aho-Corasick automaton of all pieces lists what ends at each character.
2. The one of these that starts the text and merges to itself, or that is
   compatible with the last token of the prefix before it, is stored.
3. The ids are read from the table backwards, from the end of the text.

Texts are cut first where no piece can span (at word starts and around
characters that are no pieces), and short segments are remembered, so a word
that occurs often is worked out once per worker. Rows are independent: the
operator is one map without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

from tidewrack.llm.tables import map_batches

#: The sign that stands for a space in pieces.
SPACE = "▁"
#: Segments up to this length are remembered, and how many of them and of tested pairs at once; neither changes a result.
SHORT, REMEMBERED = 48, 1 << 17
#: Ids that one call of the library decodes, about.
CHUNK_IDS = 1 << 16


class _Memory(dict):
    """A dict that works missing values out; when it is full, what was not asked for since it was full before goes."""

    def __init__(self, make: Callable) -> None:
        self.make, self.before = make, {}

    def __missing__(self, key):
        value = self.before.get(key)
        if value is None:
            value = self.make(key)
        if not isinstance(key, str) or len(key) <= SHORT:
            if len(self) >= REMEMBERED:
                self.before = dict(self)
                self.clear()
            self[key] = value
        return value


def _cut(pieces: Iterable[str]) -> re.Pattern[str]:
    """A pattern that cuts texts where no piece can span: characters that stand side by side in some piece are of one group, and matches stay within a group.

    Spaces join what follows them, unless pieces hold them elsewhere too.
    """
    multi, letters = [p for p in pieces if len(p) > 1], {c for p in pieces for c in p}
    first = not any(SPACE in p.lstrip(SPACE) for p in multi)
    group = {c: c for c in letters}

    def find(c: str) -> str:
        while group[c] != c:
            group[c] = c = group[group[c]]
        return c

    for p in multi:
        held = p.lstrip(SPACE) if first else p
        for a, b in zip(held, held[1:], strict=False):
            group[find(a)] = find(b)
    groups: dict[str, list[str]] = {}
    for c in sorted(letters - {SPACE} if first else letters):
        groups.setdefault(find(c), []).append(c)
    classes = sorted(("".join(map(re.escape, g)) for g in groups.values() if len(g) > 1), key=len, reverse=True)
    alone = "".join(re.escape(g[0]) for g in groups.values() if len(g) == 1)
    options = "|".join([*(f"[{x}]+" for x in classes), *([f"[{alone}]+"] if alone else [])])
    before, spaces = (f"{SPACE}*", f"|{SPACE}+") if first else ("", "")
    return re.compile(f"{before}(?:{options}){spaces}|[^{''.join(map(re.escape, sorted(letters)))}]+")


class Pieces:
    """A model file: its pieces, their automaton and the library's normalizer and decoder."""

    def __init__(self, model_file: str) -> None:
        proto = sentencepiece_model_pb2.ModelProto()
        with open(model_file, "rb") as file:
            proto.ParseFromString(file.read())
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        known = {kinds.NORMAL, kinds.UNKNOWN, kinds.CONTROL, kinds.BYTE}
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
        self.scores = {p.piece: p.score for p in proto.pieces if p.type == kinds.NORMAL}
        letters = {c for p in self.ids for c in p}
        if proto.trainer_spec.model_type != sentencepiece_model_pb2.TrainerSpec.BPE or not proto.trainer_spec.byte_fallback:
            raise ValueError("only models of merge type with byte fallback are supported")
        if any(p.type not in known for p in proto.pieces) or proto.denormalizer_spec.precompiled_charsmap or not letters <= self.ids.keys():
            raise ValueError("models with unused or user-defined pieces, a denormalizer, or characters in pieces that are no pieces are not supported")
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        self.processor = SentencePieceProcessor(model_file=model_file)
        self.begin, self.end = self.processor.bos_id(), self.processor.eos_id()
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            self.automaton.add_word(p, (len(p), p))
        self.automaton.make_automaton()
        self.cut = _cut(self.ids)
        self.segments = _Memory(self._segment)
        self.histories, self.pairs = _Memory(self._history), _Memory(self._compatible)
        self.lead = next(p for p in self.ids if len(p) == 1 and p.isascii() and p.isalpha())
        self.continued = np.zeros(len(proto.pieces), dtype=bool)
        self.continued[[i for b, i in self.bytes.items() if 0x80 <= b < 0xC0]] = True

    def _history(self, piece: str) -> tuple[list[tuple[float, str, str]], bool]:
        """The merges inside a piece, best score first and then leftmost: each one's score and what stands at the left and right edge afterwards; and whether they end at the piece."""
        parts, steps = list(piece), []
        while len(parts) > 1:
            both = [(-self.scores[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.scores]
            if not both:
                break
            score, at = min(both)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            steps.append((-score, parts[0], parts[-1]))
        return steps, len(parts) == 1

    def _compatible(self, pair: tuple[str, str]) -> bool:
        """Whether two tokens stay apart when their joint text is merged: no merge across the border is ever due before the merges on both its sides.

        A merge is due before others by its score, then by its place. The first of a pair is empty at the start of a text.
        """
        (left, whole), (right, also) = self.histories[pair[0]] if pair[0] else ([], True), self.histories[pair[1]]
        if not pair[0] or not whole or not also:
            return whole and also
        before, after = pair[0][-1], pair[1][0]
        i = j = 0
        while True:
            across = self.scores.get(before + after)
            ahead = left[i][0] if i < len(left) else None
            behind = right[j][0] if j < len(right) else None
            if across is not None and (ahead is None or ahead < across) and (behind is None or behind <= across):
                return False
            if ahead is not None and (behind is None or ahead >= behind):
                before, i = left[i][2], i + 1
            elif behind is not None:
                after, j = right[j][1], j + 1
            else:
                return True

    def _segment(self, text: str) -> bytes:
        """Ids of a segment, from the table of its prefixes' last tokens."""
        if text[0] not in self.ids:  # characters that are no pieces, as bytes
            return np.array([self.bytes[b] for b in text.encode()], dtype="<u4").tobytes()
        last = [""]  # of every prefix
        pairs, at = self.pairs, -1
        for end, (size, piece) in self.automaton.iter(text):
            # The first token has no neighbour: the pair with nothing tells whether it merges to itself.
            if end != at and pairs[last[end + 1 - size], piece]:
                last.append(piece)
                at = end
        found, end = [], len(text)
        while end:
            found.append(self.ids[last[end]])
            end -= len(last[end])
        return np.array(found[::-1], dtype="<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids with begin and end as little-endian unsigned 32-bit integers; a null text is an empty one."""
        parts = self.cut.findall(self.processor.normalize(text)) if text else []
        begin, end = (np.array([i], dtype="<u4").tobytes() for i in (self.begin, self.end))
        return b"".join([begin, *map(self.segments.__getitem__, parts), end])

    def decode(self, ids: np.ndarray) -> str:
        """The library's text of the ids, chunk by chunk: cut before ids that are no later byte of a character, after a letter that holds a leading space."""
        parts, start = [], 0
        while start < len(ids):
            stop = start + CHUNK_IDS
            while stop < len(ids) and self.continued[ids[stop]]:
                stop += 1
            part = ids[start:stop].tolist()
            parts.append(self.processor.decode([self.ids[self.lead], *part])[1:] if start else self.processor.decode(part))
            start = stop
        return "".join(parts)


@lru_cache(maxsize=2)
def pieces(model_file: str) -> Pieces:
    """The pieces of a local model file; one per worker process."""
    return Pieces(model_file)


def encode(df: DataFrame, model_file: str, text_col: str = "text") -> DataFrame:
    """Add ``n_tokens`` (long) and ``token_ids`` (binary: ids as little-endian unsigned 32-bit integers), begin and end ids among them.

    Null and empty texts have these two ids only. Every row is kept, repeated
    rows and null ids too; an empty table gives an empty result. Very long texts
    and very long words are worked out in one pass over their characters. Other
    columns pass through, whatever their names; one already named like an added
    column is replaced. ``model_file`` must exist on every executor.
    """

    def make(batch: pa.RecordBatch) -> list[list]:
        model = pieces(model_file)
        ids = [model.encode(x.as_py()) for x in batch.column(batch.schema.get_field_index(text_col))]
        return [[len(x) // 4 for x in ids], ids]

    return map_batches(df, [("n_tokens", T.LongType()), ("token_ids", T.BinaryType())], [pa.int64(), pa.binary()], make)


def decode(df: DataFrame, model_file: str, ids_col: str = "token_ids") -> DataFrame:
    """Add ``decoded`` (string), the text of the ids in ``ids_col``; null and no ids decode to an empty text. Other columns fare as in ``encode``."""

    def make(batch: pa.RecordBatch) -> list[list]:
        model = pieces(model_file)
        column = batch.column(batch.schema.get_field_index(ids_col))
        return [[model.decode(np.frombuffer(x.as_py() or b"", dtype="<u4")) for x in column]]

    return map_batches(df, [("decoded", T.StringType())], [pa.string()], make)
