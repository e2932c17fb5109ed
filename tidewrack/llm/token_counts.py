"""Edit-aware token counts from a segment tree of pre-token runs per document.

A text is cut into leaves at places where every pre-token ends whatever stands
around them (a letter before a plain space), so leaves encode independently.
The tree keeps sums of characters and tokens. An edit descends by character
sums to the leaves that it touches, merges a neighbour where the edit destroyed
the safe cut between them, encodes only that region again and updates the sums
on the path to the root.

Documents are independent rows: both stages are maps without a shuffle, and the
stored state of a document is two short lists.
"""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewrack.llm.bpe import encode_text, encoding
from tidewrack.llm.tables import map_batches

#: A leaf is cut at the first safe place after so many characters.
LEAF_CHARS = 512

_SAFE = regex.compile(r"(?<=\p{L}) ")
_LETTER = regex.compile(r"\p{L}")

EDITS = "array<struct<start:int,removed:int,inserted:string>>"


def cut_leaves(text: str, size: int = LEAF_CHARS) -> list[str]:
    """Leaves of a text; none for an empty one."""
    leaves, start = [], 0
    while len(text) - start > size and (cut := _SAFE.search(text, start + size)):
        leaves.append(text[start : cut.start()])
        start = cut.start()
    return [*leaves, text[start:]] if text[start:] else leaves


class SegmentTree:
    """Sums of characters and tokens over leaves; node k has children 2k and 2k + 1."""

    def __init__(self, leaves: list[str], tokens: list[int]) -> None:
        self.width = 1
        while self.width < len(leaves):
            self.width *= 2
        self.text = leaves + [""] * (self.width - len(leaves))
        self.chars = [0] * self.width + [len(x) for x in self.text]
        self.tokens = [0] * self.width + tokens + [0] * (self.width - len(tokens))
        for k in range(self.width - 1, 0, -1):
            self._sum(k)

    def _sum(self, k: int) -> None:
        self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
        self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    def put(self, leaf: int, text: str, tokens: int) -> None:
        """Change a leaf and the sums above it."""
        self.text[leaf] = text
        k = leaf + self.width
        self.chars[k], self.tokens[k] = len(text), tokens
        while k > 1:
            k //= 2
            self._sum(k)

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` (the last one with text for the end), and the place in it."""
        k = 1
        while k < self.width:
            k *= 2
            if at >= self.chars[k] and self.chars[k + 1]:
                at -= self.chars[k]
                k += 1
        return k - self.width, at

    def beside(self, leaf: int, step: int) -> int | None:
        """The nearest leaf with text before (-1) or after (1) ``leaf``."""
        leaf += step
        while 0 <= leaf < self.width:
            if self.text[leaf]:
                return leaf
            leaf += step
        return None

    def edit(self, start: int, removed: int, inserted: str, count) -> int:
        """Apply an edit; characters that were encoded again. Places outside the text mean its nearest end."""
        total = self.chars[1]
        start = min(max(start, 0), total)
        stop = min(start + max(removed, 0), total)
        first, head = self.find(start)
        last, tail = self.find(stop)
        text = self.text[first][:head] + inserted + self.text[last][tail:]
        low, high = first, last
        while (k := self.beside(low, -1)) is not None and not (text[:1] == " " and _LETTER.match(self.text[k][-1])):
            text, low = self.text[k] + text, k
        while (k := self.beside(high, 1)) is not None and not (self.text[k][0] == " " and text and _LETTER.match(text[-1])):
            text, high = text + self.text[k], k
        for k in range(low + 1, high + 1):
            if self.text[k]:
                self.put(k, "", 0)
        self.put(low, text, count(text))
        return len(text)


def build(docs: DataFrame, rank_file: str, pattern: str, text_col: str = "text") -> DataFrame:
    """Add n_tokens, leaf_chars and leaf_tokens, the state that later edits start from.

    Null and empty texts have no leaves. Repeated rows get equal states, an empty
    table gives an empty result, and columns already named like the added ones
    are replaced. A text without a safe cut is one leaf, however long, and an
    edit encodes all of it again.
    """

    def make(batch: pa.RecordBatch) -> list[list]:
        enc = encoding(rank_file, pattern)
        leaves = [cut_leaves(x.as_py() or "") for x in batch.column(batch.schema.get_field_index(text_col))]
        counts = [[len(encode_text(leaf, enc)) for leaf in row] for row in leaves]
        return [[sum(row) for row in counts], [[len(leaf) for leaf in row] for row in leaves], counts]

    ints = T.ArrayType(T.IntegerType())
    return map_batches(docs, [("n_tokens", T.LongType()), ("leaf_chars", ints), ("leaf_tokens", ints)], [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())], make)


def apply_edits(docs: DataFrame, rank_file: str, pattern: str, text_col: str = "text", edits_col: str = "edits") -> DataFrame:
    """Add edited_text, edited_tokens (its number of tokens) and encoded_chars (characters that were encoded for that).

    ``docs`` has the state of ``build`` and a list of edits (start, removed,
    inserted), applied in order, each on the text that the earlier ones left. A
    null list or edit changes nothing; a null inserted text is empty. The counts
    equal those of encoding the edited text anew.
    """

    def make(batch: pa.RecordBatch) -> list[list]:
        enc = encoding(rank_file, pattern)
        texts, edits, chars, tokens = (batch.column(batch.schema.get_field_index(c)) for c in (text_col, edits_col, "leaf_chars", "leaf_tokens"))
        out: list[list] = [[], [], []]
        for text, changes, sizes, counts in zip(texts, edits, chars, tokens, strict=True):
            leaves, at, whole = [], 0, text.as_py() or ""
            for n in sizes.as_py() or []:
                leaves.append(whole[at : at + n])
                at += n
            tree, encoded = SegmentTree(leaves, counts.as_py() or []), 0
            for e in changes.as_py() or []:
                if e is not None:
                    encoded += tree.edit(e["start"] or 0, e["removed"] or 0, e["inserted"] or "", lambda t: len(encode_text(t, enc)))
            out[0].append("".join(tree.text))
            out[1].append(tree.tokens[1])
            out[2].append(encoded)
        return out

    return map_batches(docs, [("edited_text", T.StringType()), ("edited_tokens", T.LongType()), ("encoded_chars", T.LongType())], [pa.string(), pa.int64(), pa.int64()], make)


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """Add edits, from a table of (doc_id, seq, start, removed, inserted); documents without any get null."""
    lists = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "start", "removed", "inserted"))).alias("x"))
    lists = lists.select("doc_id", F.transform("x", lambda e: F.struct(e["start"].cast("int").alias("start"), e["removed"].cast("int").alias("removed"), e["inserted"].alias("inserted"))).alias("edits"))
    return docs.drop("edits").join(lists, "doc_id", "left")
