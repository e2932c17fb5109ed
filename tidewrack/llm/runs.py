"""Periodic runs of words, by recursive frequency splitting and lag scans.

A run is a maximal stretch of words with smallest period q (words q apart are
identical) that is at least REPEATS periods and LEAST words long. Every word in
it occurs REPEATS times or more within it. So:

1. Splitting: a word that occurs fewer times than that within the current
   segment is in no run and splits it. Counts are taken again within the parts,
   all of a text's segments at once, until nothing splits.
2. Lag scan of the segments that survive: words are compared with those a lag
   before. Short lags are scanned in full. A stretch of a longer lag q from
   [low, high], high at most 1.5 low, equals itself q words later over 3 q words
   or more, so it holds a whole block of 2 low words that starts at a multiple
   of low and that stands again q words later: hashes of blocks tell the lags
   worth a scan, and only these are scanned, word by word.

Rows are independent: the operator is one map without a shuffle.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidewrack.llm.tables import map_batches

#: A run has at least so many words and so many periods.
LEAST, REPEATS = 6, 4
#: Lags up to this are scanned in full; it does not change what is found.
SHORT_LAGS = 32

_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD1342543DE82EF95)

RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
_ARROW_RUN = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])


def split(words: np.ndarray) -> list[tuple[int, int]]:
    """Segments (start, stop) of a text's word numbers in which every word occurs often enough to be in a run.

    A round looks at all segments that lost a word in the round before; the
    number of rounds is at most that of distinct words, and few in practice.
    """
    found: list[tuple[int, int]] = []
    place, segment = np.arange(len(words)), np.zeros(len(words), dtype=np.int64)
    base = int(words.max()) + 1 if len(words) else 1
    while len(place) >= LEAST:
        _, inverse, counts = np.unique(segment * base + words[place], return_inverse=True, return_counts=True)
        held = counts[inverse] >= REPEATS
        hurt = np.zeros(int(segment[-1]) + 1, dtype=bool)
        hurt[segment[~held]] = True
        calm = place[~hurt[segment]]
        if len(calm):
            ends = np.flatnonzero(np.diff(calm) != 1)
            found += zip(calm[np.append(0, ends + 1)].tolist(), (calm[np.append(ends, len(calm) - 1)] + 1).tolist(), strict=True)
        place = place[held & hurt[segment]]
        if not len(place):
            break
        segment = np.cumsum(np.diff(place, prepend=place[0] - 1) != 1)
        long = np.bincount(segment)[segment] >= LEAST
        place, segment = place[long], np.unique(segment[long], return_inverse=True)[1]
    return found


def _same(a: np.ndarray, b: np.ndarray) -> int:
    """How many words are equal from the start of both."""
    done, step, size = 0, 64, min(len(a), len(b))
    while done < size:
        differ = a[done : min(done + step, size)] != b[done : min(done + step, size)]
        if differ.any():
            return done + int(differ.argmax())
        done, step = min(done + step, size), step * 2
    return size


def _smallest(stretch: np.ndarray, period: int) -> bool:
    """Whether a stretch of several periods has no smaller period; such a one divides ``period``."""
    rest, factor = period, 2
    while rest > 1:
        if factor * factor > rest:
            factor = rest
        if rest % factor == 0:
            part = period // factor
            if (stretch[:period] == stretch[part : part + period]).all():
                return False
            while rest % factor == 0:
                rest //= factor
        factor += 1
    return True


def _scan_whole(words: np.ndarray, lag: int) -> list[tuple[int, int, int]]:
    equal = np.zeros(len(words) - lag + 2, dtype=np.int8)
    equal[1:-1] = words[lag:] == words[:-lag]
    edges = np.flatnonzero(np.diff(equal))
    starts, lengths = edges[::2], edges[1::2] - edges[::2] + lag
    long = lengths >= max(LEAST, REPEATS * lag)
    return [(int(s), int(n), lag) for s, n in zip(starts[long], lengths[long], strict=True) if _smallest(words[s : s + n], lag)]


def _scan_blocks(words: np.ndarray, sums: np.ndarray, powers: np.ndarray, low: int, high: int, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs with periods from low to high, from blocks that stand again at such a lag."""
    size, block = len(words), 2 * low
    hashes = (sums[block:] - sums[:-block]) * powers[size - block :: -1]  # of the block at every place, shifted to one scale
    anchors = np.arange(0, size - block - low + 1, low)
    lags = np.arange(low, high + 1)
    at = anchors[:, None] + lags[None, :]
    equal = (hashes[np.minimum(at, len(hashes) - 1)] == hashes[anchors][:, None]) & (at < len(hashes))
    # Inside a run of a smaller period, its multiples are lags of the same stretch.
    period, until = np.ones(len(anchors), dtype=np.int64), np.zeros(len(anchors), dtype=np.int64)
    for start, length, p in known:
        inside = slice(-(-start // low), max(0, (start + length - block) // low + 1))
        period[inside], until[inside] = p, start + length
    equal &= (lags[None, :] % period[:, None] != 0) | (at + block > until[:, None])
    found, reached = [], {}
    for i, j in zip(*np.nonzero(equal), strict=True):
        place, lag = int(anchors[i]), int(lags[j])
        if place < reached.get(lag, 0):
            continue
        start = place - _same(words[:place][::-1], words[lag : place + lag][::-1])
        stop = place + _same(words[place:], words[place + lag :])
        reached[lag] = stop
        if stop - start + lag >= REPEATS * lag and _smallest(words[start : stop + lag], lag):
            found.append((start, stop - start + lag, lag))
    return found


def scan(words: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) of one segment."""
    most = len(words) // REPEATS
    found = [run for lag in range(1, min(most, SHORT_LAGS) + 1) for run in _scan_whole(words, lag)]
    low = SHORT_LAGS + 1
    if low <= most:
        with np.errstate(over="ignore"):
            mixed = (words.astype(np.uint64) + np.uint64(1)) * _MIX
            mixed ^= mixed >> np.uint64(29)
            powers = np.cumprod(np.append(np.uint64(1), np.full(len(words), _BASE)), dtype=np.uint64)
            sums = np.append(np.uint64(0), np.cumsum(mixed * powers[:-1], dtype=np.uint64))
            while low <= most:
                high = min(most, low + low // 2)
                found += _scan_blocks(words, sums, powers, low, high, [r for r in found if r[1] >= 2 * low])
                low = high + 1
    return found


def runs_of(words: list[bytes]) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a text's words, by start and then period."""
    if len(words) < LEAST:
        return []
    numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
    text = np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=len(words))
    return sorted((start + s, n, p) for start, stop in split(text) for s, n, p in scan(text[start:stop]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run contains after its first period, joined by one space."""
    kept = np.ones(len(words), dtype=bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return b" ".join(w for w, k in zip(words, kept.tolist(), strict=True) if k) if runs else b" ".join(words)


def detect(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``n_words``, ``runs`` (start, length, period; by start, then period), ``strongest`` (the run of most periods; null without runs) and ``collapsed``.

    Words are maximal runs of other characters than the space and \\x09 to \\x0D,
    compared as they are. Of equally strong runs the first stands, then the one
    of the smaller period. Null, empty and wordless texts have no words, no runs
    and an empty ``collapsed``. Very long texts are taken whole. Repeated rows
    and null ids are rows like others; an empty table gives an empty result.
    Other columns pass through, whatever their names; one already named like an
    added column is replaced.
    """

    def make(batch: pa.RecordBatch) -> list[list]:
        counts, runs, strongest, texts = [], [], [], []
        for x in batch.column(batch.schema.get_field_index(text_col)):
            words = (x.as_py() or "").encode().split()
            found = runs_of(words)
            named = [dict(zip(RUN.names, r, strict=True)) for r in found]
            counts.append(len(words))
            runs.append(named)
            strongest.append(max(named, key=lambda r: (Fraction(r["length"], r["period"]), -r["start"], -r["period"]), default=None))
            texts.append(collapsed(words, found).decode())
        return [counts, runs, strongest, texts]

    added = [("n_words", T.LongType()), ("runs", T.ArrayType(RUN)), ("strongest", RUN), ("collapsed", T.StringType())]
    return map_batches(df, added, [pa.int64(), pa.list_(_ARROW_RUN), _ARROW_RUN, pa.string()], make)
