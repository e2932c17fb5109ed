"""Toxicity by a linear-chain conditional random field over words.

Labels are of documents, so the tokens' labels are what the chain has to work
out: of a toxic document at least one word is offending, of a clean one none.
The chain of a text gives the probability that no word is offending, one over
its normaliser; fitting maximises the likelihood of the labels under that
constraint, with expected counts from forward-backward. Features of a word are
its affixes and itself (those that toxic documents have significantly more
often), its shape, and how many other words with such features stand near it.

Fitting uses a bounded sample of labelled documents. Scoring runs
forward-backward over every whole text; the marginals of its words give the
document's score by a fitted logistic curve, and their offsets mark the
offending spans.

Near copies would make the words of one text look frequent, so the sample
keeps one document per smallest shingle hash.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewrack.llm.shingles import shingle_set
from tidewrack.llm.tables import in_small_batches, map_batches
from tidewrack.session import discard, materialize

#: Bounds of the sample that fits the model: toxic documents, clean documents, documents of each kind that fit the chain, and their words.
MAX_TOXIC, MAX_CLEAN, MAX_CHAIN, MAX_CHAIN_WORDS = 4000, 12000, 600, 1000
#: A feature is a candidate from this likelihood ratio (G squared) and log odds on.
LEAST_RATIO, LEAST_ODDS = 22.0, 1.5
THRESHOLD = 0.7

_WORD = re.compile(r"\w+")
_CACHE_WORDS = 100_000
#: Characters of sample texts whose features are counted at once, about; a word has up to ten features.
COUNTED_CHARS = 1 << 18


def word_features(word: str) -> list[str]:
    """Prefixes of 3 to 9 letters, shortest first, suffixes of 3 and 4, and the word itself; ``word`` is in lower case."""
    return [word[:k] + "*" for k in range(3, min(10, len(word) + 1))] + ["*" + word[-k:] for k in (3, 4) if k < len(word)] + [word]


#: Features of a word besides those of ``word_features``: capitals only, many letters; and of words with a candidate feature: one other
#: such word, or more, within REACH words on either side.
CONTEXT = ("!capitals", "!long", "!one_near", "!more_near")
REACH = 200


def shape(word: str) -> tuple[bool, bool]:
    return len(word) > 1 and word.isupper(), len(word) > 12


@dataclass
class Model:
    """Weights of the chain and of the document curve. ``constant`` stands alone where nothing could be learned."""

    weights: dict[str, float] = field(default_factory=dict)
    context: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)
    bias: float = -5.0
    #: Scores of the transitions from clean to offending, back, and of staying offending; staying clean is 0.
    moves: tuple[float, float, float] = (0.0, 0.0, 0.0)
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)
    constant: float | None = None


class Strengths(dict):
    """Each word's own score, computed when first asked for; words with a candidate feature are told by MARK on top."""

    MARK = 1e6

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        held = [self.model.weights[f] for f in word_features(word.lower()) if f in self.model.weights]
        own = sum(held) + sum(w for w, on in zip(self.model.context, shape(word), strict=False) if on)
        self[word] = own + self.MARK * bool(held)
        return self[word]


def others_near(marked: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each marked word, in order, how many other marked words of its text are within REACH words."""
    at = np.flatnonzero(marked)
    far = at + (REACH + 1) * np.repeat(np.arange(len(lengths)), lengths)[at]  # texts lie further apart than REACH
    return np.searchsorted(far, far + REACH, side="right") - np.searchsorted(far, far - REACH) - 1


def emissions(strengths: np.ndarray, lengths: np.ndarray, model: Model) -> np.ndarray:
    """Scores of all words of many texts, with their context."""
    marked = strengths > Strengths.MARK / 2
    e = strengths - Strengths.MARK * marked + model.bias
    near = others_near(marked, lengths)
    e[marked] += model.context[2] * (near == 1) + model.context[3] * (near > 1)
    return e


def chain(odds: np.ndarray, lengths: np.ndarray, moves: tuple[float, float, float]) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward odds of every word of many texts at once; their product is the marginal odds.

    ``odds`` has exp(emission) of all texts, one after the other. Texts go in
    step, longest first, so the work is the words and not the padding.
    """
    t01, t10, t11 = (math.exp(x) for x in moves)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    forward, backward = odds.copy(), np.ones_like(odds)
    longest = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(1, longest + 1), side="right")
    for t in range(1, longest):
        at = starts[: active[t]] + t
        r = forward[at - 1]
        forward[at] = odds[at] * (t01 + t11 * r) / (1 + t10 * r)
    for t in range(longest - 2, -1, -1):
        at = starts[: active[t + 1]] + t
        r = odds[at + 1] * backward[at + 1]
        backward[at] = (t10 + t11 * r) / (1 + t01 * r)
    return forward, backward


def log_normaliser(forward: np.ndarray, lengths: np.ndarray, moves: tuple[float, float, float]) -> np.ndarray:
    """Per text the logarithm of the chain's normaliser; its negative is the log probability that no word is offending."""
    step = np.log1p(forward * math.exp(moves[1]))
    last = np.cumsum(lengths) - 1
    step[last] = np.log1p(forward[last])
    return np.add.reduceat(step, np.concatenate([[0], last[:-1] + 1]))


def _fit_chain(texts: list[list[str]], toxic: np.ndarray, odds_of: dict[str, float], steps: int = 120, rate: float = 0.2, ridge: float = 1e-3) -> Model:
    """Maximum penalised likelihood of the documents' labels by Adam; a feature's weight is drawn to its log odds.

    A text's label is whether any word is offending. With the probability q that
    none is, the gradient is (label - 1 + q) / (1 - q) times the expected counts
    of the offending states, which forward-backward gives.
    """
    features = list(odds_of)
    names = [*features, *CONTEXT]
    index = {f: i for i, f in enumerate(names)}
    lengths = np.array([len(t) for t in texts])
    of_text = np.repeat(np.arange(len(texts)), lengths)
    rows, cols, at, known = [], [], 0, {}
    marked = np.zeros(len(of_text), dtype=bool)
    for text in texts:
        for word in text:
            held = known.get(word)
            if held is None:
                own = [index[f] for f in word_features(word.lower()) if f in index]
                held = known[word] = (bool(own), own + [index[c] for c, on in zip(CONTEXT, shape(word), strict=False) if on])
            marked[at] = held[0]
            rows += [at] * len(held[1])
            cols += held[1]
            at += 1
    same = np.flatnonzero(of_text[1:] == of_text[:-1])
    near, spots = others_near(marked, lengths), np.flatnonzero(marked)
    one, more = spots[near == 1], spots[near > 1]
    rows = np.concatenate([np.array(rows, dtype=int), one, more])
    cols = np.concatenate([np.array(cols, dtype=int), np.full(len(one), index["!one_near"]), np.full(len(more), index["!more_near"])])
    k = len(names)
    prior = np.concatenate([list(odds_of.values()), np.zeros(len(CONTEXT)), [-8.0], np.zeros(3)])
    theta = prior.copy()
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        e = theta[k] + np.bincount(rows, weights=theta[cols], minlength=len(of_text))
        moves = tuple(theta[-3:])
        odds = np.exp(np.clip(e, -30, 30))
        f, b = chain(odds, lengths, moves)
        p = f * b / (1 + f * b)
        t01, t10, t11 = np.exp(moves)
        near = odds[same + 1] * b[same + 1]
        joint = np.stack([t01 * near, t10 * f[same], t11 * f[same] * near])
        joint = joint / (1 + joint.sum(axis=0))
        none = np.exp(-log_normaliser(f, lengths, moves))
        scale = ((toxic - 1 + none) / np.maximum(1 - none, 1e-9))[of_text]
        pull = np.concatenate([np.bincount(cols, weights=(scale * p)[rows], minlength=k), [(scale * p).sum()], (joint * scale[same]).sum(axis=1)])
        grad = pull / len(texts) - ridge * (theta - prior)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        theta[-3:] = np.clip(theta[-3:], -6, 6)
    return Model(dict(zip(features, theta[: len(features)].tolist(), strict=True)), tuple(float(x) for x in theta[len(features) : k]), float(theta[k]), tuple(float(x) for x in theta[-3:]))


def _fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4) -> tuple[float, float, float]:
    """Logistic regression by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    theta = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x / len(y) + ridge * np.eye(3), x.T @ (y - p) / len(y) - ridge * theta)
        theta += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(t) for t in theta)


def in_test_fold(doc_id: Column) -> Column:
    """The held-out third: crc32 of the id's text has remainder 1 by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, max_toxic: int, max_clean: int) -> DataFrame:
    """toxic, text, words of the sample; ids are chosen by hash, and only they are broadcast (at most both bounds)."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~in_test_fold(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = None
    for toxic, most in ((1, max_toxic), (0, max_clean)):
        part = known.where((F.col("toxic") != 0) == bool(toxic)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id", F.lit(toxic).alias("toxic"))
        chosen = part if chosen is None else chosen.unionAll(part)
    return docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")


def _one_of_copies(sample: DataFrame) -> DataFrame:
    def key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [shingle_set(t) for t in pdf["text"]]
            yield pdf.assign(copy_key=[int(s[0] >> np.uint64(1)) if len(s) else 0 for s in sets])

    return in_small_batches(sample).mapInPandas(key, "doc_id long, toxic int, text string, copy_key long").dropDuplicates(["copy_key", "toxic"])


def _portions(lengths: list[int], most: int = COUNTED_CHARS) -> Iterator[slice]:
    """Consecutive rows with about ``most`` characters of text; a longer text is a portion of its own."""
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > most:
            yield slice(start, i)
            start, held = i, 0
        held += n
    if lengths:
        yield slice(start, len(lengths))


def _count_features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for part in _portions([len(t) for t in pdf["text"]]):
            counts = (Counter(), Counter())
            for toxic, text in zip(pdf["toxic"][part], pdf["text"][part], strict=True):
                counts[toxic].update({f for w in set(_WORD.findall(text.lower())) for f in word_features(w)})
            names = [f for f in counts[1] | counts[0]]
            yield pd.DataFrame({"feature": names, "c1": [counts[1][f] for f in names], "c0": [counts[0][f] for f in names]})


def _candidate_features(sample: DataFrame, n1: int, n0: int) -> dict[str, float]:
    """Features that toxic documents of the sample have significantly more often, without those that another one stands for, and the log odds that each adds."""
    c1, c0 = F.col("c1"), F.col("c0")
    share = n1 / (n1 + n0)
    total = c1 + c0
    ratio = 2 * (c1 * F.log(c1 / (total * share)) + F.when(c0 > 0, c0 * F.log(c0 / (total * (1 - share)))).otherwise(0.0))
    odds = F.log((c1 + 0.5) / (n1 + 1)) - F.log((c0 + 0.5) / (n0 + 1))
    counted = sample.mapInPandas(_count_features, "feature string, c1 long, c0 long").groupBy("feature").agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0"))
    strong = counted.where(c1 > 0).withColumn("odds", odds).where((ratio >= LEAST_RATIO) & (F.col("odds") >= LEAST_ODDS))
    found = {r.feature: r for r in strong.select("feature", "c1", "odds").collect()}  # significant features of a bounded sample
    return _beyond({f: found[f].odds for f in _narrowest({f: r.c1 for f, r in found.items()})})


def _narrowest(counts: dict[str, int]) -> list[str]:
    """Without prefixes that give way to a longer one, or the word, that nearly all their documents have, and without suffixes of what remains."""
    stems = {f: n for f, n in counts.items() if not f.startswith("*")}
    most: dict[str, int] = {}  # per prefix, the most documents that one of its continuations has
    for f, n in stems.items():
        for g in word_features(f.rstrip("*")):
            if g != f and g in stems and g.endswith("*"):
                most[g] = max(most.get(g, 0), n)
    kept = [f for f, n in stems.items() if most.get(f, 0) < 0.95 * n]
    endings = tuple(f.rstrip("*") for f in stems)
    return sorted(kept) + sorted(f for f in counts if f.startswith("*") and not any(e.endswith(f[1:]) for e in endings))


def _beyond(odds: dict[str, float]) -> dict[str, float]:
    """What each feature adds to the log odds of the longest other prefix that covers it."""
    out = {}
    for f, own in odds.items():
        covers = [g for g in word_features(f.rstrip("*")) if g != f and g in odds and g.endswith("*")]
        out[f] = own - (odds[max(covers, key=len)] if covers and not f.startswith("*") else 0.0)
    return out


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Model:
    """Fit on labelled rows outside the held-out third; the label is the largest that a document has."""
    sample = materialize(_one_of_copies(_sample(docs, labels, max_toxic, max_clean)), "toxicity-sample")
    try:
        sizes = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
        n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
        features = _candidate_features(sample, n1, n0) if n1 and n0 else []
        if not features:
            return Model(constant=0.0 if n0 or not n1 else 1.0)
        words = F.size(F.split("text", r"\W+"))
        picked = None
        for toxic in (1, 0):
            part = sample.where((F.col("toxic") == toxic) & (words <= MAX_CHAIN_WORDS)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_CHAIN * (2 - toxic))
            picked = part if picked is None else picked.unionAll(part)
        rows = [(_WORD.findall(r.text), r.toxic) for r in picked.select("toxic", "text").collect()]  # at most 3 * MAX_CHAIN documents of bounded length
        rows = [r for r in rows if r[0]]
        model = _fit_chain([w for w, _ in rows], np.array([float(t) for _, t in rows]), features)
        rows = summarise(sample.select("toxic", "text"), model).select("toxic", "most", "total").collect()  # numbers of the bounded sample
        x = np.array([[r.most, math.log1p(r.total)] for r in rows])
        model.curve = _fit_curve(x, np.array([float(r.toxic) for r in rows]))
        return model
    finally:
        discard(sample)


def summarise(df: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """Add most and total (largest and summed marginal of a text's words) and spans (offsets of its offending words)."""

    strengths = Strengths(model)  # one per task, so that words are scored once

    def make(batch: pa.RecordBatch) -> list[list]:
        texts = [x.as_py() or "" for x in batch.column(batch.schema.get_field_index(text_col))]
        words = [_WORD.findall(t) for t in texts]
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        held = np.flatnonzero(lengths)
        most, total = np.zeros(len(texts)), np.zeros(len(texts))
        spans: list[list] = [[] for _ in texts]
        if len(held):
            own = np.fromiter((strengths[w] for text in words for w in text), dtype=float, count=int(lengths.sum()))
            forward, backward = chain(np.exp(np.clip(emissions(own, lengths[held], model), -30, 30)), lengths[held], model.moves)
            p = forward * backward / (1 + forward * backward)
            start = np.concatenate([[0], np.cumsum(lengths[held])[:-1]])
            most[held], total[held] = np.maximum.reduceat(p, start), np.add.reduceat(p, start)
            for i, a in zip(held, start, strict=True):
                if most[i] >= least:
                    spans[i] = [{"start": m.start(), "end": m.end(), "marginal": float(q)} for m, q in zip(_WORD.finditer(texts[i]), p[a : a + lengths[i]], strict=True) if q >= least]
        return [most, total, spans]

    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("marginal", T.DoubleType())]))
    arrow_span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))
    return map_batches(df, [("most", T.DoubleType()), ("total", T.DoubleType()), ("spans", span)], [pa.float64(), pa.float64(), arrow_span], make)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Add toxicity (0 to 1) and spans (start, end, marginal of every offending word) to every row.

    Null and empty texts count as having no offending word; repeated rows get
    equal results; an empty table gives an empty result. Offsets are in
    characters of the text. Very long texts are scored whole. Columns already
    named like the added ones are replaced, and columns named most and total,
    which the way there needs, are dropped. Where no label could teach anything, every row gets the model's
    constant and no spans.
    """
    if model.constant is not None:
        return docs.withColumn("toxicity", F.lit(float(model.constant))).withColumn("spans", F.array().cast("array<struct<start:int,end:int,marginal:double>>"))
    a, b, c = model.curve
    line = F.lit(a) + b * F.col("most") + c * F.log1p("total")
    return summarise(docs, model, text_col).withColumn("toxicity", 1 / (1 + F.exp(-line))).drop("most", "total")
