"""Importance resampling of documents towards a target text: hashed word n-grams, log-ratio weights, Gumbel draws.

1. Counting: every task lower-cases and blanks the bytes of its texts by one
   table, splits them into words, extends the crc32 of a word to those of its
   n-grams, and counts buckets in a Counter. Only bucket counts are shuffled.
2. Gains: one number per bucket, worked out on the driver from the bucket counts
   of both sides (BUCKETS rows, whatever the input) and sent to the tasks.
3. Weights: a second pass sums the gains of every text.
4. Draw: a score adds Gumbel noise from the document's id, so that the highest
   scores are a draw without replacement. Rows without texts are dealt by ranges
   of the score; places are counted range by range, so no task ranks all rows.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewrack.llm.tables import in_small_batches, map_batches, slices
from tidewrack.session import discard, materialize

#: Buckets of features, and the longest n-gram.
BUCKETS, LONGEST = 10_000, 3
#: Documents with fewer words are never drawn; of the others, so many of a hundred are.
LEAST_WORDS, PERCENT = 20, 5
#: The seed of the draw.
SEED = "42"

#: Bytes that are no letter, digit or part of a character outside ASCII become spaces, A to Z small letters.
TABLE = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def buckets_of(text: str | None) -> tuple[int, np.ndarray]:
    """Words of a text, and the bucket of each of its n-grams, repeats included."""
    words = (text or "").encode().translate(TABLE).split()
    spaced = [b" " + w for w in words]
    hashes = grams = list(map(zlib.crc32, words))
    for n in range(1, LONGEST):
        grams = list(map(zlib.crc32, spaced[n:], grams))  # the n-gram before, extended by a space and the next word
        hashes = hashes + grams
    return len(words), np.array(hashes, dtype=np.int64) % BUCKETS


def bucket_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """bucket, n: the features of all texts; at most BUCKETS rows, and as many from every task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[int] = Counter()
        for part in (part for batch in batches for part in slices(batch)):
            for x in part.column(0):
                total.update(buckets_of(x.as_py())[1].tolist())
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], names=["bucket", "n"])

    counted = in_small_batches(df.select(text_col)).mapInArrow(run, "bucket int, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text") -> np.ndarray:
    """The gain of every bucket: 1000 ln of its share of the target over its share of ``docs``, both smoothed, rounded down."""
    ours, theirs = ({r.bucket: r.n for r in bucket_counts(df, text_col).collect()} for df in (docs, target))  # BUCKETS rows each at most
    all_ours, all_theirs = sum(ours.values()), sum(theirs.values())
    ratios = ((float(theirs.get(b, 0) + 1) * float(all_ours + BUCKETS)) / (float(ours.get(b, 0) + 1) * float(all_theirs + BUCKETS)) for b in range(BUCKETS))
    return np.array([math.floor(1000 * math.log(x)) for x in ratios], dtype=np.int64)


def weigh(df: DataFrame, gain: np.ndarray, text_col: str = "text") -> DataFrame:
    """Add ``n_words``, ``n_features`` and ``weight`` (the sum of the gains of all features; 0 without any)."""

    def make(batch: pa.RecordBatch) -> list[list]:
        rows = [buckets_of(x.as_py()) for x in batch.column(batch.schema.get_field_index(text_col))]
        return [[n for n, _ in rows], [len(b) for _, b in rows], [int(gain[b].sum()) for _, b in rows]]

    added = [(n, T.LongType()) for n in ("n_words", "n_features", "weight")]
    return map_batches(df, added, [pa.int64()] * 3, make)


def score(weight: Column, doc_id: Column, seed: str = SEED) -> Column:
    """The weight plus 1000 times a Gumbel variable from the seed and the id (nothing for a null one), rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return weight + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _ranked(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """``scored`` with rank: the place of the drawn rows by score and then doc_id (nulls last), null for others."""
    spark = scored.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = [F.desc("able"), F.desc("score"), F.asc_nulls_last("doc_id")]
    able = scored.withColumn("able", F.col("n_words") >= least_words)
    # Stored, so that the ranges that the counts are of are those that the ranks are of.
    dealt = materialize(able.repartitionByRange(parts, *first).withColumn("range", F.spark_partition_id()), "resampling-ranges")
    sizes = sorted((r.range, r.n) for r in dealt.where("able").groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect())  # one row per range
    before, total = [], 0
    for part, n in sizes:
        before.append((part, total))
        total += n
    offsets = F.broadcast(spark.createDataFrame(before, "range int, before long"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy(*first))
    drawn = total * percent // 100
    return dealt.join(offsets, "range", "left").withColumn("rank", place).withColumn("rank", F.when(F.col("able") & (F.col("rank") <= drawn), F.col("rank"))).drop("able", "range", "before")


def report(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every row of ``docs`` (doc_id, text), for a draw towards the texts of ``target``.

    Of the documents of ``least_words`` words or more, ``percent`` in a hundred
    (rounded down) are drawn, those with the highest scores, ties to the smaller
    doc_id; rank counts them from 1 and is null for all others. Null, empty and
    wordless texts have no features and a weight of 0. Very long texts count
    whole. Rows with a null doc_id share one noise and come last among ties;
    rows with equal ids and texts are rows of their own with ranks one after the
    other. Other columns of either table play no part. An empty table gives an
    empty result; an empty target weighs by ``docs`` alone.
    """
    weighed = weigh(docs.select("doc_id", "text"), gains(docs, target)).drop("text")
    scored = materialize(weighed.withColumn("score", score(F.col("weight"), F.col("doc_id"), seed)), "resampling-scores")
    ranked = _ranked(scored, percent, least_words)
    return ranked.select("doc_id", "n_words", "n_features", "weight", "score", "rank")


def draw(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """The rows of ``docs`` that ``report`` draws, with all their columns, whatever their names; texts are not shuffled.

    The last drawn place is a score and a doc_id; rows at that place or before
    it are kept in a second pass over ``docs``. Rows that tie at it in both, so
    with equal ids and weights, stay together.
    """
    gain = gains(docs, target)
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    scored = weigh(docs.select(own, "doc_id", "text"), gain).withColumn("score", score(F.col("weight"), F.col("doc_id"), seed))
    narrow = materialize(scored.select("doc_id", "n_words", "score"), "resampling-scores")
    last = _ranked(narrow, percent, least_words).where("rank is not null").orderBy(F.desc("rank")).select("score", "doc_id").head(1)
    discard(narrow)
    if not last:
        return docs.limit(0)
    tied = (F.col("score") == last[0].score) & (F.lit(True) if last[0].doc_id is None else F.col("doc_id") <= last[0].doc_id)
    kept = scored.where((F.col("n_words") >= least_words) & ((F.col("score") > last[0].score) | tied))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
