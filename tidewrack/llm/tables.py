"""Reading the corpus tables and small schema helpers."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that separate words: the space and \x09 to \x0D, everywhere in this folder.
WORD_SEPARATORS = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name``; any path that Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_fields(schema: T.StructType, *added: tuple[str, T.DataType]) -> T.StructType:
    """``schema`` with ``added`` at its end; a column of the same name (any case) is replaced."""
    names = {n.lower() for n, _ in added}
    return T.StructType([f for f in schema if f.name.lower() not in names] + [T.StructField(n, t) for n, t in added])


_LIBC = ctypes.CDLL(None)

#: Bytes of an Arrow batch between Spark and Python, where the session sets no size itself.
BATCH_BYTES = 8 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of text on which a Python task works at once, about; a longer text is a slice of its own.
SLICE_BYTES = 2 << 20


def slices(batch: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about ``most`` bytes of strings and binaries, so that memory follows texts and not rows."""
    sizes = np.ones(batch.num_rows, dtype=np.int64)
    for column in batch.columns:
        if any(is_kind(column.type) for is_kind in (pa.types.is_string, pa.types.is_large_string, pa.types.is_binary, pa.types.is_large_binary)):
            sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def release() -> None:
    """Give back what a Python task no longer needs, as its worker lives on beside the next stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df`` for a Python task: the session's Arrow batches are bounded by BATCH_BYTES from here on, as a task holds some at once."""
    if df.sparkSession.conf.get(_BATCH_SETTING, "1").rstrip("b") == "1":  # not set
        df.sparkSession.conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    return df


def map_batches(df: DataFrame, added: list[tuple[str, T.DataType]], arrow: list[pa.DataType], make: Callable[[pa.RecordBatch], list[list]]) -> DataFrame:
    """Add columns computed slice by slice in Python; the other columns pass through untouched."""
    schema = with_fields(df.schema, *added)
    keep = [f.name for f in schema][: len(schema) - len(added)]
    names = [n for n, _ in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                new = make(part)
                columns = [part.column(part.schema.get_field_index(n)) for n in keep] + [pa.array(v, type=t) for v, t in zip(new, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=keep + names)
        release()

    return in_small_batches(df).mapInArrow(run, schema)


#: Rows of a broadcast filter, each a word of 64 slots; it never has more rows than this, whatever the input.
WORDS = 1 << 18


def _place(key: Column, words: int) -> tuple[Column, Column]:
    """The word of a key's slot, and its bit."""
    slot = F.pmod(key, F.lit(64 * words))
    return F.floor(slot / 64), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int"))


def _held(wanted: DataFrame, wanted_key: Column, words: int) -> DataFrame:
    word, bit = _place(wanted_key, words)
    return F.broadcast(wanted.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits")))


def maybe_in(df: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column, words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` whose key can be among the wanted keys, and the rest, without a shuffle of ``df``.

    Keys are longs. Only which of 64 * ``words`` slots they take is broadcast, as
    bits of at most ``words`` integers; with very many keys every row is in the
    first part, and nothing is lost.
    """
    held = _held(wanted, wanted_key, words)
    word, bit = _place(key, words)
    hit = (word == F.col("_word")) & (F.col("_bits").bitwiseAND(bit) != 0)
    return df.join(held, hit, "left_semi"), df.join(held, hit, "left_anti")


def with_maybe(df: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column, out: str, words: int = WORDS) -> DataFrame:
    """Add ``out``: whether the key can be among the wanted keys, told as by ``maybe_in``; for uses that need both kinds of rows."""
    word, bit = _place(key, words)
    marked = df.join(_held(wanted, wanted_key, words), word == F.col("_word"), "left")
    return marked.withColumn(out, F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))).drop("_word", "_bits")
