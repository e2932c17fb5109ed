"""Renames by source maps: tokens of identifiers, votes of bindings, numbers for those that share a name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.functions import names
from tidewrack.operators import keys, ranges

#: An identifier of ASCII letters at the start of a text.
_WORD = r"^[A-Za-z_$][A-Za-z0-9_$]*"
#: Columns of a line, and positions of declarations, that are looked at together.
WIDTH = 1 << 14


def original_names(identifiers: DataFrame, tokens: DataFrame, names_of: DataFrame, lines: DataFrame, width: int = WIDTH) -> DataFrame:
    """``identifiers`` (module, line, column, ...) with original: the name that the last token at or before each of them tells, or null.

    ``tokens`` has module, line, column, source, source_line, source_column and
    name (a number or null), ``names_of`` module, number and text, ``lines``
    module, source, source_line and text. A token without a name, or with an
    empty one, tells the identifier that its source has at that place.
    """
    at = lambda df: df.withColumn("_at", F.shiftleft(F.col("line").cast("long"), 32) + F.col("column"))
    place = F.struct("source", "source_line", "source_column", "name")
    known = at(tokens).select("module", "_at", place.alias("_token"))
    found = ranges.as_of(at(identifiers), known, "module", "_at", "_token", "_token", "_token", width)
    texts = names_of.select(F.col("module").alias("_in"), F.col("number").alias("_number"), F.col("text").alias("_name"))
    named = found.join(texts, (F.col("module") == F.col("_in")) & (F.col("_token.name") == F.col("_number")), "left")
    sources = lines.select(F.col("module").alias("_of"), F.col("source").alias("_source"), F.col("source_line").alias("_line"), F.col("text").alias("_text"))
    read = named.join(sources, (F.col("module") == F.col("_of")) & (F.col("_token.source") == F.col("_source")) & (F.col("_token.source_line") == F.col("_line")), "left")
    word = F.nullif(F.regexp_extract(F.substr("_text", F.col("_token.source_column").cast("int") + 1), _WORD, 0), F.lit(""))
    return read.select(*identifiers.columns, F.coalesce(F.nullif(F.col("_name"), F.lit("")), word).alias("original"))


def source_map_renames(identifiers: DataFrame, bindings: DataFrame, tokens: DataFrame, names_of: DataFrame, lines: DataFrame, width: int = WIDTH) -> DataFrame:
    """module, binding, old, new: the bindings that take another name.

    ``identifiers`` has module, binding, line and column of every mention of a
    binding (free names have none and take no part); ``bindings`` has module,
    binding, symbol, top (declared at module level) and declared (a number, its
    place). Every mention votes for its original name, unless that is the symbol
    itself or cannot name a binding; the name with most votes wins, ties to the
    smallest. Bindings of inner scopes take it as it is. Of those at module
    level the first declared one does, and the others get _2, _3 and so on.
    """
    said = original_names(identifiers.select("module", "binding", "line", "column"), tokens, names_of, lines, width)
    symbols = bindings.select("module", "binding", "symbol", "top", "declared")
    votes = said.where(F.col("original").isNotNull() & names.is_identifier(F.col("original"))).join(symbols, ["module", "binding"]).where("original <> symbol")
    won = keys.plurality(votes, ["module", "binding"], "original").drop("votes").join(symbols, ["module", "binding"])
    inner = won.where("not top").select("module", "binding", F.col("symbol").alias("old"), F.col("original").alias("new"))
    top = ranges.numbered(won.where("top"), ["module", "original"], ["declared", "binding"], width, "_k")
    new = F.when(F.col("_k") == 1, F.col("original")).otherwise(F.concat_ws("_", "original", F.col("_k").cast("string")))
    return inner.unionAll(top.select("module", "binding", F.col("symbol").alias("old"), new.alias("new")).where("new <> old"))
