"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read as the next one's input.

Every stage takes null and repeated ids, null, empty and very long texts,
repeated rows, an empty table and extra columns of any name; its docstring says
what becomes of them. Columns that a stage computes never replace those of
``documents``, but for n_chars, which follows the text, and those that the last
stage adds.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.llm import bpe, line_dedup, mixing, ngram_join, toxicity
from tidewrack.llm.registry import RANK_FILE
from tidewrack.llm.tables import table
from tidewrack.session import materialize

#: Two stages train a model or draw a mix, which SQL cannot express; tests compare the stages with brute force.
ORACLE_SQL = None
#: What the last stage adds.
ADDED = ("n_tokens", "token_ids", "ids_sha256", "decoded_sha256")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; all others stay as they are, null and empty texts among them.

    Rows are judged by their text alone, so repeated rows and null ids fare alike.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    own = [f"_column{i}" for i in range(len(docs.columns))]
    text = own[[c.lower() for c in docs.columns].index("text")]
    kept = toxicity.score(docs.toDF(*own), model, text).where(F.col("toxicity") < toxicity.THRESHOLD)
    return kept.select(own).toDF(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier line go; every document stays, and n_chars follows its text.

    Null texts stay null. Rows of one id and text lose the same lines; null ids come last in the order of lines.
    """
    clean = line_dedup.dedup_lines(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays.

    Null and wordless texts stay. Rows decide and not ids, so another text under the id of a copy stays.
    """
    return ngram_join.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; those without words are never taken.

    A null source is a source of its own. Repeated rows stand and fall together.
    """
    return mixing.taken_rows(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of ``docs`` but for text, with n_tokens, token_ids, ids_sha256 and decoded_sha256; columns already named like these are replaced.

    Null and empty texts have no ids. Every row stays, repeated ones too.
    """
    path, pattern = public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN
    own = [c for c in docs.columns if c.lower() not in ("text", *ADDED)]
    packed = docs.select(F.struct(F.lit(0), *[F.col(f"`{c}`") for c in own]).alias("row"), "text")
    encoded = bpe.encode(packed, path, pattern).drop("text")
    decoded = bpe.decode(encoded, path, pattern).withColumn("ids_sha256", F.sha2("token_ids", 256)).withColumn("decoded_sha256", F.sha2("decoded", 256))
    return decoded.select(*[F.col("row").getField(c).alias(c) for c in own], *ADDED)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
