"""Incremental intake: files are detected once as they come, and the barrier stage runs as a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tidewrack.operators.keys import first_match, unmatched_policy


def detected(inputs: DataFrame, cases: list[tuple[str, Column]], policy: str = "process") -> DataFrame:
    """Add format and action to inputs with code; code of skipped inputs is released. Works on streams and tables."""
    kind = inputs.withColumn("format", first_match(cases))
    acted = kind.withColumn("action", unmatched_policy(F.col("format"), policy))
    return acted.withColumn("code", F.when(F.col("action") != "skip", F.col("code")))


def intake(
    spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, cases: list[tuple[str, Column]], policy: str = "process",
    barrier: Callable[[DataFrame], None] | None = None,
) -> StreamingQuery:
    """Detect all Parquet files that came since the last run, append them to ``target``, then call ``barrier`` on the whole of it.

    The checkpoint makes every file count once. A batch is written under its
    number, so a batch that runs again overwrites its own rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    query = detected(stream, cases, policy).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if barrier is not None:
        barrier(spark.read.parquet(target))
    return query
