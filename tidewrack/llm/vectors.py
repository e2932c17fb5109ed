"""What the two vector searches share: which rows take part, and the merge of partial results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Every row whose id is divisible by this is a query.
QUERY_STEP = 50


def finite_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Columns vec_id (long) and v (array of doubles): the rows that can be compared, each distinct row once.

    Rows with a null id, a null or empty vector, or a null or non-finite
    component take no part.
    """
    v = F.col(vector_col).cast("array<double>")
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & usable).dropDuplicates(["vec_id", "v"])


def best(partial: DataFrame, key: list[str], k: int, score: Column) -> DataFrame:
    """The ``k`` best rows of each key by score, ties to the smaller id, with ``rank`` from 1.

    Spark limits the groups before the shuffle too, so at most k rows of a key
    leave a task.
    """
    order = Window.partitionBy(*key).orderBy(score.desc(), F.col("vec_id"))
    return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
