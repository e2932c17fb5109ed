"""Connected components of an edge table by label propagation over joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.session import materialize


def connected_components(edges: DataFrame, label: str = "component") -> DataFrame:
    """Columns node and ``label``, the smallest node that a node can reach; ``edges`` has a and b.

    Alternates two steps until nothing changes: every node points its larger
    neighbours to the smallest one it sees, then its smaller neighbours too. The
    number of rounds grows with the logarithm of a component's diameter; each
    round is a table in the shared folder, so a lost executor costs one round at
    most. Nodes without edges are not in the result.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components")
    state = None
    while True:
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.bit_xor(F.xxhash64("v", "u")).alias("y")).first()
        if seen == state:  # the edges are stars, which the steps return
            break
        state = seen
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        nxt = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = materialize(nxt, "components")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias(label)).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias(label)).unionAll(roots)
