"""Kernels over ranges and positions: coalescing, mapping through points, as-of lookups, bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _islands(df: DataFrame, key: list[str], start: str, end: str, parts: str) -> DataFrame:
    order = Window.partitionBy(*key).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0))
    island = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.sum(parts).alias("parts")).drop("_island")


def coalesce_ranges(df: DataFrame, key: list[str], start: str, end: str, width: int) -> DataFrame:
    """Ranges of each key merged where they overlap or touch; key, start, end, parts.

    Ranges are merged within buckets of ``width`` by their start first, so that
    a hot key is spread; what remains of each bucket is then merged over its edges.
    """
    dealt = df.withColumn("_bucket", F.floor(F.col(start) / width)).withColumn("_one", F.lit(1))
    within = _islands(dealt, [*key, "_bucket"], start, end, "_one").drop("_bucket")
    return _islands(within, key, start, end, "parts")


def range_join(points: DataFrame, ranges: DataFrame, key: str, at: str, start: str, end: str, width: int) -> DataFrame:
    """Points with the ranges [start, end) of their key that hold them.

    Both sides meet on (key, bucket of ``width``), so no key is compared whole;
    a range is repeated once per bucket that it covers.
    """
    spread = ranges.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width)))).where(F.col(end) > F.col(start))
    dealt = points.withColumn("_bucket", F.floor(F.col(at) / width))
    return dealt.join(spread, [key, "_bucket"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_bucket")


def map_points(hits: DataFrame, by: list[str], gen: str, src: str, end: str) -> DataFrame:
    """Source ranges of mapped points: from each point's source to the next one's, the last by what is left of its range."""
    nxt = F.lead(src).over(Window.partitionBy(*by).orderBy(gen, src))
    stop = F.coalesce(nxt, F.col(src) + F.col(end) - F.col(gen))
    return hits.withColumn("src_end", stop).where(F.col("src_end") > F.col(src))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, order: str, value: str, out: str, width: int) -> DataFrame:
    """Each left row with the value of the latest right row of its key at or before it (null if none).

    One union and one window per bucket of ``width``, so that a hot key is
    spread; a bucket's rows before its first right row take the last value of
    the buckets before. A right row at the same time counts, whatever the order
    of the two tables. ``left`` columns stay.
    """
    bucket = F.floor(F.col(at) / width).alias("_bucket")
    rows = left.select(F.struct(*left.columns).alias("_left"), F.col(key), F.col(at), bucket, F.lit(1).alias("_side"), F.lit(None).cast(right.schema[order].dataType).alias(order), F.lit(None).cast(right.schema[value].dataType).alias("_value"))
    seen = right.select(F.lit(None).cast(rows.schema["_left"].dataType).alias("_left"), F.col(key), F.col(at), bucket, F.lit(0).alias("_side"), F.col(order), F.col(value).alias("_value"))
    upto = Window.partitionBy(key, "_bucket").orderBy(at, "_side", order).rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.unionAll(seen).withColumn("_seen", F.last("_value", ignorenulls=True).over(upto)).where("_side = 1")
    lasts = rows.unionAll(seen).groupBy(key, "_bucket").agg(F.max_by("_value", F.when(F.col("_side") == 0, F.struct(at, order))).alias("_value"))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select(F.col(key).alias("_key"), F.col("_bucket").alias("_in"), F.last("_value", ignorenulls=True).over(before).alias("_carried"))
    joined = inside.join(carried, F.col(key).eqNullSafe(F.col("_key")) & F.col("_bucket").eqNullSafe(F.col("_in")), "left")
    return joined.select("_left.*", F.coalesce("_seen", "_carried").alias(out))


def nearest(points: DataFrame, anchors: DataFrame, key: str, at: str, anchor: str, out: str, width: int) -> DataFrame:
    """``points`` with ``out``: the ``anchor`` of their key at the least distance, of two the one before; of anchors at one place the smallest; null if the key has none.

    The last anchor at or before a point and the first one at or after it are
    two as-of lookups.
    """
    first = anchors.groupBy(key, at).agg(F.min(anchor).alias(anchor)).select(key, at, F.struct(F.col(at).alias("at"), F.col(anchor).alias("anchor")).alias("_anchor"))
    turned = lambda df: df.withColumn(at, -F.col(at))
    before = as_of(points, first, key, at, "_anchor", "_anchor", "_before", width)
    after = turned(as_of(turned(before), turned(first), key, at, "_anchor", "_anchor", "_after", width))
    gap = lambda c: F.abs(F.col(f"{c}.at") - F.col(at))
    chosen = F.when(F.col("_after").isNull() | (gap("_before") <= gap("_after")), F.col("_before")).otherwise(F.col("_after"))
    return after.select(*points.columns, chosen["anchor"].alias(out))


def band_pairs(df: DataFrame, key: str, position: str, reach: int, same: Column | None = None) -> DataFrame:
    """Pairs of rows of one key whose positions differ by 1 to ``reach``; columns of the second get the suffix _b.

    Positions are dealt into buckets of ``reach``, so a row meets its own bucket
    and the next one and not its whole key.
    """
    first = df.withColumn("_bucket", F.explode(F.array(F.floor(F.col(position) / reach), F.floor(F.col(position) / reach) + 1)))
    second = df.select([F.col(c).alias(f"{c}_b") for c in df.columns]).withColumn("_bucket_b", F.floor(F.col(f"{position}_b") / reach))
    gap = F.col(f"{position}_b") - F.col(position)
    pairs = first.join(second, (F.col(key) == F.col(f"{key}_b")) & (F.col("_bucket") == F.col("_bucket_b"))).where((gap >= 1) & (gap <= reach))
    pairs = pairs.drop("_bucket", "_bucket_b")
    return pairs if same is None else pairs.where(same)


def numbered(df: DataFrame, key: list[str], order: list[str], width: int, out: str) -> DataFrame:
    """``df`` with the number (from 1) of each row among those of its key, in ``order``, the first of which is a number.

    Rows are numbered within buckets of ``width`` of that number, and the
    buckets' sizes are added up, so that a hot key is spread.
    """
    dealt = df.withColumn("_bucket", F.floor(F.col(order[0]) / width))
    within = F.row_number().over(Window.partitionBy(*key, "_bucket").orderBy(*order))
    sizes = dealt.groupBy(*key, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy(*key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(*key, "_bucket", before.alias("_before"))
    return dealt.withColumn(out, within).join(starts, [*key, "_bucket"]).withColumn(out, F.col(out) + F.col("_before")).drop("_bucket", "_before")


def with_last_before(df: DataFrame, key: str, order: list[str], width: int, columns: list[str], suffix: str = "_before") -> DataFrame:
    """``df`` with the last value that is not null of each column in the rows of the key before, in ``order``, the first of which is a number.

    Windows run within buckets of ``width`` of that number; the last values of
    the buckets before are carried on bucket by bucket.
    """
    dealt = df.withColumn("_bucket", F.floor(F.col(order[0]) / width))
    inside = Window.partitionBy(key, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    lasts = dealt.groupBy(key, "_bucket").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in columns])
    carried = lasts.select(key, "_bucket", *[F.last(c, ignorenulls=True).over(across).alias(f"_carried_{c}") for c in columns])
    seen = dealt.select("*", *[F.last(c, ignorenulls=True).over(inside).alias(f"_seen_{c}") for c in columns]).join(carried, [key, "_bucket"])
    return seen.select(*df.columns, *[F.coalesce(f"_seen_{c}", f"_carried_{c}").alias(f"{c}{suffix}") for c in columns])


def with_running_sums(df: DataFrame, key: str, order: list[str], width: int, columns: list[str]) -> DataFrame:
    """``df`` with each column replaced by its sum over the rows of the key up to this one (nulls count nothing), in ``order``; bucketed like ``with_last_before``."""
    dealt = df.withColumn("_bucket", F.floor(F.col(order[0]) / width))
    inside = Window.partitionBy(key, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    sums = dealt.groupBy(key, "_bucket").agg(*[F.coalesce(F.sum(c), zero).alias(c) for c in columns])
    carried = sums.select(key, "_bucket", *[F.coalesce(F.sum(c).over(across), zero).alias(f"_carried_{c}") for c in columns])
    summed = dealt.select("*", *[F.coalesce(F.sum(c).over(inside), zero).alias(f"_sum_{c}") for c in columns]).join(carried, [key, "_bucket"])
    return summed.select(*[c for c in df.columns if c not in columns], *[(F.col(f"_sum_{c}") + F.col(f"_carried_{c}")).alias(c) for c in columns])
