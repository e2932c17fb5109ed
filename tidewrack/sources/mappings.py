"""The mappings of version 3 source maps as rows, and rows as mappings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.operators import ranges

#: The digits of Base64.
DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def vlq(segment: Column) -> Column:
    """The signed numbers that a segment writes as Base64 VLQ."""
    digits = F.transform(F.split(segment, ""), lambda c: F.instr(F.lit(DIGITS), c).cast("long") - 1)
    start = F.struct(F.lit(0).cast("long").alias("value"), F.lit(1).cast("long").alias("unit"), F.array().cast("array<long>").alias("done"))

    def step(state, digit):
        value = state["value"] + (digit % 32) * state["unit"]
        number = F.when(value % 2 == 1, -F.floor(value / 2)).otherwise(F.floor(value / 2))
        more = F.struct(value.alias("value"), (state["unit"] * 32).alias("unit"), state["done"].alias("done"))
        ended = F.struct(F.lit(0).cast("long").alias("value"), F.lit(1).cast("long").alias("unit"), F.concat(state["done"], F.array(number)).alias("done"))
        return F.when(digit >= 32, more).otherwise(ended)

    return F.aggregate(digits, start, step)["done"]


#: What a segment tells besides its column, in this order; these numbers run on over lines.
FIELDS = ("source", "source_line", "source_column", "name")
#: Lines of a map whose numbers are worked out together.
LINES = 1024


def mapping_rows(maps: DataFrame, key: str, mappings: str = "mappings", lines: int = LINES) -> DataFrame:
    """key, line, column, source, source_line, source_column, name of every segment, all from 0.

    Columns start anew on every generated line, the other numbers run on; a
    segment without a source or a name has null there. Sums run over ``lines``
    lines at a time, whose totals are then added up, so that a large map is
    spread. Null and empty mappings give no row.
    """
    split = maps.select(key, F.posexplode(F.split(mappings, ";")).alias("line", "_segments")).where("_segments <> ''")
    rows = split.select(key, "line", F.posexplode(F.split("_segments", ",")).alias("_place", "_segment")).select(key, "line", "_place", vlq(F.col("_segment")).alias("v"))
    in_line = Window.partitionBy(key, "line").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    deltas = rows.select(key, "line", "_place", F.size("v").alias("_size"), F.sum(F.get("v", F.lit(0))).over(in_line).alias("column"), *[F.get("v", F.lit(i)).alias(n) for i, n in enumerate(FIELDS, 1)])
    summed = ranges.with_running_sums(deltas, key, ["line", "_place"], lines, list(FIELDS))
    return summed.select(key, "line", "column", *[F.when(F.col("_size") > i, F.col(n)).alias(n) for i, n in enumerate(FIELDS, 1)])


def to_vlq(number: Column) -> Column:
    """A signed number of less than 34 bits as Base64 VLQ: its sign at the end, five bits a digit, the lowest first."""
    bits = F.when(number < 0, 1 - 2 * number).otherwise(2 * number)
    digits = []
    for i in range(7):
        rest, more = F.shiftright(bits, 5 * i), F.shiftright(bits, 5 * i + 5) > 0
        digit = F.substring(F.lit(DIGITS), (rest % 32 + F.when(more, 33).otherwise(1)).cast("int"), F.lit(1))
        digits.append(digit if i == 0 else F.when(rest > 0, digit).otherwise(F.lit("")))
    return F.concat(*digits)


def encode_mappings(rows: DataFrame, key: str, lines: int = LINES) -> DataFrame:
    """key, mappings: the text of version 3 source maps, the inverse of ``mapping_rows``.

    ``rows`` has the columns that ``mapping_rows`` gives, in any order; line and
    column are set and differ within a map, and a segment has all of source,
    source_line and source_column or none. The differences are taken over
    ``lines`` lines at a time; a map's text is one value, so its segments come
    together only as text.
    """
    numbers = rows.select(key, "line", F.col("column").cast("long").alias("column"), *[F.col(n).cast("long").alias(n) for n in FIELDS])
    in_line = Window.partitionBy(key, "line").orderBy("column")
    told = ranges.with_last_before(numbers, key, ["line", "column"], lines, list(FIELDS)).withColumn("_step", F.col("column") - F.coalesce(F.lag("column").over(in_line), F.lit(0)))
    parts = [to_vlq(F.col("_step"))] + [F.coalesce(to_vlq(F.col(n) - F.coalesce(f"{n}_before", F.lit(0))), F.lit("")) for n in FIELDS]
    texts = told.select(key, "line", "column", F.concat(*parts).alias("_text")).groupBy(key, "line")
    texts = texts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("column", "_text"))), lambda s: s["_text"]), ",").alias("_text"))
    # A semicolon for every line end since the last line that has segments.
    before = Window.partitionBy(key).orderBy("line")
    ends = texts.withColumn("_text", F.concat(F.repeat(F.lit(";"), (F.col("line") - F.coalesce(F.lag("line").over(before), F.lit(0))).cast("int")), F.col("_text")))
    return ends.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "_text"))), lambda s: s["_text"]), "").alias("mappings"))
