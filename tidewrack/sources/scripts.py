"""Sources: files of scripts, inline scripts of pages, and the sources that a map embeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewrack.session import materialize

SCRIPT_FILES = r"(?i)\.(js|mjs|cjs)$"
CHECKED_FILES = r"(?i)(\.(js|mjs|cjs|jsx|ts|tsx|mts|cts)|/[^/.]+)$"


def script_files(spark: SparkSession, root: str, pattern: str = SCRIPT_FILES, skip_modules: bool = True) -> DataFrame:
    """input_id, filename, code of the script files under ``root``, without hidden ones and, if asked, without node_modules.

    Ids follow the order of the paths; they come from ranks within path ranges,
    so no task numbers all files.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    kept = files.where(F.col("path").rlike(pattern) & ~F.col("path").rlike(r"/\.[^/]+"))
    if skip_modules:
        kept = kept.where(~F.col("path").contains("/node_modules/"))
    return with_ids(kept.select(F.col("path").alias("filename"), F.col("content").cast("string").alias("code")), "filename", "input_id")


def with_ids(df: DataFrame, order: str, out: str) -> DataFrame:
    """Dense ids from 0 in the order of a column that is unique: ranges of it are stored, and a row's id is its place in its range after the rows of the ranges before."""
    ranged = materialize(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "ranges")
    # One row per range.
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return ranged.withColumn("_pos", place).join(F.broadcast(starts), "_part").select((F.col("_pos") + F.col("_before")).alias(out), *df.columns)


def inline_scripts(pages: DataFrame) -> DataFrame:
    """page_id, script_idx, code: the bodies of script elements; a body ends at </script only, as raw text does."""
    bodies = F.regexp_extract_all("html", F.lit(r"(?is)<script[^>]*>(.*?)</script"), 1)
    return pages.select("page_id", F.posexplode(bodies).alias("script_idx", "code"))


def embedded_sources(maps: DataFrame, map_col: str = "source_map") -> DataFrame:
    """filename, content of every source that a version 3 source map carries; null contents and unsafe paths are left out."""
    parsed = F.from_json(F.col(map_col), "version int, sourceRoot string, sources array<string>, sourcesContent array<string>, names array<string>, mappings string")
    pairs = maps.select(F.explode(F.arrays_zip(parsed["sources"].alias("filename"), parsed["sourcesContent"].alias("content"))).alias("s"))
    return pairs.select("s.filename", "s.content").where(F.col("content").isNotNull() & is_safe_path(F.col("filename")))


def is_safe_path(path: Column) -> Column:
    """Relative, not empty, and without a step to a parent."""
    return path.isNotNull() & (path != "") & ~path.startswith("/") & ~path.rlike(r"(^|/)\.\.(/|$)")
