"""Kernels over fact tables of imports, exports and uses: repairs, unused imports, path claims, findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.functions import paths


def default_repairs(imports: DataFrame, providers: DataFrame, named: DataFrame, attached: DataFrame) -> DataFrame:
    """Named imports that mean a property of the provider's default export.

    ``imports`` has provider and name; ``providers`` one row per provider with
    export_all, has_default and default_object (whether its default export is a
    known object); ``named`` and ``attached`` have provider and name: the
    provider's named exports, and properties attached to its default export. A
    repair needs a default export and no ``export *``, a name that is no named
    export, and a known object or an attached property of that name.
    """
    usable = providers.where(~F.col("export_all") & F.col("has_default"))
    wanted = imports.join(usable.select("provider", "default_object"), "provider")
    missing = wanted.join(named.select("provider", "name").distinct(), ["provider", "name"], "left_anti")
    held = attached.select("provider", "name").distinct().withColumn("_attached", F.lit(True))
    return missing.join(held, ["provider", "name"], "left").where(F.col("default_object") | F.col("_attached")).select(imports.columns)


def used_only_as(uses: DataFrame, key: list[str], allowed: Column) -> DataFrame:
    """Keys of ``uses`` all of whose uses are allowed; the condition on which a namespace import is repaired."""
    return uses.groupBy(*key).agg(F.bool_and(F.coalesce(allowed, F.lit(False))).alias("_all")).where("_all").drop("_all")


def unused(imports: DataFrame, uses: DataFrame, key: list[str]) -> DataFrame:
    """Imports that no use mentions."""
    return imports.join(uses.select(*key).distinct(), key, "left_anti")


def path_claims(modules: DataFrame, path: Column) -> DataFrame:
    """path (lower case), claims: the public paths that more than one module claims, in any case."""
    return modules.groupBy(F.lower(path).alias("path")).agg(F.count(F.lit(1)).alias("claims")).where("claims > 1")


def planned_paths(modules: DataFrame, path: str, claims: Column | None = None) -> DataFrame:
    """``modules`` with public_path: where each that ``claims`` one (all, by default) stands among the others; null for the rest, and where there are fewer than two modules.

    Paths are normalised. The folder that all absolute ones share is taken off
    them, relative ones neither have a part in it nor lose anything but leading
    .. steps. Two modules that claim one path, in any case, are an error, and so
    is a path of which nothing is left.
    """
    told = modules.withColumn("_path", paths.normalise(F.col(path)))
    folder = F.regexp_extract("_path", r"\A(.*/)[^/]*\z", 1)
    # The common start of all folders is that of the smallest and the largest.
    ends = told.agg(F.count(F.lit(1)).alias("n"), *[f(F.when(F.col("_path").startswith("/"), folder)).alias(x) for f, x in ((F.min, "a"), (F.max, "b"))]).first()
    if ends.n < 2:
        return modules.withColumn("public_path", F.lit(None).cast("string"))
    low, high = ends.a or "", ends.b or ""
    same = next((i for i, (x, y) in enumerate(zip(low, high, strict=False)) if x != y), min(len(low), len(high)))
    root = low[:same].rfind("/") + 1
    absolute = F.col("_path").startswith("/")
    public = F.when(absolute, F.substr("_path", F.lit(root + 1))).otherwise(F.regexp_replace("_path", r"\A(\.\./?)+", ""))
    planned = told.withColumn("public_path", public if claims is None else F.when(claims, public)).drop("_path")
    claimed = planned.where("public_path is not null")
    clash = path_claims(claimed, F.col("public_path")).orderBy("path").first()
    if clash is not None:
        raise ValueError(f"{clash.claims} modules claim {clash.path!r}")
    empty = claimed.where("public_path = ''").first()
    if empty is not None:
        raise ValueError(f"no public path can be made of {empty[path]!r}")
    return planned


def lone_references(edges: DataFrame, reach: int = 3) -> DataFrame:
    """Pairs (a, b): b is referenced by a alone, and they stand at most ``reach`` apart."""
    single = edges.where("src <> dst").groupBy(F.col("dst").alias("b")).agg(F.min("src").alias("a"), F.max("src").alias("_high")).where("a = _high")
    return single.where(F.abs(F.col("a") - F.col("b")) <= reach).select("a", "b")


def missing_names(uses: DataFrame, exports: DataFrame, modules: DataFrame) -> DataFrame:
    """Uses (provider, name, ...) of a name that a known provider does not export.

    ``modules`` has provider and open; nothing is known to be missing from an
    open one, whose exports come in part from outside.
    """
    closed = modules.where(~F.col("open")).select("provider")
    return uses.join(closed, "provider", "left_semi").join(exports.select("provider", "name").distinct(), ["provider", "name"], "left_anti")


def illegal_writes(writes: DataFrame, bindings: DataFrame, key: list[str], kind: str = "kind") -> DataFrame:
    """Writes to bindings that are imports or constants, with the binding's kind."""
    return writes.join(bindings.where(F.col(kind).isin("import", "const")).select(*key, kind), key)
