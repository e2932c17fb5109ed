"""Kernels over keys: first match, unique maps, agreement, renames, suffixes, lookups, division."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewrack.functions import paths


def first_match(cases: list[tuple[str, Column]], otherwise: str = "plain") -> Column:
    """The name of the first predicate that holds, in the given order."""
    out: Column | None = None
    for name, predicate in cases:
        out = F.when(predicate, name) if out is None else out.when(predicate, name)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def unmatched_policy(kind: Column, policy: str) -> Column:
    """What becomes of an input: unpack if a detector matched, else skip, process, preserve or error."""
    if policy not in ("skip", "process", "preserve", "error"):
        raise ValueError(f"unknown policy {policy!r}")
    return F.when(kind != "plain", "unpack").otherwise(policy)


def unique_map(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys that occur once, with their value; a key that two rows claim maps to nothing."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max(value).alias(value)).where("_n = 1").drop("_n")


def agree_or_drop(df: DataFrame, key: str, hint: str, least: int = 1) -> DataFrame:
    """Keys with ``least`` rows or more whose hints all agree but for case; the smallest spelling stands."""
    found = df.where(F.col(hint).isNotNull()).groupBy(key)
    found = found.agg(F.count(F.lit(1)).alias("_n"), F.min(F.lower(hint)).alias("_lo"), F.max(F.lower(hint)).alias("_hi"), F.min(hint).alias(hint))
    return found.where((F.col("_n") >= least) & (F.col("_lo") == F.col("_hi"))).select(key, hint)


def rename_map(names: DataFrame, current: str, target: str, reserved: DataFrame | None = None) -> DataFrame:
    """Renames that are safe: a target claimed once, that no current name equals, that is not reserved in any case, and that changes the name."""
    single = names.groupBy(F.col(target).alias("_single")).agg(F.count(F.lit(1)).alias("_claims")).where("_claims = 1").drop("_claims")
    kept = names.where(F.col(target) != F.col(current)).join(single, F.col(target) == F.col("_single"), "left_semi")
    taken = names.select(F.col(current).alias("_taken")).distinct()
    kept = kept.join(taken, F.col(target) == F.col("_taken"), "left_anti")
    if reserved is not None:
        words = reserved.select(F.lower(reserved.columns[0]).alias("_reserved")).distinct()
        kept = kept.join(words, F.lower(target) == F.col("_reserved"), "left_anti")
    return kept


#: A name's stem and its extension, as in a/b.js; a leading dot is no extension.
_EXTENDED = r"(?s)\A(.*[^/])(\.[^./]+)\z"


def _stem(name: Column) -> Column:
    return F.when(name.rlike(_EXTENDED), F.regexp_extract(name, _EXTENDED, 1)).otherwise(name)


def _extension(name: Column) -> Column:
    return F.regexp_extract(name, _EXTENDED, 2)


def _suffixed(name: Column, number: Column, extension: str) -> Column:
    own = _extension(name)
    return F.concat(_stem(name), F.lit("_"), number.cast("string"), F.when(own == "", extension).otherwise(own))


def suffix_duplicates(df: DataFrame, name: str, order: list[str], out: str = "unique_name", extension: str = "") -> DataFrame:
    """The first of equal names (any case) keeps it, later ones get _2, _3 and so on before their extension, or before ``extension`` if they have none.

    The suffixes are right where no given name looks like a suffixed one;
    ``suffix_collisions`` counts the names for which that fails.
    """
    rank = F.row_number().over(Window.partitionBy(F.lower(name)).orderBy(*order))
    return df.withColumn("_k", rank).withColumn(out, F.when(F.col("_k") == 1, F.col(name)).otherwise(_suffixed(F.col(name), F.col("_k"), extension))).drop("_k")


def unique_suffixes(df: DataFrame, name: str, order: list[str], out: str = "unique_name", extension: str = "", reserved: DataFrame | None = None) -> DataFrame:
    """Rows in ``order`` take their name or its first suffix _2, _3 and so on that no earlier row took, in any case.

    Suffixes go before the extension, or before ``extension`` where a name has
    none. The names of ``reserved`` (one column) are taken from the start.

    A name can only meet names with the same root, that is without its stem's
    trailing numbers. Where all names of a root are equal, or none occurs twice,
    and none is reserved, ranks are right. The rows of other roots are taken in
    order, root by root, in a stream that remembers the names of one root; the
    root is the unit of parallel work.
    """

    def root(of: Column) -> Column:
        own = _extension(F.lower(of))
        return F.concat(F.regexp_replace(_stem(F.lower(of)), r"(_[0-9]+)+\z", ""), F.when(own == "", extension).otherwise(own))

    spellings = df.where(F.col(name).isNotNull()).groupBy(root(F.col(name)).alias("_root"), F.lower(name).alias("_name")).agg(F.count(F.lit(1)).alias("_n"))
    mixed = spellings.groupBy("_root").agg(F.count(F.lit(1)).alias("_names"), F.max("_n").alias("_most")).where("_names > 1 and _most > 1").select("_root")
    seeds = None
    if reserved is not None:
        seeds = reserved.select(F.lower(reserved.columns[0]).alias("_lower")).where("_lower is not null").distinct()
        mixed = mixed.unionAll(seeds.select(root(F.col("_lower")).alias("_root"))).distinct()
    marked = df.withColumn("_root", root(F.col(name)))
    plain = suffix_duplicates(marked.join(mixed, "_root", "left_anti"), name, order, out, extension).drop("_root")
    schema = T.StructType([*(f for f in df.schema if f.name != out), T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, taken, last = None, set(), {}

        def named(text: str, cut: int, k: int) -> str:
            after = len(text) - cut
            return text if k == 1 else f"{text[:after]}_{k}{text[after:] or extension}"

        for batch in batches:
            of, lower, own, cuts, seed = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("_root", "_lower", "_own", "_cut", "_seed"))
            found = []
            for i, x in enumerate(lower):
                if of[i] != at:
                    at, taken, last = of[i], set(), {}
                if seed[i]:
                    taken.add(x)
                    continue
                k = last.get(x, 0) + 1
                while named(x, cuts[i], k).lower() in taken:
                    k += 1
                last[x] = k
                taken.add(named(x, cuts[i], k).lower())
                found.append(named(own[i], cuts[i], k))
            rows = batch.filter(pa.array([not s for s in seed]))
            yield pa.RecordBatch.from_arrays([*(rows.column(rows.schema.get_field_index(n)) for n in schema.names[:-1]), pa.array(found, pa.string())], names=schema.names)

    rows = marked.join(mixed, "_root", "left_semi").withColumn("_lower", F.lower(name)).withColumn("_own", F.col(name)).withColumn("_cut", F.length(_extension(F.col(name)))).withColumn("_seed", F.lit(False))
    if seeds is not None:
        rows = rows.unionByName(seeds.withColumn("_root", root(F.col("_lower"))).withColumn("_seed", F.lit(True)), allowMissingColumns=True)
    taken_in_order = rows.repartition("_root").sortWithinPartitions("_root", F.desc("_seed"), *order).mapInArrow(run, schema)
    return plain.select(schema.names).unionByName(taken_in_order)


def suffix_collisions(df: DataFrame, unique: str = "unique_name") -> DataFrame:
    """Names that two rows have after suffixing, in any case."""
    return df.groupBy(F.lower(unique).alias("name")).count().where("count > 1")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has, with the number of rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def first_declared(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; later declarations of it go."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def dangling(references: DataFrame, declared: DataFrame, on: Column) -> DataFrame:
    """References that nothing declares."""
    return references.join(declared, on, "left_anti")


def prune_stale(exports: DataFrame, declared: DataFrame, keys: list[str]) -> DataFrame:
    """Exports whose local name is still declared."""
    return exports.join(declared.select(*keys).distinct(), keys, "left_semi")


def all_exported(uses: DataFrame, exports: DataFrame, group: str, provider: str, name: str) -> DataFrame:
    """Groups whose every used name is among the provider's exports (relational division).

    ``uses`` has group, provider and name; ``exports`` provider and name. One
    missing name rules a group out, so only groups with a miss are anti-joined.
    """
    known = exports.select(provider, name).distinct()
    missing = uses.join(known, [provider, name], "left_anti").select(group).distinct()
    return uses.select(group).distinct().join(missing, group, "left_anti")


def plurality(votes: DataFrame, key: list[str], name: str) -> DataFrame:
    """The name that most rows of a key vote for, ties to the smallest; key, name, votes."""
    counted = votes.groupBy(*key, name).agg(F.count(F.lit(1)).alias("votes"))
    least_first = Window.partitionBy(*key).orderBy(F.desc("votes"), F.col(name))
    return counted.withColumn("_k", F.row_number().over(least_first)).where("_k = 1").drop("_k")


def lookup_by_variants(specifiers: DataFrame, facts: DataFrame, spec: str, key: str, base: str | None = None, narrow: bool = False) -> DataFrame:
    """Every specifier with the key that its best variant finds, or null, as ``resolved``.

    With ``base``, the column of the importing file, a relative specifier means a
    path from there first, and only where that finds nothing the text as
    written. Variants in order: the name itself; with .js, then .jsx, if it has
    no script extension; without .js, then without .jsx. With ``narrow`` there
    are only the path from the file as it is and with .js. One join on the
    exploded variants, then the least (stage, priority) of each specifier.
    """
    options = []
    if base is not None:
        path = paths.resolve_relative(F.replace(F.col(base), F.lit("\\"), F.lit("/")), F.col(spec))
        options += [(path, None), (F.concat(path, F.lit(".js")), None)] if narrow else _variants(path)
    if base is None or not narrow:
        options += _variants(F.regexp_replace(spec, r"^\./", ""))
    tried = F.filter(F.array(*[F.struct(F.lit(i).alias("prio"), (name if when is None else F.when(when, name)).alias("name")) for i, (name, when) in enumerate(options)]), lambda x: x["name"].isNotNull())
    of = [spec] if base is None else [base, spec]
    exploded = specifiers.select(*of).distinct().select(*of, F.explode(tried).alias("o"))
    hits = exploded.join(facts.select(F.col(key).alias("_key")).distinct(), F.col("o.name") == F.col("_key"))
    best = hits.groupBy(*of).agg(F.min_by("_key", "o.prio").alias("resolved"))
    return specifiers.join(best, of, "left")


def _variants(name: Column) -> list[tuple[Column, Column | None]]:
    """Names to try in order, each with the condition on which it is tried."""
    bare = ~name.rlike(r"\.(js|jsx|mjs|cjs|ts|tsx)$")
    return [
        (name, None), (F.concat(name, F.lit(".js")), bare), (F.concat(name, F.lit(".jsx")), bare),
        (F.regexp_replace(name, r"\.js$", ""), name.endswith(".js")), (F.regexp_replace(name, r"\.jsx$", ""), name.endswith(".jsx")),
    ]
