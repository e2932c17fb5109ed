"""Kernels over exports: resolution through named, namespace and star re-exports, and the findings of a whole module graph.

Specifiers are resolved to modules first; from then on everything is keyed by
(module, name) and moves by joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.operators import keys
from tidewrack.session import Dealt, materialize

#: The binding that a namespace object counts as; no module can declare it.
NAMESPACE = "*namespace*"

_KEY = ["module", "name"]


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, parts)


def _expanded(front: DataFrame, shape: DataFrame, first: DataFrame) -> DataFrame:
    """module, name, unknown, origin, targets, as_name: what a (module, name) means by itself, and the modules that it is passed on to, under another name or (null) its own."""
    told = front.hint("shuffle_hash").join(first, _KEY, "left").join(shape, "module", "left")
    outside, explicit = F.col("open").isNull(), F.coalesce("explicit", F.lit(False))
    through_stars = ~outside & ~explicit & (F.col("name") != "default")
    origin = (
        F.when(outside | ~explicit, None)
        .when(F.col("target").isNull(), F.struct("module", F.col("binding").alias("binding")))
        .when(F.col("imported").isNull(), F.struct(F.col("target").alias("module"), F.lit(NAMESPACE).alias("binding")))
    )
    renamed = ~outside & explicit & F.col("target").isNotNull() & F.col("imported").isNotNull()
    onward = F.when(renamed, F.array("target")).when(through_stars, F.col("targets"))
    return told.select(*_KEY, (outside | (through_stars & F.col("open"))).alias("unknown"), origin.alias("origin"), onward.alias("targets"), F.when(renamed, F.col("imported")).alias("as_name"))


def _passed_on(steps: DataFrame, module: str, name: str) -> DataFrame:
    """The keys that those of ``steps`` are passed on to, as ``module`` and ``name``, besides their own."""
    return steps.select(F.col("module").alias("_module"), F.col("name").alias("_name"), F.explode("targets").alias(module), F.coalesce("as_name", "name").alias(name))


def resolve_exports(exports: DataFrame, stars: DataFrame, wanted: DataFrame, modules: DataFrame) -> DataFrame:
    """module, name, state (found, not_found, ambiguous, unknown), origin_module, origin_binding of every wanted export.

    ``exports`` has the explicit ones: module, name, place, target, imported,
    binding. Without a target they are the module's own ``binding``; with one,
    the ``imported`` name of the target, or its namespace object if that is
    null. Of several with one name the first place counts. ``stars`` has module
    and target (export * from; null: outside). An explicit export hides stars,
    and ``default`` never comes through one. What leads outside ``modules`` is
    unknown, which beats ambiguous; two origins are ambiguous, one origin on
    several ways is found. Ways that only lead back to where they began give
    nothing.

    Only keys that are asked for, or that these lead to, are looked at: a round
    follows all of them one step. What the last steps know then comes back as
    the least and the greatest origin, a step a round, until no key learns more.
    Exports, steps, links and what was learnt are dealt into buckets once, so a
    round shuffles its own rows and never the tables that it looks them up in.
    """
    spark = wanted.sparkSession
    inside = modules.select("module").distinct()
    target = inside.withColumnRenamed("module", "target")
    linked = stars.join(target, "target", "left_semi").groupBy("module").agg(F.collect_set("target").alias("targets"))
    open_ = stars.join(target, "target", "left_anti").select("module", F.lit(True).alias("open")).distinct()
    shape = inside.join(linked, "module", "left").join(open_, "module", "left")
    shape = materialize(shape.select("module", F.coalesce("open", F.lit(False)).alias("open"), "targets"), "star-exports")
    first = exports.groupBy(*_KEY).agg(F.min_by(F.struct("target", "imported", "binding"), F.struct("place", "target", "imported", "binding")).alias("x"))
    first = Dealt(spark, "explicit-exports", _KEY).add(first.select(*_KEY, F.lit(True).alias("explicit"), "x.*"))

    steps = Dealt(spark, "export-steps", _KEY)
    last = steps.add(_expanded(wanted.select(*_KEY).distinct(), shape, first))
    while not last.isEmpty():
        onward = _passed_on(last, *_KEY).select(*_KEY).distinct()
        seen = steps.all().select(*_KEY, F.lit(True).alias("_seen"))
        news = onward.hint("shuffle_hash").join(seen, _KEY, "left").where("_seen is null").select(*_KEY)
        last = steps.add(_expanded(news, shape, first))

    known = steps.all()
    to = ["to_module", "to_name"]
    links = _passed_on(known, *to).select(F.col("_module").alias("module"), F.col("_name").alias("name"), *to)
    links = Dealt(spark, "export-links", to).add(links.repartition(*to))
    learnt = Dealt(spark, "export-origins", _KEY)
    last = learnt.add(known.where("unknown or origin is not null").select(*_KEY, "unknown", F.col("origin").alias("low"), F.col("origin").alias("high")))

    while not last.isEmpty():
        news = last.select(F.col("module").alias("to_module"), F.col("name").alias("to_name"), "unknown", "low", "high")
        came = news.hint("shuffle_hash").join(links, to).groupBy(*_KEY).agg(F.max("unknown").alias("unknown"), F.min("low").alias("low"), F.max("high").alias("high"))
        held = learnt.all().select(*_KEY, F.col("unknown").alias("was"), F.col("low").alias("least"), F.col("high").alias("most"))
        both = came.hint("shuffle_hash").join(held, _KEY, "left").groupBy(*_KEY, "unknown", "low", "high").agg(F.max("was").alias("was"), F.min("least").alias("least"), F.max("most").alias("most"))
        more = (F.col("unknown") & ~F.col("was")) | (F.col("low") < F.col("least")) | (F.col("high") > F.col("most")) | (F.col("least").isNull() & F.col("low").isNotNull())
        last = learnt.add(both.where(F.col("was").isNull() | more).select(*_KEY, "unknown", "low", "high"))

    merged = learnt.all().groupBy(*_KEY).agg(F.max("unknown").alias("unknown"), F.min("low").alias("low"), F.max("high").alias("high"))
    rows = steps.round(1).select(*_KEY).join(merged, _KEY, "left")
    state = F.when(F.col("unknown"), "unknown").when(F.col("low") != F.col("high"), "ambiguous").when(F.col("low").isNotNull(), "found").otherwise("not_found")
    found = rows.select(*_KEY, state.alias("state"), "low")
    return found.select(*_KEY, "state", *(F.when(F.col("state") == "found", F.col("low")[c]).alias(f"origin_{c}") for c in ("module", "binding")))


def explicit_exports(exports: DataFrame, imports: DataFrame, targets: DataFrame) -> DataFrame:
    """The table that ``resolve_exports`` takes, from what modules say.

    ``exports`` has module, place, name, spec (null without ``from``), imported
    (null: the namespace) and binding; ``imports`` has module, local, spec and
    name (null: the namespace); ``targets`` has module, spec and resolved. An
    export of an imported binding means what the import means, also where that
    lies outside; ``from`` outside is an export of unknown making, but one.
    """
    source = imports.join(targets, ["module", "spec"], "left").groupBy("module", F.col("local").alias("binding"))
    source = source.agg(F.min(F.struct(F.coalesce("resolved", "spec").alias("target"), F.col("name").alias("imported"))).alias("_source"))
    rows = exports.join(targets, ["module", "spec"], "left").join(source, ["module", "binding"], "left")
    own = F.col("spec").isNull()
    return rows.select(
        "module", "name", "place",
        F.when(own, F.col("_source.target")).otherwise(F.col("resolved")).alias("target"),
        F.when(own, F.col("_source.imported")).when(F.col("resolved").isNotNull(), F.col("imported")).alias("imported"),
        F.when(own, F.col("binding")).otherwise(F.col("name")).alias("binding"),
    )


def graph_findings(
    modules: DataFrame, references: DataFrame, imports: DataFrame, exports: DataFrame, stars: DataFrame, writes: DataFrame, constants: DataFrame, free_uses: DataFrame
) -> DataFrame:
    """module, place, kind, detail: what would keep a set of modules from loading.

    * dangling_relative_ref: a relative specifier (``references`` has module,
      place, spec) that names no module, as written or with .js.
    * missing_imported_name: a named or default import, or a name that an export
      takes ``from`` a module, that the provider does not export or exports from
      two origins; unknown ones are let pass.
    * duplicate_export: the second export of a name.
    * assign_to_import, assign_to_const: ``writes`` (module, place, name) to an
      import's local, or else to one of ``constants`` (module, name).
    * esm_commonjs_residual: ``free_uses`` (module, place, name, probe) of module
      or exports, other than a bare typeof, where a module imports or exports.

    For the columns of the other tables see ``explicit_exports``; ``imports``
    has place too, ``stars`` module, place and spec.
    """
    specs = references.select("module", "spec").unionAll(imports.select("module", "spec")).unionAll(exports.select("module", "spec")).unionAll(stars.select("module", "spec"))
    files = modules.select(F.col("module").alias("file"))
    targets = materialize(keys.lookup_by_variants(specs.where("spec is not null").distinct(), files, "spec", "file", base="module", narrow=True), "specifiers")
    relative = F.col("spec").startswith("./") | F.col("spec").startswith("../")

    def finding(rows: DataFrame, kind: str, detail: str) -> DataFrame:
        return rows.select("module", "place", F.lit(kind).alias("kind"), F.col(detail).alias("detail"))

    gone = references.where(relative).join(targets.where("resolved is null"), ["module", "spec"], "left_semi")
    taken = imports.select("module", "place", "spec", "name").unionAll(exports.select("module", "place", "spec", F.col("imported").alias("name"))).where("name is not null")
    asked = taken.join(targets.where("resolved is not null"), ["module", "spec"]).select("module", "place", F.col("resolved").alias("provider"), "name")
    starred = stars.join(targets, ["module", "spec"], "left").select("module", F.col("resolved").alias("target"))
    found = resolve_exports(explicit_exports(exports, imports, targets), starred, asked.select(F.col("provider").alias("module"), "name"), modules)
    bad = found.where("state in ('not_found', 'ambiguous')").select(F.col("module").alias("provider"), "name", "state")
    missing = asked.join(bad, ["provider", "name"]).withColumn("detail", F.concat_ws(" ", "state", "name", "provider"))
    named = exports.groupBy("module", "name")
    twice = named.agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first")).where("n > 1").drop("n")
    # The second place: the first one again if two rows share it, else the least behind it.
    second = F.when(F.sum(F.when(F.col("place") == F.col("first"), 1).otherwise(0)) > 1, F.min("first")).otherwise(F.min(F.when(F.col("place") > F.col("first"), F.col("place"))))
    twice = exports.join(twice, ["module", "name"]).groupBy("module", "name").agg(second.alias("place"))
    locals_ = imports.select("module", F.col("local").alias("name"), F.lit("assign_to_import").alias("kind"))
    fixed = locals_.unionAll(constants.select("module", "name", F.lit("assign_to_const").alias("kind"))).groupBy("module", "name").agg(F.max("kind").alias("kind"))
    illegal = writes.join(fixed, ["module", "name"]).select("module", "place", "kind", F.col("name").alias("detail"))
    esm = imports.select("module").unionAll(exports.select("module")).unionAll(stars.select("module")).distinct()
    left = free_uses.where(F.col("name").isin("module", "exports") & ~F.col("probe")).join(esm, "module", "left_semi")
    return _union([
        finding(gone, "dangling_relative_ref", "spec"), finding(missing, "missing_imported_name", "detail"), finding(twice, "duplicate_export", "name"),
        illegal, finding(left, "esm_commonjs_residual", "name"),
    ])
