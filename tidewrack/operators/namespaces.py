"""Namespace imports turned into named ones: which names an importer gives, and when it keeps the namespace."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.functions import names
from tidewrack.operators import keys
from tidewrack.session import materialize

_TEXTS = "array<string>"
_PROPS = "array<struct<exported:string,local:string,aliased:boolean>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _alias(prop: Column, taken: Column, added: Column) -> Column:
    """The first of prop_1, prop_2 and so on that is neither among the bindings that look like it nor among the names given so far."""
    tries = F.transform(F.sequence(F.lit(1), F.size(taken) + F.size(added) + 1), lambda i: F.concat(prop, F.lit("_"), i.cast("string")))
    return F.filter(tries, lambda x: ~F.array_contains(taken, x) & ~F.array_contains(added, x))[0]


def _with_prop(state: Column, prop: Column, own: Column) -> Column:
    """The state of an import after one more property: what was added to the module, what this import inserted, and its properties."""
    name, taken, there = prop["name"], prop["taken"], prop["reused"]
    bound = F.array_contains(taken, name) | F.array_contains(state["added"], name)
    clash = there.isNull() & (name != own) & (bound | prop["reserved"])
    given = F.struct(
        F.coalesce(there, F.when(clash, _alias(name, taken, state["added"])).otherwise(name)).alias("local"), clash.alias("aliased"),
        (there.isNull() & (clash | ~bound)).alias("fresh"),
    )

    def after(g: Column) -> Column:
        more = F.when(g["fresh"], F.array(g["local"])).otherwise(F.array().cast(_TEXTS))
        return F.struct(
            F.concat(state["added"], more).alias("added"),
            F.concat(state["inserted"], more).alias("inserted"),
            F.concat(state["props"], F.array(F.struct(name.alias("exported"), g["local"].alias("local"), g["aliased"].alias("aliased")))).alias("props"),
            (state["fresh"] + there.isNull().cast("int")).alias("fresh"),
        )

    return _let(given, after)


def _with_import(state: Column, one: Column) -> Column:
    """The state of a module after one more import, with the back-off where most new names would be aliases."""
    nothing = F.array()
    start = F.struct(state["added"].alias("added"), nothing.cast(_TEXTS).alias("inserted"), nothing.cast(_PROPS).alias("props"), F.lit(0).alias("fresh"))

    def after(done: Column) -> Column:
        too_many = (done["fresh"] > 1) & (2 * F.size(F.filter(done["props"], lambda p: p["aliased"])) > done["fresh"])
        clean = lambda p: ~p["aliased"] & (p["local"] != one["local"])
        freed = F.array_intersect(F.transform(F.filter(done["props"], lambda p: ~clean(p)), lambda p: p["local"]), done["inserted"])
        row = F.struct(one["import_id"].alias("import_id"), F.when(too_many, F.filter(done["props"], clean)).otherwise(done["props"]).alias("props"), too_many.alias("keeps"))
        return F.struct(F.when(too_many, F.array_except(done["added"], freed)).otherwise(done["added"]).alias("added"), F.concat(state["out"], F.array(row)).alias("out"))

    return _let(F.aggregate(one["props"], start, lambda s, p: _with_prop(s, p, one["local"])), after)


def decompositions(imports: DataFrame, uses: DataFrame, exported: DataFrame, reused: DataFrame, bindings: DataFrame) -> DataFrame:
    """module, import_id, exported, local, aliased, keeps: the named imports that replace namespace imports.

    ``imports`` has module, import_id (their order), local and provider; ``uses``
    module, import_id and prop (null: a use that is no plain property); ``exported``
    provider and name; ``reused`` module, import_id, name and local of what the
    statement names already; ``bindings`` module and name, of every scope, the
    imports' own locals among them.

    An import is replaced if all its uses are properties, one at least, and the
    provider exports them all. Properties come in order of their names, imports
    in theirs. A property that the statement names already keeps that local; one
    that a binding has, that was given before or that is reserved gets the first
    free alias; others keep their name. Where a statement has two new names or
    more and more than half are aliases, only the clean ones are taken out, the
    aliases are free again and the namespace stays (``keeps``).

    A module's imports are one array, as each depends on the names given before:
    the module is the unit of work. Of its bindings only those are in it that
    equal a property or one of its aliases.
    """
    at = ["module", "import_id"]
    plain = uses.where("prop is not null").join(uses.where("prop is null").select(*at).distinct(), at, "left_anti").select(*at, "prop").distinct()
    plain = materialize(plain, "plain-uses")  # it is asked for three times, and what is left of it twice
    asked = plain.join(imports, at).select(*at, "provider", "prop")
    whole = keys.all_exported(asked.withColumn("_import", F.struct(*at)), exported.select("provider", F.col("name").alias("prop")), "_import", "provider", "prop").select("_import.*")
    props = materialize(plain.join(whole, at, "left_semi"), "props")
    stem = F.regexp_replace("name", r"_[0-9]+$", "")
    held = bindings.select("module", "name").distinct()
    looks = held.select("module", F.col("name").alias("prop"), "name").unionAll(held.where(stem != F.col("name")).select("module", stem.alias("prop"), "name"))
    taken = looks.join(props.select("module", "prop").distinct(), ["module", "prop"], "left_semi").groupBy("module", "prop").agg(F.collect_set("name").alias("taken"))
    told = props.join(taken, ["module", "prop"], "left").join(reused.groupBy(*at, F.col("name").alias("prop")).agg(F.min("local").alias("reused")), [*at, "prop"], "left")
    entry = F.struct(F.col("prop").alias("name"), F.coalesce("taken", F.array().cast(_TEXTS)).alias("taken"), "reused", names.is_reserved(F.col("prop")).alias("reserved"))
    per_import = told.groupBy(*at).agg(F.array_sort(F.collect_list(entry)).alias("props")).join(imports.select(*at, "local"), at)
    per_module = per_import.groupBy("module").agg(F.array_sort(F.collect_list(F.struct("import_id", "local", "props"))).alias("x"))
    start = F.struct(F.array().cast(_TEXTS).alias("added"), F.array().cast(f"array<struct<import_id:{imports.schema['import_id'].dataType.simpleString()},props:{_PROPS},keeps:boolean>>").alias("out"))
    rows = per_module.select("module", F.explode(F.aggregate("x", start, _with_import)["out"]).alias("o"))
    return rows.select("module", "o.import_id", F.explode("o.props").alias("p"), "o.keeps").select("module", "import_id", "p.exported", "p.local", "p.aliased", "keeps")
