"""Column functions on paths and numbers in module ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_name(url: Column) -> Column:
    """The last segment of a URL's path, without query and fragment."""
    return F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"([^/]*)$", 1)


def resolve_relative(base: Column, spec: Column) -> Column:
    """The path that ``spec`` (./ or ../) means from the file ``base``; null if it leaves the root or is not relative."""
    directory = F.slice(F.split(base, "/"), F.lit(1), F.greatest(F.size(F.split(base, "/")) - 1, F.lit(0)))
    steps = F.concat(directory, F.split(spec, "/"))
    start = F.struct(F.array().cast("array<string>").alias("path"), F.lit(True).alias("ok"))

    def walk(state, step):
        depth = F.size(state["path"])
        up = F.struct(F.slice(state["path"], F.lit(1), F.greatest(depth - 1, F.lit(0))).alias("path"), (state["ok"] & (depth > 0)).alias("ok"))
        down = F.struct(F.concat(state["path"], F.array(step)).alias("path"), state["ok"].alias("ok"))
        return F.when(step == "..", up).when((step == ".") | (step == ""), state).otherwise(down)

    walked = F.aggregate(steps, start, walk)
    relative = spec.startswith("./") | spec.startswith("../")
    return F.when(relative & walked["ok"], F.array_join(walked["path"], "/"))


def normalise(path: Column) -> Column:
    """A path without . and empty steps, in which .. takes the step before it away; where there is none it stays. An absolute path stays one."""

    def walk(done, step):
        up = F.when(F.size(done) > 0, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array(step))
        return F.when(step == "..", up).otherwise(F.concat(done, F.array(step)))

    steps = F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(F.aggregate(steps, F.array().cast("array<string>"), walk), "/"))


def sanitise(path: Column) -> Column:
    """A path without empty, . and .. segments."""
    return F.array_join(F.filter(F.split(path, "/"), lambda s: ~s.isin("", ".", "..")), "/")


def from_base36(digits: Column) -> Column:
    """The number that base-36 digits write, in any case; null if there is another character or nothing."""
    return F.when(digits.rlike("^[0-9A-Za-z]+$"), F.conv(digits, 36, 10).cast("long"))


def to_base36(number: Column) -> Column:
    """A number of 0 or more in lower-case base-36 digits."""
    return F.lower(F.conv(number.cast("string"), 10, 36))


def decode_graph(text: Column) -> Column:
    """Dependencies of a module list: 'a:b0,1/c' entries by ``/``, ids before ``:``, base-36 positions after it.

    An array of (pos, id, deps); null unless every dependency points backwards
    and ids are distinct.
    """
    entries = F.transform(
        F.split(text, "/"),
        lambda e, i: F.struct(
            i.alias("pos"),
            F.split(e, ":")[0].alias("id"),
            F.transform(F.filter(F.split(F.coalesce(F.get(F.split(e, ":"), F.lit(1)), F.lit("")), ","), lambda d: d != ""), from_base36).alias("deps"),
        ),
    )
    backwards = F.forall(entries, lambda e: F.forall(e["deps"], lambda d: d.isNotNull() & (d < e["pos"])))
    ids = F.transform(entries, lambda e: e["id"])
    return F.when(backwards & (F.size(F.array_distinct(ids)) == F.size(ids)), entries)
