"""Queries over module graphs that the tables stand in for: suppliers are modules, lines their imports and exports; and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.operators import exports
from tidewrack.session import materialize


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their part's name and size as ``name``, the next size as ``other``, a place, and the number of another supplier (of two that there are not, too)."""
    part = _table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), "p_brand", "p_size",
        F.concat_ws("#", "p_name", F.col("p_size").cast("string")).alias("name"), F.concat_ws("#", "p_name", (F.col("p_size") % 50 + 1).cast("string")).alias("other"),
    )
    n = F.broadcast(_table(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("n")))  # one row
    line = _table(spark, sf_dir, "lineitem").join(part, "l_partkey").join(n)
    to = (F.col("l_suppkey") * 3 + F.col("l_partkey") % 5) % (F.col("n") + 2) + 1
    return line.withColumn("to", to).withColumn("place", F.col("l_orderkey") * 16 + F.col("l_linenumber")).withColumn("third", F.col("l_linenumber") % 3)


def export_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers export what they shipped with flag A and re-export one another (the ones at twice and thrice their number); asked for is what they shipped with flag R."""
    supplier = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("module"))
    line = _lines(spark, sf_dir).withColumnRenamed("l_suppkey", "module")
    none = F.lit(None)
    own = line.where("l_returnflag = 'A'").select("module", "name", "place", none.cast("long").alias("target"), none.cast("string").alias("imported"), F.col("name").alias("binding"))
    stars = supplier.where("module > 1").select("module", F.explode(F.array(F.col("module") * 2, F.col("module") * 3)).alias("target"))
    found = exports.resolve_exports(own, stars, line.where("l_returnflag = 'R'").select("module", "name"), supplier)
    return found.select("module", "name", "state", F.col("origin_module").alias("origin"))


def named_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with explicit exports of all kinds: lines of flag A export a name of their own, lines of flag N a name of another supplier under theirs, its namespace, or their brand; some suppliers re-export an outside module."""
    supplier = _table(spark, sf_dir, "supplier")
    modules = supplier.select(F.col("s_suppkey").alias("module"))
    line = _lines(spark, sf_dir).withColumnRenamed("l_suppkey", "module")
    moved = (F.col("l_returnflag") == "N") & (F.col("third") > 0)
    stated = line.where("l_returnflag in ('A', 'N')").select(
        "module", "name", "place", F.when(moved, F.col("to")).alias("target"),
        F.when(moved & (F.col("third") == 1), F.col("other")).alias("imported"), F.when(F.col("l_returnflag") == "A", F.col("name")).otherwise(F.col("p_brand")).alias("binding"),
    )
    default = supplier.where("s_acctbal > 0").select(
        F.col("s_suppkey").alias("module"), F.lit("default").alias("name"), F.lit(0).cast("long").alias("place"), F.lit(None).cast("long").alias("target"), F.lit(None).cast("string").alias("imported"), F.lit("default").alias("binding")
    )
    stars = modules.where("module > 1").select("module", F.explode(F.array(F.col("module") * 2, F.col("module") * 3, F.when(F.col("module") % 17 == 0, F.lit(None).cast("long")).otherwise(F.col("module") * 2))).alias("target"))
    wanted = line.where("l_returnflag = 'R'").select("module", "name").unionAll(modules.select("module", F.lit("default").alias("name")))
    return exports.resolve_exports(stated.unionAll(default), stars, wanted, modules)


def _file(nation: Column, number: Column) -> Column:
    return F.concat(F.lit("n"), nation.cast("string"), F.lit("/s"), number.cast("string"))


def graph_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of five kinds in a graph of suppliers' files, a folder per nation; lines import (flag R) and export (A and N) by relative specifiers, a few of which lead nowhere or outside."""
    supplier = _table(spark, sf_dir, "supplier")
    named = supplier.select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("nation"), F.concat(_file(F.col("s_nationkey"), F.col("s_suppkey")), F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(".js")).alias("module"), "s_acctbal")
    there = supplier.select(F.col("s_suppkey").alias("to"), F.col("s_nationkey").alias("to_nation"))
    line = _lines(spark, sf_dir).withColumnRenamed("l_suppkey", "k")

    def with_spec(rows: DataFrame, bare: Column) -> DataFrame:
        nation = F.coalesce("to_nation", F.lit(0))
        near = F.concat(F.lit("./s"), F.col("to").cast("string"))
        spec = F.when(bare, F.concat(F.lit("pkg-"), F.col("to").cast("string"))).when(nation == F.col("nation"), near).otherwise(F.concat(F.lit("../"), _file(nation, F.col("to"))))
        return rows.join(named.select("k", "nation", "module"), "k").join(there, "to", "left").withColumn("spec", spec)

    # Eight tables are cut from the lines, so their joins run once.
    line = with_spec(line, F.col("l_linenumber") == 6)
    line = materialize(line.select("module", "place", "name", "other", "third", "spec", "p_brand", "p_size", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus"), "lines")
    asked = F.when(F.col("l_linenumber") == 5, None).when(F.col("l_linenumber") == 4, "default").otherwise(F.col("name"))
    imports = line.where("l_returnflag = 'R'").select("module", "place", F.col("name").alias("local"), "spec", asked.alias("name"))
    moved = (F.col("l_returnflag") == "N") & (F.col("third") > 0)
    stated = line.where("l_returnflag in ('A', 'N')").select(
        "module", "place", "name", F.when(moved, F.col("spec")).alias("spec"), F.when(moved & (F.col("third") == 1), F.col("other")).alias("imported"),
        F.when(F.col("l_returnflag") == "A", F.col("name")).otherwise(F.col("p_brand")).alias("binding"),
    )
    default = named.where("s_acctbal > 0").select("module", F.lit(0).cast("long").alias("place"), F.lit("default").alias("name"), F.lit(None).cast("string").alias("spec"), F.lit(None).cast("string").alias("imported"), F.lit("default").alias("binding"))
    multiples = named.select("k", F.explode(F.array(F.col("k") * 2, F.col("k") * 3)).alias("to"))
    stars = with_spec(multiples, F.col("k") % 17 == 0).select("module", F.col("k").alias("place"), "spec")
    listed = stated.unionAll(default)
    references = imports.select("module", "place", "spec").unionAll(listed.where("spec is not null").select("module", "place", "spec")).unionAll(stars)
    writes = line.where("l_linestatus = 'F' and l_linenumber = 7").select("module", "place", "name")
    constants = line.where("l_returnflag = 'A' and l_linenumber = 1").select("module", "name")
    free = F.when(F.col("p_size") % 3 == 0, "module").when(F.col("p_size") % 3 == 1, "exports").otherwise("require")
    free_uses = line.where("l_returnflag = 'R' and l_linenumber = 2").select("module", "place", free.alias("name"), (F.col("l_partkey") % 4 == 0).alias("probe"))
    return exports.graph_findings(named, references, imports, listed, stars, writes, constants, free_uses)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (export_resolution, named_exports, graph_findings)}

_LINES = """lines AS (
    SELECT l.*, p_brand, p_size, p_name || '#' || p_size AS name, p_name || '#' || (p_size % 50 + 1) AS other, l_orderkey * 16 + l_linenumber AS place, l_linenumber % 3 AS third,
        (l_suppkey * 3 + l_partkey % 5) % ((SELECT count(*) FROM supplier) + 2) + 1 AS dest
    FROM lineitem l JOIN part ON l_partkey = p_partkey)"""

#: Every wanted key with all keys that it leads to, over given(module, name, place, target, imported, binding), stars(module, target), wanted(module, name) and mods(module).
_RESOLVED = f"""
    firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY module, name ORDER BY place, target NULLS FIRST, imported NULLS FIRST, binding NULLS FIRST) AS r FROM given) WHERE r = 1),
    linked AS (SELECT DISTINCT module, target FROM stars WHERE target IN (SELECT module FROM mods)),
    opened AS (SELECT DISTINCT module FROM stars WHERE target IS NULL OR target NOT IN (SELECT module FROM mods)),
    reach AS (
        SELECT DISTINCT module AS rm, name AS rn, module AS m, name AS k FROM wanted
        UNION
        SELECT r.rm, r.rn, coalesce(f.target, s.target), coalesce(f.imported, r.k) FROM reach r LEFT JOIN firsts f ON f.module = r.m AND f.name = r.k
            LEFT JOIN linked s ON s.module = r.m AND f.module IS NULL AND r.k <> 'default'
        WHERE (f.target IS NOT NULL AND f.imported IS NOT NULL) OR s.target IS NOT NULL),
    facts AS (
        SELECT rm, rn, r.m NOT IN (SELECT module FROM mods) OR (f.module IS NULL AND r.k <> 'default' AND r.m IN (SELECT module FROM opened)) AS unknown,
            CASE WHEN f.module IS NULL THEN NULL WHEN f.target IS NULL THEN {{'m': r.m, 'b': f.binding}} WHEN f.imported IS NULL THEN {{'m': f.target, 'b': '{exports.NAMESPACE}'}} END AS origin
        FROM reach r LEFT JOIN firsts f ON f.module = r.m AND f.name = r.k),
    resolved AS (
        SELECT rm AS module, rn AS name, CASE WHEN bool_or(unknown) THEN 'unknown' WHEN count(DISTINCT origin) > 1 THEN 'ambiguous' WHEN count(origin) > 0 THEN 'found' ELSE 'not_found' END AS state,
            min(origin) AS o FROM facts GROUP BY rm, rn)"""

_MOVED = "l_returnflag = 'N' AND third > 0"

ORACLE_SQL: dict[str, str] = {
    "export_resolution": f"""WITH RECURSIVE {_LINES}, mods AS (SELECT s_suppkey AS module FROM supplier),
        given AS (SELECT l_suppkey AS module, name, place, NULL::BIGINT AS target, NULL::VARCHAR AS imported, name AS binding FROM lines WHERE l_returnflag = 'A'),
        stars AS (SELECT s_suppkey AS module, s_suppkey * k AS target FROM supplier, (VALUES (2), (3)) AS t(k) WHERE s_suppkey > 1),
        wanted AS (SELECT l_suppkey AS module, name FROM lines WHERE l_returnflag = 'R'), {_RESOLVED}
        SELECT module, name, state, CASE WHEN state = 'found' THEN o.m END AS origin FROM resolved""",
    "named_exports": f"""WITH RECURSIVE {_LINES}, mods AS (SELECT s_suppkey AS module FROM supplier),
        given AS (SELECT l_suppkey AS module, name, place, CASE WHEN {_MOVED} THEN dest END AS target, CASE WHEN {_MOVED} AND third = 1 THEN other END AS imported,
            CASE WHEN l_returnflag = 'A' THEN name ELSE p_brand END AS binding FROM lines WHERE l_returnflag IN ('A', 'N')
            UNION ALL SELECT s_suppkey, 'default', 0, NULL, NULL, 'default' FROM supplier WHERE s_acctbal > 0),
        stars AS (SELECT s_suppkey AS module, s_suppkey * k AS target FROM supplier, (VALUES (2), (3)) AS t(k) WHERE s_suppkey > 1 UNION ALL SELECT s_suppkey, NULL FROM supplier WHERE s_suppkey > 1 AND s_suppkey % 17 = 0),
        wanted AS (SELECT l_suppkey AS module, name FROM lines WHERE l_returnflag = 'R' UNION ALL SELECT s_suppkey, 'default' FROM supplier), {_RESOLVED}
        SELECT module, name, state, CASE WHEN state = 'found' THEN o.m END AS origin_module, CASE WHEN state = 'found' THEN o.b END AS origin_binding FROM resolved""",
    "graph_findings": f"""WITH RECURSIVE {_LINES},
        files AS (SELECT s_suppkey AS k, s_nationkey AS nation, 'n' || s_nationkey || '/s' || s_suppkey || CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE '.js' END AS module, s_acctbal FROM supplier),
        mods AS (SELECT module FROM files),
        raw AS (
            SELECT l.*, f.module, f.nation, dest AS d, l_linenumber = 6 AS bare FROM lines l JOIN files f ON f.k = l_suppkey),
        specs AS (SELECT r.*, CASE WHEN bare THEN 'pkg-' || d WHEN coalesce(t.nation, 0) = r.nation THEN './s' || d ELSE '../n' || coalesce(t.nation, 0) || '/s' || d END AS spec FROM raw r LEFT JOIN files t ON t.k = d),
        said AS (
            SELECT f.module, f.k AS place, CASE WHEN f.k % 17 = 0 THEN 'pkg-' || f.k * m WHEN coalesce(t.nation, 0) = f.nation THEN './s' || f.k * m ELSE '../n' || coalesce(t.nation, 0) || '/s' || f.k * m END AS spec
            FROM files f CROSS JOIN (VALUES (2), (3)) AS x(m) LEFT JOIN files t ON t.k = f.k * m),
        imports AS (SELECT module, place, name AS local, spec, CASE l_linenumber WHEN 5 THEN NULL WHEN 4 THEN 'default' ELSE name END AS name FROM specs WHERE l_returnflag = 'R'),
        listed AS (
            SELECT module, place, name, CASE WHEN {_MOVED} THEN spec END AS spec, CASE WHEN {_MOVED} AND third = 1 THEN other END AS imported,
                CASE WHEN l_returnflag = 'A' THEN name ELSE p_brand END AS binding FROM specs WHERE l_returnflag IN ('A', 'N')
            UNION ALL SELECT module, 0, 'default', NULL, NULL, 'default' FROM files WHERE s_acctbal > 0),
        refs AS (SELECT module, place, spec FROM imports UNION ALL SELECT module, place, spec FROM listed WHERE spec IS NOT NULL UNION ALL SELECT module, place, spec FROM said),
        paths AS (SELECT module, spec, CASE WHEN spec LIKE '../%' THEN spec[4:] WHEN spec LIKE './%' THEN split_part(module, '/', 1) || '/' || spec[3:] END AS path FROM (SELECT DISTINCT module, spec FROM refs)),
        targets AS (SELECT p.module, spec, coalesce(a.module, b.module) AS resolved FROM paths p LEFT JOIN mods a ON a.module = path LEFT JOIN mods b ON b.module = path || '.js'),
        sources AS (SELECT * FROM (SELECT i.module, local, coalesce(resolved, i.spec) AS target, i.name AS imported,
            row_number() OVER (PARTITION BY i.module, local ORDER BY coalesce(resolved, i.spec), i.name NULLS FIRST) AS r FROM imports i JOIN targets t ON t.module = i.module AND t.spec = i.spec) WHERE r = 1),
        given AS (SELECT e.module, e.name, e.place, CASE WHEN e.spec IS NULL THEN s.target ELSE t.resolved END AS target,
            CASE WHEN e.spec IS NULL THEN s.imported WHEN t.resolved IS NOT NULL THEN e.imported END AS imported, CASE WHEN e.spec IS NULL THEN e.binding ELSE e.name END AS binding
            FROM listed e LEFT JOIN targets t ON t.module = e.module AND t.spec = e.spec LEFT JOIN sources s ON s.module = e.module AND s.local = e.binding),
        stars AS (SELECT s.module, resolved AS target FROM said s JOIN targets t ON t.module = s.module AND t.spec = s.spec),
        asked AS (SELECT u.module, place, resolved AS provider, name FROM (SELECT module, place, spec, name FROM imports UNION ALL SELECT module, place, spec, imported FROM listed) u
            JOIN targets t ON t.module = u.module AND t.spec = u.spec WHERE resolved IS NOT NULL AND name IS NOT NULL),
        wanted AS (SELECT DISTINCT provider AS module, name FROM asked), {_RESOLVED},
        fixed AS (SELECT module, name, max(kind) AS kind FROM (SELECT module, local AS name, 'assign_to_import' AS kind FROM imports
            UNION ALL SELECT module, name, 'assign_to_const' FROM specs WHERE l_returnflag = 'A' AND l_linenumber = 1) GROUP BY module, name)
        SELECT module, place, 'dangling_relative_ref' AS kind, spec AS detail FROM refs r WHERE starts_with(spec, '.') AND (module, spec) IN (SELECT module, spec FROM targets WHERE resolved IS NULL)
        UNION ALL SELECT a.module, place, 'missing_imported_name', state || ' ' || a.name || ' ' || provider FROM asked a JOIN resolved x ON x.module = provider AND x.name = a.name WHERE state IN ('not_found', 'ambiguous')
        UNION ALL SELECT module, place, 'duplicate_export', name FROM (SELECT *, row_number() OVER (PARTITION BY module, name ORDER BY place) AS r FROM listed) WHERE r = 2
        UNION ALL SELECT w.module, place, kind, w.name FROM specs w JOIN fixed f ON f.module = w.module AND f.name = w.name WHERE l_linestatus = 'F' AND l_linenumber = 7
        UNION ALL SELECT module, place, 'esm_commonjs_residual', n FROM (SELECT *, CASE p_size % 3 WHEN 0 THEN 'module' WHEN 1 THEN 'exports' ELSE 'require' END AS n FROM specs)
            WHERE l_returnflag = 'R' AND l_linenumber = 2 AND l_partkey % 4 <> 0 AND n <> 'require'""",
}
