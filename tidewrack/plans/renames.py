"""Queries over source maps and namespace imports that the tables stand in for, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.operators import namespaces, renames
from tidewrack.session import materialize
from tidewrack.sources import mappings


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a segment of the map of a supplier; some have no source, some no name."""
    n = F.broadcast(_table(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("n")))  # one row
    number, mapped = F.col("o_orderkey"), F.col("o_orderpriority") != "5-LOW"
    return _table(spark, sf_dir, "orders").join(n).select(
        (F.col("o_custkey") % F.col("n")).alias("module"), (number % 8).cast("int").alias("line"), F.floor(number / 8).alias("column"),
        F.when(mapped, F.lit(0).cast("long")).alias("source"), F.when(mapped, number % 5).alias("source_line"), F.when(mapped, number % 3 * 4).alias("source_column"),
        F.when(mapped & (F.col("o_orderstatus") == "F"), number % 50 + 1).alias("name"),
    )


def source_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of every supplier's map."""
    return mappings.encode_mappings(_segments(spark, sf_dir), "module")


def source_map_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments of every supplier's map, read from its text."""
    return mappings.mapping_rows(source_maps(spark, sf_dir), "module")


def source_map_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renames by the suppliers' maps: lines mention bindings, sizes number the names (some empty, some reserved), regions are the lines of the source."""
    tokens = materialize(source_map_rows(spark, sf_dir), "tokens")  # four tables come from them
    line = _table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("module"), (F.col("l_partkey") % 50).alias("binding"), (F.col("l_orderkey") % 8).alias("line"), F.floor(F.col("l_orderkey") / 8).alias("column"))
    binding = F.col("binding")
    bindings = line.select("module", "binding").distinct().select(
        "module", "binding", F.when(binding % 6 == 0, "africa").otherwise(F.concat(F.lit("v"), binding.cast("string"))).alias("symbol"), (binding % 3 != 0).alias("top"), binding.alias("declared")
    )
    size = F.col("p_size")
    texts = _table(spark, sf_dir, "part").groupBy(size.cast("long").alias("number")).agg(F.min(F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))).alias("text"))
    texts = texts.select("number", F.when(F.col("number") % 10 == 0, "").when(F.col("number") % 7 == 0, "class").otherwise(F.col("text")).alias("text"))
    names_of = tokens.select("module", F.col("name").alias("number")).distinct().join(texts, "number")
    region = _table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("source_line"), F.concat(F.lower("r_name"), F.lit(" = "), F.col("r_name")).alias("text"))
    lines = tokens.select("module", "source", "source_line").distinct().join(region, "source_line")
    return renames.source_map_renames(line, bindings, tokens, names_of, lines)


def namespace_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders import three namespaces, by their suppliers' numbers; their lines use the parts' names, which some orders bind already."""
    part = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size", F.when(F.col("p_partkey") % 50 == 0, "delete").otherwise(F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))).alias("name"))
    line = _table(spark, sf_dir, "lineitem").join(part, "l_partkey").withColumn("import_id", F.col("l_suppkey") % 3).withColumnRenamed("l_orderkey", "module")
    line = materialize(line.select("module", "import_id", "l_linenumber", "l_tax", "name"), "lines")  # four tables come from them
    local = F.when(F.col("import_id") == 0, "small_ring").otherwise(F.concat(F.lit("s"), F.col("import_id").cast("string")))
    imports = line.select("module", "import_id").distinct().select("module", "import_id", local.alias("local"), F.col("import_id").alias("provider"))
    uses = line.select("module", "import_id", F.when((F.col("l_linenumber") == 1) & (F.col("l_tax") == 0), None).otherwise(F.col("name")).alias("prop"))
    exported = part.where("p_size < 25 or name = 'delete'").select((F.col("p_size") % 3).cast("long").alias("provider"), "name").distinct()
    reused = line.where("l_linenumber = 2").select("module", "import_id", "name", F.concat(F.lit("kept_"), "name").alias("local"))
    bound = line.where("l_linenumber >= 4").select("module", "name").unionAll(line.where("l_linenumber >= 6").select("module", F.concat("name", F.lit("_1")).alias("name")))
    return namespaces.decompositions(imports, uses, exported, reused, bound.unionAll(imports.select("module", F.col("local").alias("name"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (source_maps, source_map_rows, source_map_renames, namespace_names)}

_SEGMENTS = """segments AS (
    SELECT o_custkey % (SELECT count(*) FROM supplier) AS module, (o_orderkey % 8)::INTEGER AS line, o_orderkey // 8 AS col, mapped, CASE WHEN mapped THEN 0::BIGINT END AS source,
        CASE WHEN mapped THEN o_orderkey % 5 END AS source_line, CASE WHEN mapped THEN o_orderkey % 3 * 4 END AS source_column, CASE WHEN mapped AND o_orderstatus = 'F' THEN o_orderkey % 50 + 1 END AS name
    FROM (SELECT *, o_orderpriority <> '5-LOW' AS mapped FROM orders))"""


def _vlq(number: str) -> str:
    """A number in Base64 VLQ, by digits of its sign-last form."""
    bits = f"(CASE WHEN {number} < 0 THEN 1 - 2 * {number} ELSE 2 * {number} END)"
    digits = [f"CASE WHEN {i} = 0 OR {bits} >= {32**i} THEN ('{mappings.DIGITS}')[({bits} // {32**i} % 32 + CASE WHEN {bits} >= {32 ** (i + 1)} THEN 33 ELSE 1 END)::INTEGER] ELSE '' END" for i in range(7)]
    return "(" + " || ".join(digits) + ")"


_NAMES = "CASE WHEN p_size % 10 = 0 THEN '' WHEN p_size % 7 = 0 THEN 'class' ELSE min(replace(p_name, ' ', '_')) END"

ORACLE_SQL: dict[str, str] = {
    "source_maps": f"""WITH {_SEGMENTS}, steps AS (
            SELECT *, col - coalesce(lag(col) OVER (PARTITION BY module, line ORDER BY col), 0) AS d0,
                source - coalesce(last_value(source IGNORE NULLS) OVER w, 0) AS d1, source_line - coalesce(last_value(source_line IGNORE NULLS) OVER w, 0) AS d2,
                source_column - coalesce(last_value(source_column IGNORE NULLS) OVER w, 0) AS d3, name - coalesce(last_value(name IGNORE NULLS) OVER w, 0) AS d4
            FROM segments WINDOW w AS (PARTITION BY module ORDER BY line, col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        texts AS (SELECT module, line, string_agg({_vlq("d0")} || coalesce({_vlq("d1")} || {_vlq("d2")} || {_vlq("d3")}, '') || coalesce({_vlq("d4")}, ''), ',' ORDER BY col) AS t FROM steps GROUP BY module, line),
        spread AS (SELECT m.module, l.line, coalesce(t, '') AS t FROM (SELECT module, max(line) AS most FROM texts GROUP BY module) m JOIN unnest(range(8)) AS l(line) ON l.line <= most LEFT JOIN texts x ON x.module = m.module AND x.line = l.line)
        SELECT module, string_agg(t, ';' ORDER BY line) AS mappings FROM spread GROUP BY module""",
    "source_map_rows": f"""WITH {_SEGMENTS} SELECT module, line, col AS "column", source, source_line, source_column, name FROM segments""",
    "source_map_renames": f"""WITH {_SEGMENTS}, tokens AS (SELECT *, line * 4294967296 + col AS pos FROM segments),
        mentions AS (SELECT l_suppkey AS module, l_partkey % 50 AS binding, (l_orderkey % 8) * 4294967296 + l_orderkey // 8 AS pos FROM lineitem),
        texts AS (SELECT p_size AS number, {_NAMES} AS t FROM part GROUP BY p_size),
        found AS (SELECT m.module, m.binding, t.* EXCLUDE (module, pos) FROM mentions m ASOF JOIN tokens t ON t.module = m.module AND m.pos >= t.pos),
        told AS (SELECT module, binding, coalesce(nullif(t, ''), nullif(regexp_extract(substr(lower(r_name) || ' = ' || r_name, source_column + 1), '^[A-Za-z_$][A-Za-z0-9_$]*'), '')) AS original
            FROM found LEFT JOIN texts ON number = name LEFT JOIN region ON r_regionkey = source_line),
        bound AS (SELECT *, CASE WHEN binding % 6 = 0 THEN 'africa' ELSE 'v' || binding END AS symbol FROM told WHERE original <> 'class'),
        votes AS (SELECT module, binding, symbol, original, count(*) AS n FROM bound WHERE original <> symbol GROUP BY ALL),
        won AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY module, binding ORDER BY n DESC, original) AS r FROM votes) WHERE r = 1),
        numbered AS (SELECT *, CASE WHEN binding % 3 = 0 THEN 1 ELSE row_number() OVER (PARTITION BY module, original, binding % 3 = 0 ORDER BY binding) END AS k FROM won)
        SELECT module, binding, symbol AS old, CASE WHEN k = 1 THEN original ELSE original || '_' || k END AS new FROM numbered""",
    "namespace_names": """WITH RECURSIVE parts AS (SELECT p_partkey, p_size, CASE WHEN p_partkey % 50 = 0 THEN 'delete' ELSE replace(p_name, ' ', '_') END AS name FROM part),
        lines AS (SELECT l_orderkey AS module, l_suppkey % 3 AS import_id, name, l_linenumber, l_tax FROM lineitem JOIN parts ON p_partkey = l_partkey),
        given AS (SELECT DISTINCT p_size % 3 AS provider, name FROM parts WHERE p_size < 25 OR name = 'delete'),
        props AS (SELECT DISTINCT module, import_id, name FROM lines a WHERE (module, import_id) NOT IN (SELECT module, import_id FROM lines WHERE l_linenumber = 1 AND l_tax = 0)
            AND (module, import_id) NOT IN (SELECT module, import_id FROM lines WHERE (import_id, name) NOT IN (SELECT provider, name FROM given))),
        locals AS (SELECT DISTINCT module, import_id, CASE import_id WHEN 0 THEN 'small_ring' ELSE 's' || import_id END AS own FROM lines),
        bound AS (SELECT module, name FROM lines WHERE l_linenumber >= 4 UNION SELECT module, name || '_1' FROM lines WHERE l_linenumber >= 6 UNION SELECT module, own FROM locals),
        lists AS (SELECT module, list(name) AS b FROM bound GROUP BY module),
        kept AS (SELECT DISTINCT module, import_id, name FROM lines WHERE l_linenumber = 2),
        steps AS (SELECT p.module, p.import_id, p.name, own, b, k.name IS NOT NULL AS again, row_number() OVER (PARTITION BY p.module ORDER BY p.import_id, p.name) AS i,
                lead(p.import_id) OVER (PARTITION BY p.module ORDER BY p.import_id, p.name) IS DISTINCT FROM p.import_id AS ends
            FROM props p JOIN locals l ON l.module = p.module AND l.import_id = p.import_id JOIN lists ON lists.module = p.module LEFT JOIN kept k ON k.module = p.module AND k.import_id = p.import_id AND k.name = p.name),
        walk AS (
            SELECT DISTINCT module, 0::BIGINT AS i, NULL::BIGINT AS import_id, b AS held, []::VARCHAR[] AS inserted, []::STRUCT(e VARCHAR, l VARCHAR, a BOOLEAN)[] AS ps, 0 AS fresh, []::STRUCT(e VARCHAR, l VARCHAR, a BOOLEAN)[] AS done, false AS keeps FROM steps
            UNION ALL
            SELECT module, i, import_id, CASE WHEN ends AND many THEN list_filter(held2, lambda x: NOT list_contains(list_filter(inserted2, lambda y: list_contains(list_transform(list_filter(ps2, lambda p: p.a OR p.l = own), lambda p: p.l), y)), x)) ELSE held2 END,
                CASE WHEN ends THEN [] ELSE inserted2 END, CASE WHEN ends THEN [] ELSE ps2 END, CASE WHEN ends THEN 0 ELSE fresh2 END,
                CASE WHEN NOT ends THEN [] WHEN many THEN list_filter(ps2, lambda p: NOT p.a AND p.l <> own) ELSE ps2 END, ends AND many
            FROM (
                SELECT *, fresh2 > 1 AND 2 * len(list_filter(ps2, lambda p: p.a)) > fresh2 AS many FROM (
                    SELECT module, i, import_id, own, ends, CASE WHEN news IS NULL THEN held ELSE list_append(held, news) END AS held2, CASE WHEN news IS NULL THEN inserted ELSE list_append(inserted, news) END AS inserted2,
                        list_append(ps, {'e': name, 'l': CASE WHEN again THEN 'kept_' || name WHEN clash THEN alias ELSE name END, 'a': NOT again AND clash}) AS ps2, fresh + CASE WHEN again THEN 0 ELSE 1 END AS fresh2
                    FROM (
                        SELECT *, CASE WHEN again THEN NULL WHEN clash THEN alias WHEN NOT list_contains(held, name) THEN name END AS news FROM (
                            SELECT s.module, s.i, s.import_id, s.name, s.own, s.again, s.ends, w.held, w.inserted, w.ps, w.fresh, s.name <> s.own AND (list_contains(w.held, s.name) OR s.name = 'delete') AS clash,
                                list_filter(list_transform(range(1, len(w.held) + 2), lambda k: s.name || '_' || k), lambda x: NOT list_contains(w.held, x))[1] AS alias
                            FROM walk w JOIN steps s ON s.module = w.module AND s.i = w.i + 1)))))
        SELECT module, import_id, p.e AS exported, p.l AS local, p.a AS aliased, keeps FROM (SELECT module, import_id, keeps, unnest(done) AS p FROM walk)""",
}
