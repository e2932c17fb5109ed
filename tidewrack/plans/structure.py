"""Queries over positions, labels and paths that the tables stand in for, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.operators import facts, graphs, keys, ranges
from tidewrack.sources import containers


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nearest_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every click with the sign-up of its user that is nearest in time, before or after."""
    events = _table(spark, sf_dir, "events").withColumn("at", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000))
    clicks = events.where("event_type = 'click'").select("event_id", "user_id", "at")
    anchors = events.where("event_type = 'signup'").select("user_id", "at", F.col("event_id").alias("signup"))
    return ranges.nearest(clicks, anchors, "user_id", "at", "signup", "nearest", 86_400).select("event_id", "nearest")


def _multiples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between suppliers: a line leads from its supplier to about twice or thrice that number, by its part."""
    supplier = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("dst"))
    to = F.col("l_suppkey") * (2 + F.col("l_partkey") % 2) + F.col("l_partkey") % 3
    return _table(spark, sf_dir, "lineitem").where("l_suppkey > 0").select(F.col("l_suppkey").alias("src"), to.alias("dst")).distinct().join(supplier, "dst", "left_semi").select("src", "dst")


def topological_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The level of every supplier among those that lines lead to, pairs of suppliers that lines join both ways taken as one."""
    edges = _multiples(spark, sf_dir)
    back = edges.where("src % 5 = 0").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    parts = graphs.strong_components(edges.unionAll(back))
    return graphs.topological_levels(graphs.condensed(edges.unionAll(back), parts))


def sensitive_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is told of suppliers (a bit each for two kinds of use) and of all that their lines lead back from."""
    seeds = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), (F.when(F.col("s_acctbal") > 9000, 1).otherwise(0) + F.when(F.col("s_nationkey") == 7, 2).otherwise(0)).alias("labels"))
    return graphs.spread_labels(seeds, _multiples(spark, sf_dir).select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def public_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of pages below the folder that the absolute ones share, and names of parts that make way for them."""
    pages = _table(spark, sf_dir, "pages")
    number = F.col("page_id").cast("string")
    name = F.concat(F.col("page_id") % 40, F.lit("/./x/../part_"), number, F.lit(".js"))
    inputs = pages.select("page_id", F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("/srv/app/./even"), name)).otherwise(F.concat(F.lit("../odd"), name)).alias("path"))
    planned = facts.planned_paths(inputs, "path").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("public_path").alias("name"))
    size = F.col("p_size").cast("string")
    raw = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("EVEN"), size, F.lit("/part_"), size)).otherwise(F.concat(F.lit("odd"), size, F.lit("/part_"), size, F.lit(".js")))
    named = keys.unique_suffixes(_table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw")), "raw", ["p_partkey"], extension=".js", reserved=planned.select("name"))
    return planned.unionAll(named.select(F.lit("part"), "p_partkey", "unique_name"))


def container_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed in a container of its own, in one of two layouts, and read again."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source", F.when(F.col("doc_id") % 2 == 0, 52).otherwise(36).alias("size"))
    name = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".js"))
    files = containers.container_files(containers.pack(docs, [(name, F.col("text")), (F.lit("source.txt"), F.col("source"))], F.col("size")).select("doc_id", "content"))
    return files.select("doc_id", "file_index", "name", "encoding", "is_entry", "start", "stop", F.sha2("contents", 256).alias("sha256"), "error")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (nearest_anchor, topological_levels, sensitive_values, public_paths, container_files)}

_SECONDS = "secs AS (SELECT *, epoch_us(ts) // 1000000 AS sec FROM events)"
_EDGES = """edges AS (SELECT DISTINCT l_suppkey AS src, l_suppkey * (2 + l_partkey % 2) + l_partkey % 3 AS dst FROM lineitem WHERE l_suppkey > 0 AND l_suppkey * (2 + l_partkey % 2) + l_partkey % 3 IN (SELECT s_suppkey FROM supplier))"""

ORACLE_SQL: dict[str, str] = {
    "container_files": """WITH f AS (SELECT doc_id, 0 AS i, 'doc/' || doc_id || '.js' AS name, text AS body, 11 + strlen('doc/' || doc_id || '.js') + 1 AS start FROM documents
            UNION ALL SELECT doc_id, 1, 'source.txt', source, 11 + strlen('doc/' || doc_id || '.js') + 1 + strlen(coalesce(text, '')) + 1 + strlen('source.txt') + 1 FROM documents)
        SELECT doc_id, i AS file_index, name, 'utf8' AS encoding, i = 0 AS is_entry, start, start + strlen(coalesce(body, '')) AS stop, sha256(coalesce(body, '')) AS sha256, NULL::VARCHAR AS error FROM f""",
    "nearest_anchor": f"""WITH {_SECONDS}, c AS (SELECT * FROM secs WHERE event_type = 'click'), a AS (SELECT * FROM secs WHERE event_type = 'signup')
        SELECT c.event_id, (SELECT arg_min(a.event_id, (abs(a.sec - c.sec), a.sec, a.event_id)) FROM a WHERE a.user_id = c.user_id) AS nearest FROM c""",
    "topological_levels": f"""WITH RECURSIVE {_EDGES}, every AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges WHERE src % 5 = 0),
        reach AS (SELECT src, dst FROM every UNION SELECT r.src, e.dst FROM reach r JOIN every e ON e.src = r.dst),
        parts AS (SELECT a.src AS node, min(a.dst) AS component FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src),
        links AS (SELECT DISTINCT coalesce(p.component, src) AS a, coalesce(q.component, dst) AS b FROM every LEFT JOIN parts p ON p.node = src LEFT JOIN parts q ON q.node = dst),
        up AS (SELECT a AS node, 0 AS level FROM links WHERE a <> b UNION SELECT b, 0 FROM links WHERE a <> b UNION SELECT b, level + 1 FROM up JOIN links ON a = node AND a <> b)
        SELECT node, max(level)::INTEGER AS level FROM up GROUP BY node""",
    "sensitive_values": f"""WITH RECURSIVE {_EDGES}, told AS (
            SELECT s_suppkey AS node, 1 AS bit FROM supplier WHERE s_acctbal > 9000 UNION SELECT s_suppkey, 2 FROM supplier WHERE s_nationkey = 7 UNION SELECT src, bit FROM told JOIN edges ON dst = node)
        SELECT node, sum(bit)::BIGINT AS labels FROM told GROUP BY node""",
    "public_paths": r"""WITH RECURSIVE planned AS (SELECT page_id, CASE page_id % 2 WHEN 0 THEN 'even' ELSE 'odd' END || page_id % 40 || '/part_' || page_id || '.js' AS name FROM pages),
        raws AS (SELECT p_partkey, CASE p_partkey % 2 WHEN 0 THEN 'EVEN' || p_size || '/part_' || p_size ELSE 'odd' || p_size || '/part_' || p_size || '.js' END AS raw FROM part),
        steps AS (SELECT *, regexp_replace(raw, '\.js$', '') AS stem, row_number() OVER (PARTITION BY lower(raw) ORDER BY p_partkey) AS i FROM raws),
        folders AS (SELECT split_part(name, '/', 1) AS folder, list(name) AS taken FROM planned GROUP BY ALL),
        walk AS (
            SELECT DISTINCT lower(raw) AS k, 0::BIGINT AS i, NULL::BIGINT AS p_partkey, NULL::VARCHAR AS name, coalesce(taken, []) AS taken FROM steps LEFT JOIN folders ON folder = lower(split_part(raw, '/', 1))
            UNION ALL
            SELECT k, i, p_partkey, name, list_append(taken, lower(name)) FROM (
                SELECT w.k, s.i, s.p_partkey, w.taken, CASE WHEN NOT list_contains(w.taken, lower(raw)) THEN raw
                    ELSE list_filter(list_transform(range(2, len(w.taken) + 3), lambda n: stem || '_' || n || '.js'), lambda x: NOT list_contains(w.taken, lower(x)))[1] END AS name
                FROM walk w JOIN steps s ON lower(s.raw) = w.k AND s.i = w.i + 1))
        SELECT 'page' AS kind, page_id AS id, name FROM planned UNION ALL SELECT 'part', p_partkey, name FROM walk WHERE i > 0""",
}
