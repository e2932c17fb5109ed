"""Queries over the relational kernels, on whole tables, and the SQL that checks them.

The kernels are the joins, windows, votes and fixpoints of module analysis; the
tables stand in for modules, names and references.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewrack.functions import names, paths
from tidewrack.operators import facts, graphs, keys, ranges
from tidewrack.plans import modules, renames, structure
from tidewrack.sources import scripts, sinks

FLAGSHIP = "script_inventory"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def script_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every inline script of every page with its declared names and called names."""
    found = scripts.inline_scripts(_table(spark, sf_dir, "pages"))
    declared = F.regexp_extract_all("code", F.lit(r"(?:var|let|const|function)\s+([A-Za-z_$][\w$]*)"), 1)
    called = F.regexp_extract_all("code", F.lit(r"([A-Za-z_$][\w$]*)\s*\("), 1)
    return found.select("page_id", "script_idx", "code", F.array_join(declared, ",").alias("declared"), F.array_join(called, ",").alias("called"))


def free_call_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many scripts call each name."""
    found = scripts.inline_scripts(_table(spark, sf_dir, "pages"))
    calls = found.select("page_id", "script_idx", F.explode(F.array_distinct(F.regexp_extract_all("code", F.lit(r"([A-Za-z_$][\w$]*)\s*\("), 1))).alias("name"))
    return calls.groupBy("name").agg(F.count(F.lit(1)).alias("n_scripts"))


def first_match_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first detector that matches each script, and what the policy makes of it."""
    code = F.col("code")
    cases = [("even", code.rlike(r"track\(\d*[02468]\)")), ("short", code.rlike(r"track\(\d\d?\)")), ("call", code.contains("track("))]
    found = scripts.inline_scripts(_table(spark, sf_dir, "pages")).withColumn("format", keys.first_match(cases))
    return found.select("page_id", "format", keys.unmatched_policy(F.when(F.col("format") == "call", "plain").otherwise(F.col("format")), "skip").alias("action"))


def unique_id_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.unique_map(_table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_partkey")


def composite_unique_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.unique_map(_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber", "l_returnflag"], "l_partkey")


def agree_or_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.agree_or_drop(_table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag", least=2)


def rename_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    named = part.select("p_partkey", "p_name", F.concat_ws("/", "p_name", "p_brand", F.col("p_size").cast("string")).alias("suggested"))
    return keys.rename_map(named, "p_name", "suggested").select("p_partkey", "suggested")


def dedup_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.unique_suffixes(_table(spark, sf_dir, "part"), "p_name", ["p_partkey"]).select("p_partkey", "unique_name")


def specifier_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page paths looked up among the same paths with .js at every second page."""
    pages = _table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^https?://[^/]+/([^?#]*)", 1).alias("path"))
    facts = pages.select(F.when(F.length("path") % 2 == 0, F.concat("path", F.lit(".js"))).otherwise(F.col("path")).alias("key"))
    return keys.lookup_by_variants(pages.withColumn("spec", F.concat(F.lit("./"), "path")), facts, "spec", "key").select("page_id", "spec", "resolved")


def dangling_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, part = _table(spark, sf_dir, "lineitem"), _table(spark, sf_dir, "part").where("p_size <= 25")
    gone = keys.dangling(line, part, F.col("l_partkey") == F.col("p_partkey"))
    return gone.select("l_orderkey", "l_linenumber", "l_partkey")


def duplicate_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = keys.duplicates(_table(spark, sf_dir, "orders"), ["o_custkey", "o_orderdate"])
    return found.select("o_custkey", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("at"), "n")


def first_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = keys.first_declared(_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_extendedprice"])
    return first.select("l_orderkey", "l_linenumber", "l_partkey")


def prune_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    return keys.prune_stale(orders, _table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey")), ["o_custkey"]).select("o_orderkey", "o_custkey")


def all_props_exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose every (supplier, line status) is among those that some cheap line has."""
    line = _table(spark, sf_dir, "lineitem")
    return keys.all_exported(line, line.where("l_extendedprice < 20000"), "l_orderkey", "l_suppkey", "l_linestatus")


def name_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.plurality(_table(spark, sf_dir, "events"), ["user_id"], "event_type")


def _event_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").withColumn("at", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000))


def range_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _event_seconds(spark, sf_dir).select("user_id", F.col("at").alias("start"), (F.col("at") + 14_400).alias("end"))
    return ranges.coalesce_ranges(spans, ["user_id"], "start", "end", 86_400)


def range_map_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks inside the day after each user's sign-ups, mapped to source ranges."""
    events = _event_seconds(spark, sf_dir)
    spans = events.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("range_id"), F.col("at").alias("start"), (F.col("at") + 86_400).alias("end"))
    points = events.where("event_type = 'click'").select("user_id", F.col("at").alias("gen"), F.col("event_id").alias("src"))
    hits = ranges.range_join(points, spans, "user_id", "gen", "start", "end", 86_400)
    return ranges.map_points(hits, ["range_id"], "gen", "src", "end").select("range_id", "gen", "src", "src_end")


def asof_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _event_seconds(spark, sf_dir)
    clicks = events.where("event_type = 'click'").select("event_id", "user_id", "at")
    views = events.where("event_type = 'view'").select("user_id", "at", F.col("event_id").alias("view_id"), F.col("event_id").alias("seen"))
    return ranges.as_of(clicks, views, "user_id", "at", "view_id", "seen", "last_view", 86_400).select("event_id", "last_view")


def band_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    pairs = ranges.band_pairs(line, "l_orderkey", "l_linenumber", 3, F.col("l_returnflag") == F.col("l_returnflag_b"))
    return pairs.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_pairs"))


def _transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = _table(spark, sf_dir, "events").select(F.col("event_type").alias("src"), F.lead("event_type").over(order).alias("dst"))
    return steps.where("dst is not null").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def mutual_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.mutual(_transitions(spark, sf_dir).where("src <> dst"))


def _order_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References between a customer's orders: each to the one at half its place, and back to it where it is fulfilled."""
    orders = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    placed = ranges.numbered(orders, ["o_custkey"], ["o_orderkey"], 1 << 16, "i").withColumn("i", F.col("i") - 1)
    half = placed.select("o_custkey", F.col("o_orderkey").alias("to"), F.col("o_orderstatus").alias("to_status"), F.col("i").alias("half"))
    up = placed.where("i > 0").withColumn("half", F.floor(F.col("i") / 2)).join(half, ["o_custkey", "half"])
    ways = F.array(F.struct(F.col("o_orderkey").alias("src"), F.col("to").alias("dst")), F.when(F.col("o_orderstatus") == "F", F.struct(F.col("to").alias("src"), F.col("o_orderkey").alias("dst"))))
    return up.select((F.col("o_orderstatus") == F.col("to_status")).alias("alike"), F.explode(ways).alias("e")).where("e is not null").select("e.src", "e.dst", "alike")


def reference_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of orders that references between orders of equal status connect."""
    return graphs.components(_order_graph(spark, sf_dir).where("alike").select("src", "dst"))


def scc_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.strong_components(_order_graph(spark, sf_dir).select("src", "dst"))


def alive_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that the most expensive ones lead to."""
    roots = _table(spark, sf_dir, "orders").where("o_totalprice > 450000").select(F.col("o_orderkey").alias("node"))
    return graphs.reachable(_order_graph(spark, sf_dir), roots)


def transitive_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"), (F.col("o_totalprice") < 450000).alias("pure"))
    return graphs.transitively_pure(nodes, _order_graph(spark, sf_dir))


def drop_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    modules = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"), (price > 50000).alias("helper"), (F.col("o_orderpriority") == "1-URGENT").alias("entry"), (price < 450000).alias("pure"))
    return graphs.drop_cascade(modules, _order_graph(spark, sf_dir))


def _imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References between customers, many of each: an order of one points to another by its number. The queries on them have no SQL, as its recursion lists all pairs."""
    n = _table(spark, sf_dir, "customer").agg(F.count(F.lit(1)).alias("n"))
    orders = _table(spark, sf_dir, "orders").join(F.broadcast(n))  # one row
    return orders.select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") * 7919 % F.col("n") + 1).alias("dst")).distinct()


def reference_components_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.components(_imports(spark, sf_dir).where("src <> dst"))


def scc_cycles_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.strong_components(_imports(spark, sf_dir))


def alive_declarations_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = _table(spark, sf_dir, "customer").where("c_acctbal > 9500").select(F.col("c_custkey").alias("node"))
    return graphs.reachable(_imports(spark, sf_dir), roots)


def transitive_purity_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), (F.col("c_acctbal") < 9000).alias("pure"))
    return graphs.transitively_pure(nodes, _imports(spark, sf_dir))


def drop_cascade_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = _table(spark, sf_dir, "customer")
    modules = customer.select(
        F.col("c_custkey").alias("node"), (F.col("c_acctbal") > 0).alias("helper"), (F.col("c_mktsegment") == "BUILDING").alias("entry"), (F.col("c_acctbal") < 9000).alias("pure")
    )
    return graphs.drop_cascade(modules, _imports(spark, sf_dir))


def passthrough_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order that another of its customer follows, with the customer's last one."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    steps = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("src"), F.lead("o_orderkey").over(order).alias("dst")).where("dst is not null")
    return graphs.follow_chain(steps)


def _named_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their supplier as provider and a name made of the part's name and size."""
    part = _table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("#", "p_name", F.col("p_size").cast("string")).alias("name"))
    return _table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).withColumnRenamed("l_suppkey", "provider")


def import_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names asked of suppliers that only their default export can mean."""
    line = _named_lines(spark, sf_dir)
    providers = _table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("provider"), (F.col("s_suppkey") % 11 == 0).alias("export_all"), (F.col("s_acctbal") > 0).alias("has_default"), (F.col("s_nationkey") % 3 == 0).alias("default_object")
    )
    imports = line.where("l_linestatus = 'O'").select("provider", "name").distinct()
    return facts.default_repairs(imports, providers, line.where("l_returnflag = 'A'"), line.where("l_returnflag = 'R'"))


def namespace_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of users all of whose events are of a harmless kind."""
    events = _table(spark, sf_dir, "events").withColumn("day", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000))
    return facts.used_only_as(events, ["user_id", "day"], F.col("event_type").isin("click", "view", "purchase"))


def unused_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that lines of flag A take from a supplier and no line of flag R uses."""
    line = _named_lines(spark, sf_dir)
    return facts.unused(line.where("l_returnflag = 'A'").select("provider", "name").distinct(), line.where("l_returnflag = 'R'"), ["provider", "name"])


def public_path_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of pages that several pages claim, without query and fragment."""
    return facts.path_claims(_table(spark, sf_dir, "pages"), F.regexp_extract("url", r"^https?://[^/]+/([^?#]*)", 1))


def reference_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders declare their part numbers and refer to their suppliers' numbers; the last order that declares a number owns it."""
    items = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("declared"), F.collect_set("l_suppkey").alias("referenced"))
    return graphs.reference_edges(items, "l_orderkey", "declared", "referenced")


def lone_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that one event alone refers to, by its user's number, and that stand near it."""
    edges = _table(spark, sf_dir, "events").select(F.col("event_id").alias("src"), (F.col("event_id") + F.col("user_id") % 9 - 4).alias("dst"))
    return facts.lone_references(edges)


def missing_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that lines of flag R ask of suppliers which ship them in no line of flag A."""
    line = _named_lines(spark, sf_dir)
    modules = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("provider"), (F.col("s_acctbal") < 0).alias("open"))
    return facts.missing_names(line.where("l_returnflag = 'R'").select("provider", "name", "l_orderkey", "l_linenumber"), line.where("l_returnflag = 'A'"), modules)


def illegal_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.when(F.col("c_mktsegment") == "BUILDING", "import").when(F.col("c_mktsegment") == "MACHINERY", "const").otherwise("let")
    bindings = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), kinds.alias("kind"))
    return facts.illegal_writes(_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), bindings, ["o_custkey"])


def identifier_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and types, or names, of parts as binding names; every third one is a reserved word."""
    third = F.col("p_partkey") % 3
    raw = F.when(third == 0, F.concat_ws(" ", F.col("p_size").cast("string"), "p_type")).when(third == 1, F.regexp_replace("p_name", " ", "_")).otherwise("delete")
    words = _table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"))
    return words.select("p_partkey", names.is_identifier(F.col("raw")).alias("valid"), names.to_identifier(F.col("raw")).alias("name"))


def cycle_witness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shortest cycle through the first member of every strongly connected component of all references."""
    found = graphs.cycle_witnesses(_imports(spark, sf_dir))
    return found.select("component", "size", F.array_join(F.transform("witness", lambda x: x.cast("string")), " -> ").alias("witness"))


def graph_base36(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as a base-36 graph, every order after its predecessor and the one at half its place; decoded to edges again."""
    placed = _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("o"))

    def entry(order, i):
        deps = F.concat_ws(",", F.when(i > 0, paths.to_base36(i - 1)), F.when(i > 2, paths.to_base36(F.floor(i / 2))))
        return F.concat(order.cast("string"), F.when(deps == "", F.lit("")).otherwise(F.concat(F.lit(":"), F.upper(deps))))

    text = placed.select("o_custkey", F.array_join(F.transform("o", entry), "/").alias("graph"))
    decoded = text.select("o_custkey", paths.decode_graph(F.col("graph")).alias("g")).select("o_custkey", "g", F.explode("g").alias("e"))
    return decoded.select("o_custkey", F.col("e.id").cast("long").alias("src"), F.explode("e.deps").alias("d"), "g").select("o_custkey", "src", F.get("g", F.col("d").cast("int"))["id"].cast("long").alias("dst"))


def resolve_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parent-relative specifier of every page, resolved, and the page's file name."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("url", r"^https?://[^/]+/([^?#]*)", 1).alias("path"))
    return pages.select("page_id", paths.resolve_relative(F.col("path"), F.lit("../lib/./util.js")).alias("resolved"), paths.file_name(F.col("url")).alias("file"))


def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON line per order with its lines' ranges."""
    line = _table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("start"), F.col("l_partkey").alias("stop"))
    return sinks.provenance_json(line, "l_orderkey", ["start", "stop"]).select("l_orderkey", F.length("json").alias("n_chars"), F.get_json_object("json", "$.ranges[0].start").cast("int").alias("first_start"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        script_inventory, free_call_counts, first_match_format, unique_id_map, composite_unique_map, agree_or_drop, rename_map, dedup_suffix, specifier_join, dangling_refs,
        duplicate_exports, first_declared, prune_stale, all_props_exported, name_vote, range_coalesce, range_map_lead, asof_lookup, band_shared, mutual_refs,
        reference_components, scc_cycles, alive_declarations, transitive_purity, drop_cascade, reference_components_all, scc_cycles_all,
        alive_declarations_all, transitive_purity_all, drop_cascade_all, passthrough_chain, graph_base36, resolve_paths, provenance,
        import_repairs, namespace_repairs, unused_imports, public_path_claims, reference_edges, lone_references, missing_imports, illegal_writes, identifier_names, cycle_witness,
    )
}
QUERIES |= modules.QUERIES | renames.QUERIES | structure.QUERIES

_SCRIPTS = r"""scripts AS (
    SELECT page_id, u.i - 1 AS script_idx, m[u.i] AS code
    FROM (SELECT page_id, regexp_extract_all(html, '(?is)<script[^>]*>(.*?)</script', 1) AS m FROM pages), unnest(range(1, len(m) + 1)) AS u(i)
)"""
_SECONDS = "secs AS (SELECT *, epoch_us(ts) // 1000000 AS sec FROM events)"


_NAMED = "named AS (SELECT l_suppkey AS provider, p_name || '#' || p_size AS name, l_orderkey, l_linenumber, l_returnflag, l_linestatus FROM lineitem JOIN part ON l_partkey = p_partkey)"


_EDGES = """placed AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders),
    halves AS (SELECT a.o_orderkey AS a, b.o_orderkey AS b, a.o_orderstatus = 'F' AS back, a.o_orderstatus = b.o_orderstatus AS alike FROM placed a JOIN placed b ON a.o_custkey = b.o_custkey AND a.i > 0 AND b.i = a.i // 2),
    edges AS (SELECT a AS src, b AS dst, alike FROM halves UNION SELECT b, a, alike FROM halves WHERE back)"""

ORACLE_SQL: dict[str, str] = {
    "script_inventory": rf"""WITH {_SCRIPTS} SELECT page_id, script_idx::INTEGER AS script_idx, code,
        array_to_string(regexp_extract_all(code, '(?:var|let|const|function)\s+([A-Za-z_$][\w$]*)', 1), ',') AS declared,
        array_to_string(regexp_extract_all(code, '([A-Za-z_$][\w$]*)\s*\(', 1), ',') AS called FROM scripts""",
    "free_call_counts": rf"""WITH {_SCRIPTS}, calls AS (SELECT DISTINCT page_id, script_idx, unnest(regexp_extract_all(code, '([A-Za-z_$][\w$]*)\s*\(', 1)) AS name FROM scripts)
        SELECT name, count(*) AS n_scripts FROM calls GROUP BY name""",
    "first_match_format": rf"""WITH {_SCRIPTS}, f AS (SELECT page_id, CASE WHEN regexp_matches(code, 'track\(\d*[02468]\)') THEN 'even'
        WHEN regexp_matches(code, 'track\(\d\d?\)') THEN 'short' WHEN contains(code, 'track(') THEN 'call' ELSE 'plain' END AS format FROM scripts)
        SELECT page_id, format, CASE WHEN format IN ('call', 'plain') THEN 'skip' ELSE 'unpack' END AS action FROM f""",
    "unique_id_map": "SELECT l_orderkey, max(l_partkey) AS l_partkey FROM lineitem GROUP BY l_orderkey HAVING count(*) = 1",
    "composite_unique_map": "SELECT l_orderkey, l_linenumber, l_returnflag, max(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL HAVING count(*) = 1",
    "agree_or_drop": "SELECT l_orderkey, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 2 AND count(DISTINCT lower(l_returnflag)) = 1",
    "rename_map": """WITH s AS (SELECT p_partkey, p_name, p_name || '/' || p_brand || '/' || p_size AS suggested FROM part),
        c AS (SELECT *, count(*) OVER (PARTITION BY suggested) AS k FROM s)
        SELECT p_partkey, suggested FROM c WHERE k = 1 AND suggested NOT IN (SELECT p_name FROM part)""",
    "dedup_suffix": """SELECT p_partkey, CASE WHEN k = 1 THEN p_name ELSE p_name || '_' || k END AS unique_name
        FROM (SELECT *, row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) AS k FROM part)""",
    "specifier_join": r"""WITH p AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) AS path FROM pages),
        facts AS (SELECT DISTINCT CASE WHEN length(path) % 2 = 0 THEN path || '.js' ELSE path END AS key FROM p)
        SELECT page_id, './' || path AS spec, coalesce(a.key, b.key) AS resolved FROM p LEFT JOIN facts a ON a.key = path LEFT JOIN facts b ON b.key = path || '.js'""",
    "dangling_refs": "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size <= 25)",
    "duplicate_exports": "SELECT o_custkey, epoch_us(o_orderdate) AS at, count(*) AS n FROM orders GROUP BY o_custkey, o_orderdate HAVING count(*) > 1",
    "first_declared": """SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
        ORDER BY l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem) WHERE k = 1""",
    "prune_stale": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)",
    "all_props_exported": """SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem l WHERE NOT EXISTS
        (SELECT 1 FROM lineitem e WHERE e.l_extendedprice < 20000 AND e.l_suppkey = l.l_suppkey AND e.l_linestatus = l.l_linestatus))""",
    "name_vote": """SELECT user_id, event_type, votes FROM (SELECT user_id, event_type, count(*) AS votes,
        row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS k FROM events GROUP BY user_id, event_type) WHERE k = 1""",
    "range_coalesce": f"""WITH {_SECONDS}, s AS (SELECT user_id, sec AS b, sec + 14400 AS e FROM secs),
        m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
        i AS (SELECT *, sum(CASE WHEN reach IS NULL OR b > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS island FROM m)
        SELECT user_id, min(b) AS "start", max(e) AS "end", count(*) AS parts FROM i GROUP BY user_id, island""",
    "range_map_lead": f"""WITH {_SECONDS}, h AS (SELECT s.event_id AS range_id, c.sec AS gen, c.event_id AS src, s.sec + 86400 AS stop
        FROM secs s JOIN secs c ON s.user_id = c.user_id AND c.sec >= s.sec AND c.sec < s.sec + 86400 WHERE s.event_type = 'signup' AND c.event_type = 'click'),
        m AS (SELECT *, coalesce(lead(src) OVER (PARTITION BY range_id ORDER BY gen, src), src + stop - gen) AS src_end FROM h)
        SELECT range_id, gen, src, src_end FROM m WHERE src_end > src""",
    "asof_lookup": f"""WITH {_SECONDS}, c AS (SELECT * FROM secs WHERE event_type = 'click'), v AS (SELECT * FROM secs WHERE event_type = 'view')
        SELECT c.event_id, (SELECT arg_max(v.event_id, (v.sec, v.event_id)) FROM v WHERE v.user_id = c.user_id AND v.sec <= c.sec) AS last_view FROM c""",
    "band_shared": """SELECT a.l_orderkey, count(*) AS n_pairs FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_returnflag = b.l_returnflag
        AND b.l_linenumber - a.l_linenumber BETWEEN 1 AND 3 GROUP BY a.l_orderkey""",
    "mutual_refs": """WITH t AS (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events),
        e AS (SELECT DISTINCT src, dst FROM t WHERE dst IS NOT NULL) SELECT x.src AS a, x.dst AS b FROM e x JOIN e y ON x.src = y.dst AND x.dst = y.src WHERE x.src < x.dst""",
    "reference_components": f"""WITH RECURSIVE {_EDGES}, both_ways AS (SELECT src, dst FROM edges WHERE alike UNION SELECT dst, src FROM edges WHERE alike),
        r AS (SELECT src AS node, src AS seen FROM both_ways UNION SELECT r.node, e.dst FROM r JOIN both_ways e ON r.seen = e.src)
        SELECT node, min(seen) AS component FROM r GROUP BY node""",
    "scc_cycles": f"""WITH RECURSIVE {_EDGES}, r AS (SELECT src AS a, dst AS b FROM edges UNION SELECT r.a, e.dst FROM r JOIN edges e ON r.b = e.src),
        m AS (SELECT x.a AS node, x.b AS mate FROM r x JOIN r y ON x.a = y.b AND x.b = y.a)
        SELECT node, min(mate) AS component, count(*) AS size FROM m GROUP BY node""",
    "alive_declarations": f"""WITH RECURSIVE {_EDGES}, r AS (SELECT o_orderkey AS node FROM orders WHERE o_totalprice > 450000 UNION SELECT dst FROM r JOIN edges ON src = node)
        SELECT node FROM r""",
    "transitive_purity": f"""WITH RECURSIVE {_EDGES}, r AS (SELECT o_orderkey AS node FROM orders WHERE o_totalprice >= 450000 UNION SELECT src FROM r JOIN edges ON dst = node)
        SELECT o_orderkey AS node FROM orders WHERE o_orderkey NOT IN (SELECT node FROM r)""",
    "drop_cascade": f"""WITH RECURSIVE {_EDGES}, cand AS (SELECT o_orderkey AS node FROM orders WHERE o_totalprice > 50000 AND o_orderpriority <> '1-URGENT' AND o_totalprice < 450000),
        r AS (SELECT o_orderkey AS node FROM orders WHERE o_orderkey NOT IN (SELECT node FROM cand) UNION SELECT dst FROM r JOIN edges ON src = node)
        SELECT node FROM cand WHERE node NOT IN (SELECT node FROM r)""",
    "passthrough_chain": """SELECT src, final FROM (SELECT o_orderkey AS src, last_value(o_orderkey) OVER w AS final, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nxt
        FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) WHERE nxt IS NOT NULL""",
    "graph_base36": """WITH p AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders)
        SELECT a.o_custkey, a.o_orderkey AS src, b.o_orderkey AS dst FROM p a JOIN p b ON a.o_custkey = b.o_custkey AND b.i = a.i - 1
        UNION ALL SELECT a.o_custkey, a.o_orderkey, b.o_orderkey FROM p a JOIN p b ON a.o_custkey = b.o_custkey AND a.i > 2 AND b.i = a.i // 2""",
    "import_repairs": f"""WITH {_NAMED} SELECT DISTINCT provider, name FROM named n JOIN supplier ON s_suppkey = provider
        WHERE l_linestatus = 'O' AND s_suppkey % 11 <> 0 AND s_acctbal > 0
        AND NOT EXISTS (SELECT 1 FROM named x WHERE x.provider = n.provider AND x.name = n.name AND x.l_returnflag = 'A')
        AND (s_nationkey % 3 = 0 OR EXISTS (SELECT 1 FROM named x WHERE x.provider = n.provider AND x.name = n.name AND x.l_returnflag = 'R'))""",
    "namespace_repairs": """SELECT DISTINCT user_id, epoch_us(ts) // 86400000000 AS day FROM events WHERE (user_id, epoch_us(ts) // 86400000000) NOT IN
        (SELECT user_id, epoch_us(ts) // 86400000000 FROM events WHERE event_type NOT IN ('click', 'view', 'purchase'))""",
    "unused_imports": f"""WITH {_NAMED} SELECT provider, name FROM named WHERE l_returnflag = 'A' EXCEPT SELECT provider, name FROM named WHERE l_returnflag = 'R'""",
    "public_path_claims": r"""WITH p AS (SELECT lower(regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1)) AS path FROM pages)
        SELECT path, count(*) AS claims FROM p GROUP BY path HAVING count(*) > 1""",
    "reference_edges": """SELECT DISTINCT u.l_orderkey AS src, o.owner AS dst FROM lineitem u JOIN (SELECT l_partkey, max(l_orderkey) AS owner FROM lineitem GROUP BY l_partkey) o
        ON u.l_suppkey = o.l_partkey WHERE u.l_orderkey <> o.owner""",
    "lone_references": """WITH e AS (SELECT DISTINCT event_id AS src, event_id + user_id % 9 - 4 AS dst FROM events)
        SELECT src AS a, dst AS b FROM e WHERE src <> dst AND abs(src - dst) <= 3 AND NOT EXISTS (SELECT 1 FROM e x WHERE x.dst = e.dst AND x.src <> e.src AND x.src <> x.dst)""",
    "missing_imports": f"""WITH {_NAMED} SELECT provider, name, l_orderkey, l_linenumber FROM named n JOIN supplier ON s_suppkey = provider WHERE l_returnflag = 'R' AND s_acctbal >= 0
        AND NOT EXISTS (SELECT 1 FROM named x WHERE x.provider = n.provider AND x.name = n.name AND x.l_returnflag = 'A')""",
    "illegal_writes": """SELECT o_custkey, o_orderkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'import' ELSE 'const' END AS kind FROM orders JOIN customer ON c_custkey = o_custkey
        WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')""",
    "identifier_names": r"""WITH w AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size || ' ' || p_type WHEN 1 THEN replace(p_name, ' ', '_') ELSE 'delete' END AS raw FROM part)
        SELECT p_partkey, p_partkey % 3 = 1 AS valid, CASE p_partkey % 3 WHEN 0 THEN '_' || replace(raw, ' ', '') WHEN 1 THEN raw ELSE '_delete' END AS name FROM w""",
    "resolve_paths": r"""WITH p AS (SELECT page_id, url, regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) AS path FROM pages),
        d AS (SELECT *, string_split(path, '/') AS s FROM p)
        SELECT page_id, CASE WHEN len(s) >= 2 THEN array_to_string(list_concat(s[1 : len(s) - 2], ['lib', 'util.js']), '/') END AS resolved,
        regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1) AS file FROM d""",
    "provenance": """SELECT l_orderkey, (length('{"l_orderkey":' || l_orderkey || ',"ranges":[]}') + sum(length('{"start":' || l_linenumber || ',"stop":' || l_partkey || '}')) + count(*) - 1)::INTEGER AS n_chars,
        min(l_linenumber)::INTEGER AS first_start FROM lineitem GROUP BY l_orderkey""",
}
ORACLE_SQL |= modules.ORACLE_SQL | renames.ORACLE_SQL | structure.ORACLE_SQL
