"""Kernels over edge tables: mutual edges, components, reachability, fixpoints, chains, cycles, export resolution.

Loops run on the driver over DataFrames; every round is a join on hashed keys,
and its result is a table in the shared folder, so lineage stays short. Rounds
grow with a graph's depth (or its logarithm where steps double), never with its
number of nodes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.session import Rounds, materialize


def reference_edges(items: DataFrame, item: str, declared: str, referenced: str) -> DataFrame:
    """Edges (src, dst) from items to the last item that declares a name which they refer to; no self edges."""
    owners = items.select(item, F.explode(declared).alias("_name")).groupBy("_name").agg(F.max(item).alias("dst"))
    uses = items.select(F.col(item).alias("src"), F.explode(referenced).alias("_name"))
    return uses.join(owners, "_name").where("src <> dst").select("src", "dst").distinct()


def mutual(edges: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, with edges both ways."""
    pairs = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), (F.col("src") < F.col("dst")).alias("up"))
    return pairs.groupBy("a", "b").agg(F.max("up").alias("u"), F.min("up").alias("d")).where("u and not d").select("a", "b")


def reachable(edges: DataFrame, seeds: DataFrame, node: str = "node") -> DataFrame:
    """Nodes that the seeds reach along edges (src, dst), themselves included."""
    links = materialize(edges.select("src", "dst").distinct(), "reach-edges")
    found = Rounds(edges.sparkSession, "reach")
    front = found.add(seeds.select(F.col(seeds.columns[0]).alias(node)).distinct())
    while not front.isEmpty():
        step = links.join(front, links["src"] == front[node]).select(F.col("dst").alias(node)).distinct()
        front = found.add(step.join(found.all(), node, "left_anti"))
    return found.all()


def spread_labels(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """node, labels: all labels that each node has or gets along ``links`` (src, dst), as the bits of a long.

    ``seeds`` has node and labels. Where a value is used in a way that tells
    something about it (that it is constructed, say), that holds of the values
    that it is made of too, so links lead from a value to its sources. Labels
    only grow; a round carries on what the round before added.
    """
    links = materialize(links.select("src", "dst").distinct(), "label-links")
    found = Rounds(seeds.sparkSession, "labels")
    last = found.add(seeds.groupBy("node").agg(F.bit_or(F.col("labels").cast("long")).alias("labels")).where("labels <> 0"))

    def all_labels() -> DataFrame:
        return found.all().groupBy("node").agg(F.bit_or("labels").alias("labels"))

    while not last.isEmpty():
        come = links.join(last.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.bit_or("labels").alias("labels"))
        held = all_labels().withColumnRenamed("labels", "_held")
        more = F.col("labels").bitwiseAND(F.bitwise_not(F.coalesce("_held", F.lit(0).cast("long"))))
        last = found.add(come.join(held, "node", "left").select("node", more.alias("labels")).where("labels <> 0"))
    return all_labels()


def condensed(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """src, dst: the edges between strongly connected components; a node that ``parts`` (node, component) lacks is its own."""
    of = lambda x: parts.select(F.col("node").alias(x), F.col("component").alias(f"_{x}"))
    both = edges.join(of("src"), "src", "left").join(of("dst"), "dst", "left")
    ends = both.select(F.coalesce("_src", "src").alias("src"), F.coalesce("_dst", "dst").alias("dst"))
    return ends.where("src <> dst").distinct()


def topological_levels(edges: DataFrame) -> DataFrame:
    """node, level: how many edges the longest path to each node of an acyclic graph (src, dst) has.

    A round pushes the nodes that got a level in the last one over their edges.
    Rounds are as many as the longest path has edges; a cycle raises an error.
    """
    links = materialize(edges.select("src", "dst").distinct(), "level-links")
    nodes = links.select(F.col("src").alias("node")).unionAll(links.select(F.col("dst").alias("node"))).distinct()
    found = Rounds(edges.sparkSession, "levels")
    last, most, level = found.add(nodes.withColumn("level", F.lit(0))), nodes.count(), 0
    while not last.isEmpty():
        level += 1
        if level > most:
            raise ValueError("the graph has a cycle")
        last = found.add(links.join(last.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct().withColumn("level", F.lit(level)))
    return found.all().groupBy("node").agg(F.max("level").alias("level"))


def transitively_pure(nodes: DataFrame, imports: DataFrame) -> DataFrame:
    """Nodes that are pure with all they import, cycles of pure nodes included.

    ``nodes`` has node and pure, ``imports`` src and dst (src imports dst); an
    import that is no node counts as impure. The greatest fixpoint is the
    complement of what impurity reaches backwards.
    """
    impure = nodes.where("not pure").select("node")
    outside = imports.join(nodes.select(F.col("node").alias("dst")), "dst", "left_anti").select(F.col("src").alias("node"))
    back = imports.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return nodes.select("node").join(reachable(back, impure.unionAll(outside)), "node", "left_anti")


def drop_cascade(modules: DataFrame, imports: DataFrame) -> DataFrame:
    """Candidates that go: helpers that are pure and no entry, and that only such modules import.

    ``modules`` has node, helper, entry and pure (null: the module's report is
    missing). One missing report stops every removal. What a kept module imports
    is kept, so the kept ones are what the others reach.
    """
    candidate = F.col("helper") & ~F.col("entry") & F.coalesce(F.col("pure"), F.lit(False))
    kept = modules.where(~candidate).select("node")
    stay = reachable(imports, kept)
    whole = modules.agg(F.count(F.lit(1)).alias("n"), F.count("pure").alias("k")).where("n = k").select(F.lit(True).alias("_whole"))
    gone = modules.where(candidate).select("node").join(stay, "node", "left_anti")
    return gone.join(F.broadcast(whole)).select("node")  # one row or none


def follow_chain(links: DataFrame, limit: int = 64) -> DataFrame:
    """src, final: where following src -> dst ends (the smallest dst, if there are several); sources that run into a cycle are left out.

    Pointers double in every round, so a chain of n links takes log2(n) rounds.
    ``limit`` rounds reach any chain of a table; what still moves then is cyclic.
    """
    now = materialize(links.groupBy("src").agg(F.min("dst").alias("final")), "chain")
    nodes = now.count()
    span = 1
    for _ in range(limit):
        step = now.select(F.col("src").alias("final"), F.col("final").alias("_next"))
        moved = now.join(step, "final", "left").select("src", F.coalesce("_next", "final").alias("final"), F.col("_next").isNotNull().alias("_moved"))
        moved = materialize(moved, "chain")
        span *= 2
        if span > 2 * nodes or moved.where("_moved").isEmpty():
            break
        now = moved.select("src", "final")
    still = now.select(F.col("src").alias("final")).distinct()
    return moved.join(still, "final", "left_anti").select("src", "final")


def least_ancestors(links: DataFrame, label: str) -> DataFrame:
    """node, ``label``: the smallest node that reaches each node of ``links`` (src, dst), itself included.

    A node's label reaches it, and so does the label of that node: labels go one
    edge on and jump to their own label in every round, so rounds grow far less
    than paths.
    """
    nodes = links.select(F.col("src").alias("node")).unionAll(links.select(F.col("dst").alias("node"))).distinct()
    now = materialize(nodes.select("node", F.col("node").alias("c"), F.lit(True).alias("moved")), "labels")
    while True:
        # Only labels that moved can move others over an edge.
        news = now.where("moved")
        if news.isEmpty():
            return now.select("node", F.col("c").alias(label))
        came = links.join(news.select(F.col("node").alias("src"), "c"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("c").alias("d"))
        nxt = now.select("node", F.col("c").alias("was")).join(came, "node", "left").select("node", "was", F.least("was", "d").alias("c"))
        own = nxt.select(F.col("node").alias("c"), F.col("c").alias("j"))
        nxt = nxt.join(own, "c").select("node", F.least("c", "j").alias("c"), (F.least("c", "j") < F.col("was")).alias("moved"))
        now = materialize(nxt, "labels")


def _peeled(links: DataFrame) -> DataFrame:
    """``links`` without edges from nodes that none enters and to nodes that none leaves, as long as a round takes a tenth of them."""
    size = links.count()
    while size:
        ends = links.select(F.col("src").alias("node")).distinct().join(links.select(F.col("dst").alias("node")).distinct(), "node")
        links = materialize(links.join(ends.withColumnRenamed("node", "src"), "src", "left_semi").join(ends.withColumnRenamed("node", "dst"), "dst", "left_semi"), "scc-edges")
        was, size = size, links.count()
        if 10 * size > 9 * was:
            break
    return links


def strong_components(edges: DataFrame, label: str = "component") -> DataFrame:
    """node, component (its smallest node), size: strongly connected components of two nodes or more, and nodes with a self edge.

    Let c be the smallest node that reaches a node. Components lie within nodes
    of one c, and c is the smallest of these. Within them let b be the smallest
    node that a node reaches: where b is c, the node is of c's component. All
    others go on with the edges whose ends agree in c and b. A round settles
    every c, and where paths lead on without a cycle b tells the nodes apart.
    """
    loops = edges.where("src = dst").select(F.col("src").alias("node")).distinct()
    left = _peeled(materialize(edges.where("src <> dst").select("src", "dst").distinct(), "scc-edges"))
    parts = []
    while not left.isEmpty():
        ancestors = least_ancestors(left, "c")

        def within(links: DataFrame, told: DataFrame, name: str) -> DataFrame:
            both = links.join(told.select(F.col("node").alias("src"), name), "src").join(told.select(F.col("node").alias("dst"), F.col(name).alias("_other")), "dst")
            return both.where(F.col(name) == F.col("_other")).select("src", "dst")

        inner = materialize(within(left, ancestors, "c"), "scc-inner")
        reached = least_ancestors(inner.select(F.col("dst").alias("src"), F.col("src").alias("dst")), "b").join(ancestors, "node")
        reached = materialize(reached, "scc-labels")
        parts.append(reached.where("b = c").select("node", F.col("c").alias(label)))
        left = _peeled(materialize(within(inner, reached.where("b <> c"), "b"), "scc-edges"))
    if not parts:
        parts = [loops.select("node", F.col("node").alias(label)).limit(0)]
    settled = reduce(DataFrame.unionAll, parts)
    sizes = settled.groupBy(label).agg(F.count(F.lit(1)).alias("size"))
    large = settled.join(sizes, label).where("size > 1").select("node", label, "size")
    alone = loops.join(large.select("node"), "node", "left_anti").select("node", F.col("node").alias(label), F.lit(1).cast("long").alias("size"))
    return large.unionAll(alone)


def cycle_witnesses(edges: DataFrame) -> DataFrame:
    """component (its smallest node), size, witness: per strongly connected component the shortest closed path through that node.

    Of shortest paths the smallest in order stands. Self edges count only for a
    component of one node. All components search together, a level a round,
    until each has closed its path.
    """
    parts = materialize(strong_components(edges), "witness-parts")
    own = parts.where("size > 1").select("node", "component")
    inner = edges.where("src <> dst").select("src", "dst").distinct()
    inner = inner.join(own.withColumnRenamed("node", "src"), "src").join(own.select(F.col("node").alias("dst"), F.col("component").alias("_other")), "dst").where("component = _other")
    inner = materialize(inner.select("component", "src", "dst"), "witness-edges")
    front = materialize(inner.where("src = component").select("component", F.col("dst").alias("node"), F.array("src", "dst").alias("path")).distinct(), "witness-front")
    seen = front.select("component", "node")
    found = parts.where("size = 1").select("component", "size", F.array("component", "component").alias("witness"))
    sizes = parts.select("component", "size").distinct()
    while not front.isEmpty():
        steps = front.withColumnRenamed("node", "src").join(inner, ["component", "src"])
        closed = steps.where("dst = component").groupBy("component").agg(F.min("path").alias("path"))
        closed = materialize(closed.join(sizes, "component").select("component", "size", F.concat("path", F.array("component")).alias("witness")), "witness-closed")
        found = found.unionAll(closed)
        nxt = steps.join(closed.select("component"), "component", "left_anti").groupBy("component", F.col("dst").alias("node")).agg(F.min("path").alias("path"))
        nxt = nxt.join(seen, ["component", "node"], "left_anti").select("component", "node", F.concat("path", F.array("node")).alias("path"))
        front = materialize(nxt, "witness-front")
        seen = materialize(seen.unionAll(front.select("component", "node")), "witness-seen")
    return found


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of the undirected graph of ``edges`` (src, dst).

    Two steps alternate until nothing changes: every node points its larger
    neighbours to the smallest node it sees, then its smaller neighbours too.
    Rounds grow with the logarithm of a component's diameter; each is a table in
    the shared folder. Nodes with self edges only are components of their own.
    """
    links = edges.where("src <> dst")
    now = materialize(links.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "cc")
    state = None
    while True:
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.bit_xor(F.xxhash64("v", "u")).alias("y")).first()
        if seen == state:  # the edges are stars, and the steps return them
            break
        state = seen
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        now = materialize(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "cc")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    linked = now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
    alone = edges.where("src = dst").select(F.col("src").alias("node")).distinct().join(linked, "node", "left_anti")
    return linked.unionAll(alone.select("node", F.col("node").alias("component")))
