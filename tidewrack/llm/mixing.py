"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source is cut into blocks of about equal words by a seeded hash of its
rows, so a hot source simply has more blocks. A source's target fixes how many
passes over its permuted blocks the mix makes: whole passes, then the first
blocks of one more permutation, the last of them opened and taken row by row. Those
exact block quotas are split among the output shards by a binary tree: at every
node the left half's counts are one multivariate-hypergeometric draw from the
node's counts. Leaves then draw disjoint runs of the source's permuted blocks,
and rows are shuffled inside their shard by a seeded hash.

The driver sees one row per block and source (``blocks`` bounds the first, and
``max_sources`` is checked for the second), and per source the sums of some
hundred hash ranges and the hashes of at most FILL_MOST rows; documents never
leave the executors, and no join shuffles them.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.llm.tables import WORD_SEPARATORS
from tidewrack.session import materialize

#: The weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: No document is taken more often than this.
MAX_REPEATS = 3
#: A source's last words are filled row by row from about so many rows, and at most FILL_MOST.
FILL_ROWS, FILL_MOST = 256, 1024
#: Rows on either side of the place where a source's words are reached, which are chosen by their sums.
WINDOW = 24
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


@dataclass
class Plan:
    """What the mix takes: per source its target, per block its passes and shards, per open block what is taken of it."""

    source: list[str | None] = field(default_factory=list)
    size: list[int] = field(default_factory=list)
    target: list[float] = field(default_factory=list)
    #: (source index, block, pass, shard); the pass of a source's open blocks is -1.
    units: list[tuple[int, int, int, int]] = field(default_factory=list)


def words(column: Column) -> Column:
    """The number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(column, F.lit(f"[^{WORD_SEPARATORS}]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], max_repeats: int = MAX_REPEATS) -> list[float]:
    """Shares of all words by weight, none above ``max_repeats`` times its source; the excess is shared again by weight."""
    out = [0.0] * len(sizes)
    left, open_ = float(sum(sizes)), [i for i, s in enumerate(sizes) if s > 0]
    while open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / total > max_repeats * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = float(max_repeats * sizes[i])
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def _rng(*key: object) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.sha256(repr(key).encode()).digest()[:8], "big"))


def split_quotas(quota: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Units of each source (columns) for each shard (rows); columns add up to ``quota`` and rows are near equal."""
    out = np.zeros((shards, len(quota)), dtype=np.int64)
    nodes = [(0, shards, quota.astype(np.int64))]
    while nodes:
        first, count, here = nodes.pop()
        if count == 1:
            out[first] = here
            continue
        left = count // 2
        draw = int(here.sum()) * left // count
        taken = _rng(seed, "node", first, count).multivariate_hypergeometric(here, draw, method="marginals")
        nodes += [(first, left, taken), (first + left, count - left, here - taken)]
    return out


def _narrow(docs: DataFrame, seed: int = 0) -> DataFrame:
    return docs.select("doc_id", "source", words(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("row_hash"))


def with_blocks(narrow: DataFrame, sources: DataFrame) -> DataFrame:
    """Join the source's index and number of blocks, and add each row's block."""
    from_source = F.broadcast(sources)  # at most max_sources rows
    return narrow.join(from_source, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn(
        "block", F.pmod(F.xxhash64("row_hash"), F.col("n_blocks")).cast("int")
    )


def make_plan(narrow: DataFrame, weights=WEIGHTS, blocks: int = 4096, shards: int = 16, seed: int = 0, max_sources: int = 100_000) -> tuple[Plan, DataFrame, DataFrame]:
    """The plan, the source table (index, sizes, target) and the block table (takes and limits), both small."""
    spark = narrow.sparkSession
    totals = narrow.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).limit(max_sources + 1).collect()
    if len(totals) > max_sources:
        raise ValueError(f"more than {max_sources} sources; raise max_sources")
    totals.sort(key=lambda r: (r.source is None, (r.source or "").encode("utf-32-be")))
    plan = Plan([r.source for r in totals], [r["size"] for r in totals])
    plan.target = targets(plan.size, [float(weights[i % len(weights)]) for i in range(len(totals))])
    all_words = max(1, sum(plan.size))
    n_blocks = [max(1, min(r.n, round(blocks * r["size"] / all_words))) for r in totals]
    source_rows = [(s, i, z, t, b) for i, (s, z, t, b) in enumerate(zip(plan.source, plan.size, plan.target, n_blocks, strict=True))]
    sources = spark.createDataFrame(source_rows, "_source string, source_idx int, source_size long, target double, n_blocks int")
    blocked = with_blocks(narrow, sources)
    held: list[dict[int, tuple[int, int]]] = [{} for _ in totals]
    for r in blocked.groupBy("source_idx", "block").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect():  # one row per block
        held[r.source_idx][r.block] = (r["size"], r.n)
    units: list[list[tuple[int, int]]] = []
    cut: dict[int, tuple[list[int], float]] = {}
    for i, (size, target) in enumerate(zip(plan.size, plan.target, strict=True)):
        mine: list[tuple[int, int]] = []
        if size:
            passes = int(target // size + 1e-9)
            rest = target - passes * size
            names = sorted(held[i])
            for p in range(passes):
                mine += [(int(b), p) for b in _rng(seed, "pass", i, p).permutation(names)]
            order = [int(b) for b in _rng(seed, "pass", i, passes).permutation(names)] if rest >= 0.5 and passes < MAX_REPEATS else []
            whole = 0
            while whole < len(order) and held[i][order[whole]][0] <= rest:
                mine.append((order[whole], passes))
                rest -= held[i][order[whole]][0]
                whole += 1
            if rest >= 0.5 and whole < len(order):
                # Few rows cannot come near the rest: whole blocks are opened again, and later ones too, until there are enough.
                first, last = whole, whole + 1
                while sum(held[i][b][1] for b in order[first:last]) < FILL_ROWS and (first or last < len(order)):
                    if last < len(order):
                        last += 1
                    else:
                        first -= 1
                        rest += held[i][order[first]][0]
                        mine.pop()
                cut[i] = (order[first:last], rest)
                mine.append((order[first], -1))
        units.append(mine)
    per_shard = split_quotas(np.array([len(u) for u in units], dtype=np.int64), shards, seed)
    for i, mine in enumerate(units):
        shard_of = np.repeat(np.arange(shards), per_shard[:, i])
        plan.units += [(i, b, p, int(k)) for (b, p), k in zip(mine, shard_of, strict=True)]
    return plan, sources, _block_table(spark, blocked, plan, cut)


def _block_table(spark, blocked: DataFrame, plan: Plan, cut: dict[int, tuple[list[int], float]]) -> DataFrame:
    """Per block: the shards of its whole passes, and for an open block the rows (by hash) of its part and their shard."""
    below, hashes = _fill(spark, blocked, cut) if cut else ({}, {})
    shards: dict[tuple[int, int], list[int]] = {}
    part: dict[tuple[int, int], int] = {}
    for i, b, p, k in plan.units:
        if p == -1:
            part |= {(i, x): k for x in cut[i][0]}
        else:
            shards.setdefault((i, b), []).append(k)
    rows = [(i, b, shards.get((i, b), []), part.get((i, b)), below.get(i) if (i, b) in part else None, hashes.get((i, b), [])) for i, b in sorted({*shards, *part})]
    return spark.createDataFrame(rows, "source_idx int, block int, shards array<int>, part_shard int, part_below long, part_hashes array<long>")


def _fill(spark, blocked: DataFrame, cut: dict[int, tuple[list[int], float]]) -> tuple[dict[int, int], dict[tuple[int, int], list[int]]]:
    """What is taken of the open blocks: per source all rows of smaller hashes than a bound, and per block some single rows.

    The bound is found byte by byte from the sums of hash ranges, so the driver
    sees some hundred ranges per source and byte, however large a block is. The
    range in which the bound falls, of FILL_ROWS rows or some more, is filled row by row.
    """
    wanted = F.broadcast(spark.createDataFrame([(i, b) for i, (bs, _) in cut.items() for b in bs], "source_idx int, block int"))  # at most FILL_ROWS per source
    opened = blocked.join(wanted, ["source_idx", "block"]).select("source_idx", "block", "row_hash", "size")
    ranges = {i: (_LOW, _HIGH, rest) for i, (_, rest) in cut.items()}
    large = {r.source_idx for r in opened.groupBy("source_idx").count().where(F.col("count") > FILL_MOST).collect()}
    for shift in range(56, -1, -8):
        if not large:
            break
        bounds = spark.createDataFrame([(i, ranges[i][0], ranges[i][1]) for i in sorted(large)], "source_idx int, low long, high long")
        inside = opened.join(F.broadcast(bounds), "source_idx").where("row_hash between low and high")  # one row per source
        sums: dict[int, list] = {i: [] for i in large}
        for r in inside.groupBy("source_idx", F.shiftright("row_hash", shift).alias("at")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect():
            sums[r.source_idx].append((r.at, r["size"], r.n))
        for i, found in sums.items():
            found.sort()
            rest, k = ranges[i][2], 0
            while k < len(found) - 1 and found[k][1] <= rest:
                rest -= found[k][1]
                k += 1
            stop = k + 1
            while sum(n for *_, n in found[k:stop]) < FILL_ROWS and stop < len(found):
                stop += 1
            ranges[i] = (found[k][0] << shift, ((found[stop - 1][0] + 1) << shift) - 1, rest)
            if sum(n for *_, n in found[k:stop]) <= FILL_MOST:
                large.discard(i)
    bounds = spark.createDataFrame([(i, *r) for i, r in sorted(ranges.items())], "source_idx int, low long, high long, rest double")
    items = opened.join(F.broadcast(bounds), "source_idx").where("row_hash between low and high").groupBy("source_idx", "rest", "block", "row_hash").agg(F.sum("size").alias("size"))
    chosen: dict[tuple[int, int], list[int]] = {}
    for r in items.groupBy("source_idx").applyInPandas(_choose, "source_idx int, block int, hashes array<long>").collect():  # at most FILL_MOST per source, but for distinct rows of one hash
        chosen[r.source_idx, r.block] = r.hashes
    return {i: r[0] for i, r in ranges.items()}, chosen


def _choose(pdf):
    """Rows of one source whose sizes add up to about what it still lacks.

    Rows are taken in hash order as long as they fit; the last WINDOW of them
    and as many that follow are then chosen anew, by the reachable sums.
    """
    pdf = pdf.sort_values("row_hash", kind="stable")
    size, rest = pdf["size"].to_numpy().astype(np.int64), float(pdf["rest"].iloc[0])
    fit = int(np.searchsorted(np.cumsum(size), rest, side="right"))
    first = max(0, min(fit - WINDOW, len(size) - 2 * WINDOW))
    taken = np.arange(len(size)) < first
    taken[first : first + 2 * WINDOW] = nearest_subset(size[first : first + 2 * WINDOW], rest - float(size[:first].sum()))
    return pdf[taken].groupby(["source_idx", "block"], as_index=False).agg(hashes=("row_hash", list))


def nearest_subset(sizes: np.ndarray, want: float, most: int = 1 << 22) -> np.ndarray:
    """A mask of sizes whose sum is nearest ``want``; sums above ``most`` are told apart less finely."""
    unit = max(1, -(-int(sizes.sum()) // most))
    steps = [int(round(s / unit)) for s in sizes]
    reach = [1]  # bit k: some of the sizes so far add up to k
    for s in steps:
        reach.append(reach[-1] | reach[-1] << s)
    goal = min(max(round(want / unit), 0), sum(steps))
    below = (reach[-1] & ((2 << goal) - 1)).bit_length() - 1
    above = reach[-1] >> goal
    above = goal + (above & -above).bit_length() - 1
    at = below if want / unit - below <= above - want / unit else above
    mask = np.zeros(len(sizes), dtype=bool)
    for k in range(len(steps) - 1, -1, -1):
        if not reach[k] >> at & 1:
            mask[k] = True
            at -= steps[k]
    return mask


def place(narrow: DataFrame, sources: DataFrame, block_table: DataFrame) -> DataFrame:
    """Add ``shards``, one entry per time the mix takes the row, and ``taken``, its words in the mix."""
    blocked = with_blocks(narrow, sources)
    joined = blocked.join(F.broadcast(block_table), ["source_idx", "block"], "left")  # at most a row per block
    in_part = (F.col("row_hash") < F.col("part_below")) | F.array_contains("part_hashes", F.col("row_hash"))
    part = F.when(in_part, F.array("part_shard")).otherwise(F.array().cast("array<int>"))
    takes = F.concat(F.coalesce("shards", F.array().cast("array<int>")), part)
    none = F.array().cast("array<int>")
    return joined.withColumn("shards", F.when(F.col("size") > 0, F.coalesce(takes, none)).otherwise(none)).withColumn("taken", F.size("shards") * F.col("size")).drop("part_shard", "part_below", "part_hashes")


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, then copies and shards.

    A null or wordless text has size 0 and is never taken; a null source is a
    source of its own and comes last. Repeated rows stand and fall together.
    Texts count whole, however long; extra columns play no part.
    An empty table gives an empty result. Reruns with one seed agree.
    """
    narrow = materialize(_narrow(docs, seed=options.get("seed", 0)), "mix-rows")
    _, sources, blocks = make_plan(narrow, **options)
    placed = place(narrow, sources, blocks)
    return placed.select("doc_id", "size", "source_size", "target", "taken", F.size("shards").alias("copies"), "shards")


def _copies(docs: DataFrame, **options) -> DataFrame:
    """_row, mix_shard, mix_order: each row as often as it is taken."""
    seed = options.get("seed", 0)
    narrow = materialize(_narrow(docs, seed=seed), "mix-rows")
    _, sources, blocks = make_plan(narrow, **options)
    hashed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "source", words(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("row_hash")
    )
    placed = place(hashed, sources, blocks)
    taken = placed.select("_row", "row_hash", F.posexplode("shards").alias("_copy", "mix_shard"))
    return taken.select("_row", "mix_shard", F.xxhash64(F.lit(seed), "mix_shard", "row_hash", "_copy").alias("mix_order"))


def taken_rows(docs: DataFrame, **options) -> DataFrame:
    """Each row of ``docs`` as often as the mix takes it, with its columns whatever their names."""
    return _copies(docs, **options).select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row as often as it is taken, with its columns and ``mix_shard``, ``mix_order``, which replace columns of these names.

    Writing it partitioned by ``mix_shard`` and sorted by ``mix_order`` gives
    the shards, each shuffled locally; repeats have orders of their own.
    """
    own = [c for c in docs.columns if c.lower() not in ("mix_shard", "mix_order")]
    return _copies(docs, **options).select(*[F.col("_row").getField(c).alias(c) for c in own], "mix_shard", "mix_order")
