"""N-gram Jaccard self-join with adaptive multi-match prefixes.

Two documents link when 4 |A and B| >= 3 |A or B| over their sets of five-word
shingles. The steps:

1. Profile: every document's set size and set key, and the shingles that are
   heavy in some task. Equal sets become one class from here on.
2. Frequencies: shingles, packed by partition of the hash space, are counted
   exactly. Hot ones, a bounded list, stay out of that shuffle, so no partition
   holds one. A class keeps the shingles that another class has too; a class
   with fewer of them than a link needs is done.
3. Prefixes: shingles are ordered by rarity. The l-prefix of a set of n has
   n - ceil(0.75 n) + l shingles, and linked documents share l of them. Every
   class picks the l with the least estimated cost: postings to read, plus
   candidates to verify if each needs l matches.
4. Pivots: in two rounds, classes that share a rare shingle are compared with
   one pivot of that shingle's list. A group of near copies becomes a family
   around its pivot, without all its pairs.
5. Join: families meet on shared prefix shingles; pairs with enough matches are
   verified exactly. Jaccard distance is a metric, so a verified distance
   between two pivots rules out links between members when it exceeds the link
   distance and both members' distances; of two other families, the smaller
   one's members become outer members of the larger. Inside a family, classes
   that are not linked to the pivot can only link by shingles that the pivot
   lacks, and are joined on those.
6. Components over all verified links, by label propagation.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.llm.components import connected_components
from tidewrack.llm.shingles import set_key, shingle_set
from tidewrack.llm.tables import in_small_batches, maybe_in, release, slices
from tidewrack.session import materialize

#: A link: NUM * |union| <= DEN * |intersection|.
NUM, DEN = 3, 4
#: Shingles counted in one partition, about.
PART_SHINGLES = 1_500_000
#: A shingle with about this share of a partition's postings, and in so much of all documents, is hot and is spread over partitions.
HOT_SHARE, HOT_DOCUMENTS = 1 / 32, 1 / 20_000
#: Text from which one packed row per partition is made.
POSTINGS_BYTES = 6 << 20
#: The longest prefix extension.
MOST_MATCHES = 8
#: Cost of verifying a candidate, in postings for each shingle of the set.
VERIFY_COST = 0.25

#: Rounds in which far members of a family look for one other component each; what they leave is compared in full.
MERGING_ROUNDS = 2

_LINK = 1 - NUM / DEN


def _sets_of(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [shingle_set(x.as_py()) for x in batch.column(batch.schema.get_field_index("text"))]


class Heavy:
    """Lossy counts of shingles over a task's documents, after which no shingle in more than ``share`` of them is missing.

    ``low`` counts what was seen and ``high`` adds what can have been forgotten.
    An entry goes as soon as ``high`` falls to the allowed share, so the state
    has about as many entries as 1 / share documents have shingles.
    """

    def __init__(self, share: float) -> None:
        self.share, self.docs = share, 0
        self.keys, self.low, self.high = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64), np.empty(0)

    def add(self, sets: list[np.ndarray]) -> None:
        if self.share >= 1 or not sets:
            return
        new, counts = np.unique(np.concatenate(sets), return_counts=True)
        keys, at = np.unique(np.concatenate([self.keys, new]), return_inverse=True)
        low, high = np.zeros(len(keys), dtype=np.int64), np.full(len(keys), self.share * self.docs)
        old = at[: len(self.keys)]
        low[old], high[old] = self.low, self.high
        low[at[len(self.keys) :]] += counts
        high[at[len(self.keys) :]] += counts
        self.docs += len(sets)
        held = high > self.share * self.docs
        self.keys, self.low, self.high = keys[held], low[held], high[held]


def profile(docs: DataFrame, share: float, digest: bool = False) -> DataFrame:
    """doc_id, n (set size), cls (set key; null without words), and on one row per task its heavy shingles with counts.

    Heavy are those in more than ``share`` of the task's documents. With
    ``digest``, also the column _digest of ``docs``.
    """
    carried = ["_digest"] if digest else []
    names = ["doc_id", "n", "cls", *carried]

    def rows(batch: pa.RecordBatch, sets: list[np.ndarray], keys: list) -> list[pa.Array]:
        own = {"n": pa.array([len(s) for s in sets], pa.int64()), "cls": pa.array(keys, pa.int64())}
        return [own[c] if c in own else batch.column(batch.schema.get_field_index(c)) for c in names]

    def with_lists(columns: list[pa.Array], shingles: list | None, counts: list | None) -> pa.RecordBatch:
        lists = [pa.array([x] + [None] * (len(columns[0]) - 1), pa.list_(pa.int64())) for x in (shingles, counts)]
        return pa.RecordBatch.from_arrays(columns + lists, names=[*names, "often", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, last = Heavy(share), None
        for batch in batches:
            for part in slices(batch):
                sets = _sets_of(part)
                keys = [set_key(s) if len(s) else None for s in sets]
                heavy.add(list({k: s for k, s in zip(keys, sets, strict=True) if k is not None}.values()))
                if last is not None:
                    yield with_lists(last, None, None)
                last = rows(part, sets, keys)
        if last is not None:
            yield with_lists(last, heavy.keys.view(np.int64).tolist(), heavy.low.tolist())
        release()

    return in_small_batches(docs).select("doc_id", "text", *carried).mapInArrow(run, "doc_id long, n long, cls long" + (", _digest long" if digest else "") + ", often array<long>, counts array<long>")


def hot_shingles(profiled: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles with at least ``least`` counted postings, sorted, and those counts; each is in at least HOT_DOCUMENTS of all documents, so the list is bounded by the shingles of 1 / HOT_DOCUMENTS of them."""
    rows = profiled.where("often is not null").select(F.explode(F.arrays_zip("often", "counts")).alias("x")).groupBy("x.often").agg(F.sum("x.counts").alias("df")).where(F.col("df") >= least).collect()
    shingles = np.array([r.often for r in rows], dtype=np.int64).view(np.uint64)
    order = np.argsort(shingles)
    return shingles[order], np.array([r.df for r in rows], dtype=np.int64)[order]


_POSTINGS = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("lengths", pa.binary()), ("shingles", pa.binary())])
_SHARED = "cls long, df long, shingle long"


def postings(docs: DataFrame, often: object, parts: int) -> DataFrame:
    """A slice's shingles of one partition of the hash space, packed by class.

    Copies within a slice are packed once. Hot shingles need no counting and go
    to the partitions below 0, spread over them by slice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = often.value[0]
        for part in (part for batch in batches for part in slices(batch, POSTINGS_BYTES)):
            first: dict[int, np.ndarray] = {}
            for s in _sets_of(part):
                if len(s):
                    first.setdefault(set_key(s), s)
            if not first:
                continue
            keys = np.fromiter(first, dtype=np.int64, count=len(first))
            shingles = np.concatenate(list(first.values()))
            own = np.repeat(np.arange(len(keys)), [len(s) for s in first.values()])
            to = (shingles % np.uint64(parts)).astype(np.int64)
            if len(hot):
                at = np.minimum(np.searchsorted(hot, shingles), len(hot) - 1)
                to[hot[at] == shingles] = -1 - int(keys[0] % parts)
            order = np.argsort(to, kind="stable")
            shingles, own, to = shingles[order], own[order], to[order]
            edges = [0, *(np.flatnonzero(np.diff(to)) + 1), len(to)]
            rows = []
            for a, b in zip(edges, edges[1:], strict=False):
                who, lengths = np.unique(own[a:b], return_counts=True)
                rows.append((int(to[a]), keys[who].tobytes(), lengths.astype(np.uint32).tobytes(), shingles[a:b].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _POSTINGS.types, strict=True)], schema=_POSTINGS)
        release()

    return in_small_batches(docs).select("text").mapInArrow(run, "part int, keys binary, lengths binary, shingles binary")


def _first_of_runs(*columns: np.ndarray) -> np.ndarray:
    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def shared_shingles(docs: DataFrame, often: tuple[np.ndarray, np.ndarray], parts: int) -> DataFrame:
    """cls, df, shingle: for every class the shingles that other classes have too, with their frequency."""
    sent = docs.sparkSession.sparkContext.broadcast(often)  # bounded, see hot_shingles

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        shingles = np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in pdf["shingles"]])
        keys = np.concatenate([np.repeat(np.frombuffer(k, dtype=np.int64), np.frombuffer(n, dtype=np.uint32)) for k, n in zip(pdf["keys"], pdf["lengths"], strict=True)])
        order = np.argsort(shingles, kind="stable")
        shingles, keys = shingles[order], keys[order]
        if pdf["part"].iloc[0] < 0:
            hot, counts = sent.value
            return pd.DataFrame({"cls": keys, "df": counts[np.searchsorted(hot, shingles)], "shingle": shingles.view(np.int64)})
        start = np.flatnonzero(_first_of_runs(shingles))
        size = np.diff(np.append(start, len(shingles)))
        many = np.repeat(size > 1, size)
        shingles, keys = shingles[many], keys[many]
        order = np.lexsort((keys, shingles))  # one class can come from several batches
        shingles, keys = shingles[order], keys[order]
        new = _first_of_runs(shingles, keys)
        shingles, keys = shingles[new], keys[new]
        start = np.flatnonzero(_first_of_runs(shingles))
        size = np.diff(np.append(start, len(shingles)))
        df = np.repeat(size, size)
        keep = df > 1
        return pd.DataFrame({"cls": keys[keep], "df": df[keep], "shingle": shingles[keep].view(np.int64)})

    return postings(docs, sent, parts).groupBy("part").applyInPandas(count, _SHARED)


def candidates_of(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """cls, n, shingles (shared ones, rarest first), dfs: the classes that have enough shared shingles for a link."""
    lists = shared.groupBy("cls").agg(F.array_sort(F.collect_set(F.struct("df", "shingle"))).alias("x"))
    kept = lists.join(classes.select("cls", "n"), "cls").where(DEN * F.size("x") >= NUM * F.col("n"))
    return kept.select("cls", F.col("n").cast("int").alias("n"), F.col("x.shingle").alias("shingles"), F.col("x.df").alias("dfs"))


def choose_prefix(n: int, dfs: np.ndarray) -> tuple[int, int]:
    """The matches to ask for, and how many of the shared shingles (rarest first) the prefix holds.

    The prefix of l matches has n - ceil(0.75 n) + l of all n shingles. Those
    that no other class has come first and meet nobody. Its estimated cost is
    the postings that it reads, plus one verification for every l of them.
    """
    need = -(-NUM * n // DEN)
    alone = n - len(dfs)
    reads = np.cumsum(dfs - 1)
    best_cost, choice = math.inf, (1, 0)
    for matches in range(1, min(MOST_MATCHES, need) + 1):
        held = n - need + matches - alone
        read = float(reads[held - 1]) if held > 0 else 0.0
        cost = read + read / matches * VERIFY_COST * n
        if cost < best_cost:
            best_cost, choice = cost, (matches, max(held, 0))
    return choice


def prefixes(candidates: DataFrame) -> DataFrame:
    """Rows (shingle, cls, n, matches, weight) of every class's prefix; weight is the mean frequency of its shingles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for cls, n, shingles, dfs in zip(pdf["cls"], pdf["n"], pdf["shingles"], pdf["dfs"], strict=True):
                matches, held = choose_prefix(int(n), np.asarray(dfs))
                if held:
                    out.append(pd.DataFrame({"shingle": np.asarray(shingles)[:held], "cls": cls, "n": n, "matches": matches, "weight": float(np.sum(dfs)) / n}))
            if out:
                yield pd.concat(out, ignore_index=True)

    return candidates.mapInPandas(run, "shingle long, cls long, n int, matches int, weight double")


def _common() -> Column:
    """The shingles that two sets have in common; those of one class only cannot be among them."""
    return F.size(F.array_intersect("sa", "sb")).cast("long")


def verified(pairs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Add common (exact size of the intersection), dist (Jaccard distance) and linked to pairs (a, b, ...)."""
    sets = candidates.select("cls", F.col("n").cast("long").alias("n"), "shingles")
    left = sets.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").withColumn("common", _common()).drop("sa", "sb")
    union = F.col("na") + F.col("nb") - F.col("common")
    return both.withColumn("dist", 1 - F.col("common") / union).withColumn("linked", DEN * F.col("common") >= NUM * union).drop("na", "nb")


def pivot_round(prefix: DataFrame, candidates: DataFrame, label: str) -> DataFrame:
    """Compare every class of ``prefix`` with the pivot it meets most; pairs (a, b, common, dist, linked), b the pivot.

    A shingle's pivot is the heaviest class in its list: the text from which
    near copies were made has more of their shingles than any of them has.
    Comparisons grow with the lists' lengths and not with their squares.
    """
    pivots = prefix.groupBy("shingle").agg(F.max(F.struct("weight", "cls")).alias("p"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    met = prefix.join(pivots, "shingle").where(F.col("cls") != F.col("p.cls")).groupBy("cls", "p").agg(F.count(F.lit(1)).alias("c"))
    most = met.groupBy(F.col("cls").alias("a")).agg(F.max(F.struct("c", "p")).alias("m")).select("a", F.col("m.p.cls").alias("b"))
    return materialize(verified(most, candidates), label)


def families(candidates: DataFrame, compared: DataFrame) -> DataFrame:
    """cls, n, fam, c, r, near: the nearest pivot within half the distance range, and what the class has of it.

    Other classes are families of their own. ``near`` says that the class is
    linked to its family's pivot.
    """
    best = compared.groupBy("a").agg(F.min_by(F.struct("b", "common", "dist", "linked"), "dist").alias("x")).where("x.dist <= 0.5")
    joined = candidates.select("cls", F.col("n").cast("long").alias("n")).join(best, F.col("cls") == F.col("a"), "left")
    return joined.select(
        "cls", "n", F.coalesce("x.b", "cls").alias("fam"), F.coalesce("x.common", "n").alias("c"),
        F.coalesce("x.dist", F.lit(0.0)).alias("r"), F.coalesce("x.linked", F.lit(True)).alias("near"),
    )


def _side(rows: DataFrame, name: str, *kept: str) -> DataFrame:
    """The columns of one side of a pair: cls becomes ``name``, the others get it as a suffix."""
    return rows.select("shingle", F.col("cls").alias(name), *[F.col(k).alias(k + name) for k in kept])


def _sizes_fit(low_a: str, high_a: str, low_b: str, high_b: str) -> Column:
    return (DEN * F.col(high_a) >= NUM * F.col(low_b)) & (DEN * F.col(high_b) >= NUM * F.col(low_a))


def _enough(pairs: DataFrame) -> DataFrame:
    """Pairs that share at least the smaller of the matches that their prefixes ask for."""
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.min(F.least("matchesa", "matchesb")).alias("m")).where("c >= m").select("a", "b")


def _could_reach(common: Column, sizes: Column) -> Column:
    """Whether sets of these summed sizes could link with so many common shingles."""
    return (NUM + DEN) * common >= NUM * sizes


def _across(rows: DataFrame, members: DataFrame, candidates: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Links between pivots, and between members and other pivots; and (fam, cls, n, c, near), classes that stay near another family.

    Those are compared with that family's members by ``_within``, as outer
    members. Of two families that stay near each other, the members of the
    smaller one are compared with the larger one's pivot, so that no join meets
    the members of a large family with all its neighbours.
    """
    grouped = rows.groupBy("shingle", F.col("fam").alias("cls")).agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("matches").alias("matches"))
    left, right = (_side(grouped, x, "low", "high", "matches") for x in "ab")
    pairs = left.join(right, "shingle").where((F.col("a") < F.col("b")) & _sizes_fit("lowa", "higha", "lowb", "highb"))
    met = materialize(verified(_enough(pairs), candidates), "pivot-pairs")
    # Members are ruled out by the verified distances to their pivots, and by sizes: of members x and y of the
    # pivots g and h, |x and y| <= |g and h| + |x without g| + |y without h|.
    extra = F.col("n") - F.col("c")
    radius = members.groupBy("fam").agg(F.max("r").alias("r"), F.min("near").alias("all_near"), F.max(extra).alias("extra"), F.min("n").alias("least"), F.count(F.lit(1)).alias("size"), F.max(F.col("fam") != F.col("cls")).alias("many"))
    radius = materialize(radius.where("many"), "radii")  # a pivot can be in another family itself, so its own may have one member only

    def of(x: str) -> DataFrame:
        return radius.select(F.col("fam").alias(x), F.col("r").alias("r" + x), F.col("all_near").alias("n" + x), F.col("extra").alias("e" + x), F.col("least").alias("l" + x), F.col("size").alias("s" + x))

    zero, yes = F.lit(0.0), F.lit(True)
    wide = met.join(of("a"), "a", "left").join(of("b"), "b", "left")
    wide = wide.where((F.col("dist") <= _LINK + F.coalesce("ra", zero) + F.coalesce("rb", zero) + 1e-9) & (F.col("ra").isNotNull() | F.col("rb").isNotNull()))
    wide = materialize(wide.where(~(F.col("linked") & F.coalesce("na", yes) & F.coalesce("nb", yes))), "wide-pairs")
    single = wide.where("rb is null").select(F.col("a").alias("fam"), F.col("b").alias("cls"), "common", "linked").unionAll(wide.where("ra is null").select(F.col("b").alias("fam"), F.col("a").alias("cls"), "common", "linked"))
    both = wide.where("ra is not null and rb is not null").where(_could_reach(F.col("common") + F.col("ea") + F.col("eb"), F.col("la") + F.col("lb")))
    larger = F.col("sa") >= F.col("sb")
    large = F.when(larger, F.struct(F.col("a").alias("fam"), F.col("ra").alias("r"), F.col("ea").alias("extra"), F.col("la").alias("least"))).otherwise(F.struct(F.col("b").alias("fam"), F.col("rb").alias("r"), F.col("eb").alias("extra"), F.col("lb").alias("least")))
    turned = both.select(F.when(larger, F.col("b")).otherwise(F.col("a")).alias("fam"), large.alias("large"), "dist", "common")
    reach = (F.col("dist") <= _LINK + F.col("r") + F.col("large.r") + 1e-9) & _could_reach(F.col("common") + extra + F.col("large.extra"), F.col("n") + F.col("large.least"))
    asked = members.join(turned, "fam").where(reach).select(F.col("cls").alias("a"), F.col("large.fam").alias("b"), F.col("large.r").alias("reach"))
    checked = materialize(verified(asked, candidates), "outer-members")
    outer = single.unionAll(checked.where(F.col("dist") <= _LINK + F.col("reach") + 1e-9).select(F.col("b").alias("fam"), F.col("a").alias("cls"), "common", "linked"))
    outer = outer.join(candidates.select("cls", F.col("n").cast("long").alias("n")), "cls").select("fam", "cls", "n", F.col("common").alias("c"), F.col("linked").alias("near"))
    return [met.where("linked").select("a", "b"), checked.where("linked").select("a", "b")], outer


def _labelled(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """``rows`` with comp, the component that the links ``edges`` put their class in."""
    reached = connected_components(edges).select(F.col("node").alias("cls"), F.col("component").alias("_comp"))
    return rows.drop("comp").join(reached, "cls", "left").withColumn("comp", F.coalesce("_comp", "cls")).drop("_comp")


def _mixed_lists(rows: DataFrame) -> DataFrame:
    """The rows of the lists (fam, shingle) that hold classes of several components; the others can link nothing that is not linked yet."""
    mixed = rows.groupBy("fam", "shingle").agg(F.min("comp").alias("_low"), F.max("comp").alias("_high")).where("_low <> _high").select("fam", "shingle")
    return rows.join(mixed, ["fam", "shingle"], "left_semi")


def _need(na: Column, ca: Column, nb: Column, cb: Column) -> Column:
    """Of the shingles that a link needs in common, those that the pivot cannot give."""
    return F.ceil(NUM * (na + nb) / (NUM + DEN)) - F.least(ca, cb)


def _merging_round(extra: DataFrame, candidates: DataFrame) -> DataFrame:
    """Links (a, b) of classes with the largest class of another component that they meet most, over the lists of ``extra``.

    A list's largest class stands for it; classes of that one's component meet
    the largest of the others. Comparisons grow with the lists' lengths.
    """
    who = F.struct("n", "c", "cls", "comp")
    first = extra.groupBy("fam", "shingle").agg(F.max(who).alias("p"))
    told = extra.join(first, ["fam", "shingle"])
    second = told.where(F.col("comp") != F.col("p.comp")).groupBy("fam", "shingle").agg(F.max(who).alias("q"))
    met = told.join(second, ["fam", "shingle"]).withColumn("o", F.when(F.col("comp") == F.col("p.comp"), F.col("q")).otherwise(F.col("p")))
    need = _need(F.col("n"), F.col("c"), F.col("o.n"), F.col("o.c"))
    counted = met.groupBy("fam", F.col("cls").alias("a"), F.col("o.cls").alias("b")).agg(F.count(F.lit(1)).alias("k"), F.first(need).alias("need")).where("k >= need")
    most = counted.groupBy("a").agg(F.slice(F.sort_array(F.collect_list(F.struct("k", "b")), asc=False), 1, 2).alias("x")).select("a", F.explode("x.b").alias("b")).distinct()
    return verified(most, candidates).where("linked").select("a", "b")


def _within(rows: DataFrame, members: DataFrame, outer: DataFrame, candidates: DataFrame, edges: DataFrame) -> list[DataFrame]:
    """Links of classes that are far from their family's pivot with others of the family, outer members included.

    With c the shingles that a class has of the pivot, two members x and y have
    at most min(c_x, c_y) of the pivot's in common. A link needs 3 (n_x + n_y)
    / 7 common shingles; what the pivot cannot give must be shared shingles that
    the pivot lacks, and those are rare. Only where the pivot could give all,
    which takes an unusually short member, the prefixes decide. Only pairs that
    ``edges`` and the merging rounds before have not connected yet are looked
    at, so a group that shares what its pivot lacks is not compared pair by pair.
    """
    all_ = members.select("fam", "cls", "n", "c", "near", F.lit(False).alias("outer")).unionAll(outer.select("fam", "cls", "n", "c", "near", F.lit(True).alias("outer")))
    far = all_.where("not near")
    spare = F.floor((NUM + DEN) * F.col("c") / NUM) - F.col("n")
    limits = far.groupBy("fam").agg(F.max(spare).alias("most"))
    least = all_.join(limits, "fam").groupBy("fam").agg(F.min("n").alias("least"), F.first("most").alias("most"))
    held = materialize(_labelled(all_.join(least, "fam").withColumn("spare", spare), edges), "far-families")
    if held.isEmpty():
        return []

    sets = candidates.select("cls", "shingles")
    pivots = candidates.select(F.col("cls").alias("fam"), F.col("shingles").alias("pivot"))
    extra = held.where("fam <> cls").join(sets, "cls").join(pivots, "fam").withColumn("shingle", F.explode(F.array_except("shingles", "pivot"))).drop("shingles", "pivot").withColumn("matches", F.lit(1))
    extra, found = materialize(_mixed_lists(extra), "far-shingles"), []
    for _ in range(MERGING_ROUNDS):
        merged = materialize(_merging_round(extra, candidates), "far-links")
        if merged.isEmpty():
            break
        found.append(merged)
        edges = edges.unionAll(merged)
        extra = materialize(_mixed_lists(_labelled(extra, edges)), "far-shingles")
    if found:
        held = materialize(_labelled(held, edges), "far-families")

    def pair_up(some: DataFrame) -> tuple[DataFrame, DataFrame]:
        left, right = (_side(some, x, "n", "c", "fam", "near", "outer", "spare", "matches", "comp") for x in "ab")
        return left.where("not neara"), right.withColumnRenamed("famb", "fama")

    one_way = (F.col("a") != F.col("b")) & (F.col("nearb") | (F.col("a") < F.col("b"))) & ~(F.col("outera") & F.col("outerb")) & (F.col("compa") != F.col("compb"))
    left, right = pair_up(extra)
    need = _need(F.col("na"), F.col("ca"), F.col("nb"), F.col("cb"))
    counted = left.join(right, ["shingle", "fama"]).where(one_way & _sizes_fit("na", "na", "nb", "nb")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("k"), F.first(need).alias("need"))
    by_extra = verified(counted.where("k >= need").select("a", "b"), candidates)
    short = rows.select("shingle", "cls", "matches").join(held, "cls").where((~F.col("near") & (F.col("spare") >= F.col("least"))) | ((~F.col("outer") | F.col("near")) & (F.col("n") <= F.col("most"))))
    left, right = pair_up(_mixed_lists(short))
    pairs = left.join(right, ["shingle", "fama"]).where(one_way & (F.col("nb") <= F.col("sparea")) & (F.col("na") <= F.col("spareb")) & _sizes_fit("na", "na", "nb", "nb"))
    by_prefix = verified(_enough(pairs), candidates)
    return [*found, by_extra.where("linked").select("a", "b"), by_prefix.where("linked").select("a", "b")]


def links(candidates: DataFrame, prefix: DataFrame) -> DataFrame:
    """Verified links (a, b) that connect exactly the classes that all links connect."""
    first = pivot_round(prefix, candidates, "pivots0")
    done = first.where("linked").select(F.col("a").alias("cls")).unionAll(first.select(F.col("b").alias("cls"))).distinct()
    second = pivot_round(prefix.join(done, "cls", "left_anti"), candidates, "pivots1")
    compared = first.unionAll(second)
    members = materialize(families(candidates, compared), "families")
    rows = materialize(prefix.drop("weight", "n").join(members, "cls"), "prefixes-by-family")
    between, outer = _across(rows, members, candidates)
    edges = compared.where("linked").select("a", "b")
    for more in between:
        edges = edges.unionAll(more)
    edges = materialize(edges.distinct(), "links")
    for more in _within(rows, members, outer, candidates, edges):
        edges = edges.unionAll(more)
    return materialize(edges.distinct(), "links")


def _grouped(docs: DataFrame, part_shingles: int, digest: bool = False) -> tuple[DataFrame, DataFrame]:
    """The profile of ``docs``; and cls, rep (smallest doc_id), component (any key) of every class."""
    rows = docs.count()
    least = max(2, int(part_shingles * HOT_SHARE), int(rows * HOT_DOCUMENTS))
    # Of a shingle's postings at most ``least`` are in tasks where it is not heavy, so none of 2 * least is missed.
    profiled = materialize(profile(docs, least / max(1, rows), digest), "profile")
    often = hot_shingles(profiled, least)
    classes = profiled.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"))
    total = classes.agg(F.sum("n")).first()[0] or 0
    parts = max(1, math.ceil(total / part_shingles))
    candidates = materialize(candidates_of(shared_shingles(docs, often, parts), classes), "candidates")
    edges = links(candidates, materialize(prefixes(candidates), "prefixes"))
    reached = connected_components(edges)
    return profiled, classes.join(reached, F.col("cls") == F.col("node"), "left").select("cls", "rep", F.coalesce("component", "cls").alias("component"))


def similar_groups(docs: DataFrame, part_shingles: int = PART_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id: every document with the smallest doc_id that its links reach.

    Null and wordless texts have no shingles, link with nothing and are their
    own component; fewer than five words count as one shingle. Documents of
    equal sets are one class. Rows with a null doc_id take part; a component of only such rows
    has a null id. Repeated rows stay. An empty table gives an empty result.
    """
    profiled, least = _grouped(docs, part_shingles)
    names = least.groupBy("component").agg(F.min("rep").alias("component_id"))
    ids = least.join(names, "component").select("cls", "component_id")
    return profiled.select("doc_id", F.col("n").alias("n_shingles"), "cls").join(ids, "cls", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest doc_id (nulls last), then set key, then text digest.

    Rows without links stay, among them those whose doc_id another text has too.
    Null and wordless texts are in no component: all such rows stay, repeated
    ones too. Of rows with equal doc_id and equal text that has words one stays.
    An empty table gives an empty result. Columns may have any names. Texts are
    shuffled only where a row may go: the others are told apart by a broadcast
    of bounded size.
    """
    digest = F.xxhash64("text")
    profiled, least = _grouped(docs.select("doc_id", "text", digest.alias("_digest")), PART_SHINGLES, digest=True)
    worded = profiled.where("cls is not null").select("doc_id", "_digest", "cls")
    # Decided by class and then by component, so that a large component is reduced before any join.
    lead = least.groupBy("component").agg(F.min(F.struct(F.col("rep").isNull().alias("last"), "rep", "cls")).alias("x"))
    decided = least.join(lead, "component").select("cls", "rep", (F.col("cls") == F.col("x.cls")).alias("leads"))
    rows = materialize(worded.join(decided, "cls"), "rows-by-class")
    first = rows.where(F.col("leads") & F.col("doc_id").eqNullSafe(F.col("rep"))).groupBy("cls").agg(F.min("_digest").alias("first"))
    later = rows.join(first, "cls", "left").where(~F.col("leads") | ~F.col("doc_id").eqNullSafe(F.col("rep")) | (F.col("_digest") != F.col("first")))
    gone = later.select("doc_id", "_digest", F.lit(True).alias("goes")).distinct()
    twice = rows.groupBy("doc_id", "_digest").count().where("count > 1").select("doc_id", "_digest", F.lit(False).alias("goes"))
    # A row that goes does so however often it is there.
    marked = gone.unionAll(twice).groupBy(F.col("doc_id").alias("of"), F.col("_digest").alias("text_of")).agg(F.max("goes").alias("goes"))
    marked = materialize(marked, "marked-rows")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), digest.alias("digest"))
    hit, untouched = maybe_in(packed, F.xxhash64("id", "digest"), marked, F.xxhash64("of", "text_of"))
    told = hit.join(marked, F.col("id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("text_of")), "left").select("row", "id", "digest", "goes")
    single = told.where("goes is null").select("row")
    one = told.where("not goes").groupBy("id", "digest").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row")).select("row")
    kept = untouched.select("row").unionAll(single).unionAll(one)
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
