"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are scaled to length 1, so that nearness by distance is nearness by
cosine. Each of several tables concatenates hashes floor((a.v + b) / w) with
normal (2-stable) a. A query visits its own bucket of a table and then the
perturbed buckets in the order of their estimated success: the expected order
over the 2K sorted distances to the cell borders is worked out once, and each
query maps it to its own borders. Candidates of all visited buckets are
compared exactly, and the tables' results are merged.

Equal vectors are indexed once, with their k + 1 smallest ids. Buckets are
routed to cells by hash; a bucket of more than ``cell_rows`` vectors is split
over several cells, and a query that visits it asks each of them. Vectors of
single precision stay so on the way and become double for the comparison. A
query whose buckets hold fewer than k candidates is compared with all vectors,
block by block.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewrack.llm.vectors import QUERY_STEP, best, finite_vectors
from tidewrack.session import materialize

TABLES, HASHES, WIDTH, PROBES, SEED = 8, 8, 2.0, 160, 20240601
CELL_ROWS = 8192

_FOUND = "query_no long, query_id long, vec_id long, score double"


def probe_order(hashes: int, probes: int) -> list[tuple[int, ...]]:
    """Perturbation sets over border ranks 0..2K-1, by their expected summed squared distance to the query.

    Rank j and rank 2K-1-j are the two borders of one hash, so a set that has
    both is no bucket.
    """
    k2 = 2 * hashes
    near = [(j * (j + 1)) / (4 * (hashes + 1) * (hashes + 2)) for j in range(1, hashes + 1)]
    far = [1 - (k2 + 1 - j) / (hashes + 1) + (k2 + 1 - j) * (k2 + 2 - j) / (4 * (hashes + 1) * (hashes + 2)) for j in range(hashes + 1, k2 + 1)]
    cost = near + far
    sets: list[tuple[int, ...]] = [()]
    heap = [(cost[0], (0,))]
    while heap and len(sets) < probes:
        total, top = heapq.heappop(heap)
        if not any(k2 - 1 - j in top for j in top):
            sets.append(top)
        last = top[-1]
        if last + 1 < k2:
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*top[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*top, last + 1)))
    return sets


class Hasher:
    """The tables' hash functions for vectors of one length; the same on every executor."""

    def __init__(self, dim: int, tables: int, hashes: int, width: float, seed: int) -> None:
        rng = np.random.default_rng([seed, dim])
        self.a = rng.normal(size=(tables, hashes, dim))
        self.b = rng.uniform(0, width, size=(tables, hashes))
        self.mix = rng.integers(1, 1 << 62, size=hashes, dtype=np.int64) | 1
        self.width = width

    def positions(self, unit: np.ndarray, table: int) -> np.ndarray:
        return (unit @ self.a[table].T + self.b[table]) / self.width

    def bucket(self, cells: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (cells.astype(np.int64) * self.mix).sum(axis=-1)

    def probes(self, unit: np.ndarray, table: int, order: list[tuple[int, ...]]) -> np.ndarray:
        """Buckets to visit, a row for each vector, most promising first."""
        at = self.positions(unit, table)
        cell = np.floor(at)
        below = at - cell
        n, k = at.shape
        ranks = np.argsort(np.concatenate([below, 1 - below], axis=1), axis=1, kind="stable")
        hash_of, step = ranks % k, np.where(ranks < k, -1, 1)
        out = np.empty((n, len(order)), dtype=np.int64)
        own, lines = self.bucket(cell), np.arange(n)
        with np.errstate(over="ignore"):
            for p, borders in enumerate(order):
                out[:, p] = own
                for j in borders:
                    out[:, p] += self.mix[hash_of[lines, j]] * step[lines, j]
        return out


def _units(vectors: pd.Series) -> np.ndarray:
    full = np.array(vectors.tolist(), dtype=np.float64)
    return full / np.linalg.norm(full, axis=1, keepdims=True)


def _by_length(pdf: pd.DataFrame) -> Iterator[tuple[int, pd.DataFrame]]:
    yield from pdf.groupby(pdf["v"].map(len), sort=True)


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """Each vector once with its ``keep`` smallest ids; a hot vector is cut to that before the shuffle."""
    first = Window.partitionBy("v").orderBy("vec_id")
    few = rows.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= keep)
    return few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def search(
    vectors: DataFrame, k: int = 5, query_step: int = QUERY_STEP, tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH,
    probes: int = PROBES, seed: int = SEED, cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest found of each query by cosine, nearest first.

    Queries are the rows whose vec_id is divisible by ``query_step``; rows with
    the query's id are no candidates of it. Scores are exact cosines in double
    precision on the original vectors; ties go to the smaller id. Where fewer
    than ``k`` candidates exist, all are returned. Null ids,
    null, empty or zero vectors and null or non-finite components take no part;
    a repeated row counts once; only vectors of equal length meet; an empty
    table gives an empty result. Every row is indexed.
    """
    rows = finite_vectors(vectors).where(F.exists("v", lambda x: x != 0))
    given = vectors.schema["embedding"].dataType
    single = "float" if isinstance(given, T.ArrayType) and isinstance(given.elementType, T.FloatType) else "double"
    index = materialize(distinct_vectors(rows, k + 1).withColumn("vec_no", F.xxhash64("v")), "ann-vectors")
    asked = materialize(rows.where(F.col("vec_id") % query_step == 0).select(F.col("vec_id").alias("query_id"), "v", F.xxhash64("vec_id", "v").alias("query_no")), "ann-queries")
    n_cells = max(1, math.ceil(index.count() / cell_rows))
    order = probe_order(hashes, probes)

    def hash_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, part in _by_length(pdf):
                hasher, unit = Hasher(dim, tables, hashes, width, seed), _units(part["v"])
                for t in range(tables):
                    bucket = hasher.bucket(np.floor(hasher.positions(unit, t)))
                    yield pd.DataFrame({"tbl": t, "bucket": bucket, "vec_no": part["vec_no"].to_numpy(), "ids": part["ids"].to_numpy(), "v": part["v"].to_numpy()})

    def probe_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, part in _by_length(pdf):
                hasher, unit = Hasher(dim, tables, hashes, width, seed), _units(part["v"])
                for t in range(tables):
                    yield pd.DataFrame({"tbl": t, "query_no": part["query_no"].to_numpy(), "buckets": list(hasher.probes(unit, t, order))})

    indexed = index.mapInPandas(hash_rows, f"tbl int, bucket long, vec_no long, ids array<long>, v array<{single}>")
    probed = asked.mapInPandas(probe_rows, "tbl int, query_no long, buckets array<long>")
    probed = probed.select("tbl", "query_no", F.explode("buckets").alias("bucket"))
    large = indexed.groupBy("tbl", "bucket").agg(F.ceil(F.count(F.lit(1)) / cell_rows).cast("int").alias("parts")).where("parts > 1")
    parts = F.coalesce("parts", F.lit(1))
    cell = F.pmod(F.xxhash64("bucket", "part"), F.lit(n_cells)).cast("int").alias("cell")
    left = indexed.join(large, ["tbl", "bucket"], "left").withColumn("part", F.pmod(F.col("vec_no"), parts).cast("int")).select("tbl", cell, "bucket", "ids", "v")
    right = probed.join(large, ["tbl", "bucket"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).select("tbl", cell, "bucket", "query_no")
    right = right.groupBy("tbl", "cell", "query_no").agg(F.collect_set("bucket").alias("buckets")).join(asked, "query_no")

    def compare(held: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        for dim, part in _by_length(held) if len(held) and len(queries) else ():
            part = part.sort_values("bucket", kind="stable")
            bucket, ids = part["bucket"].to_numpy(), part["ids"].tolist()
            full = np.array(part["v"].tolist(), dtype=np.float64)
            norm = np.linalg.norm(full, axis=1)
            for number, query_id, buckets, v in zip(queries["query_no"], queries["query_id"], queries["buckets"], queries["v"], strict=True):
                if len(v) != dim:
                    continue
                q = np.asarray(v, dtype=np.float64)
                visited = np.sort(np.asarray(buckets))
                start, stop = np.searchsorted(bucket, visited), np.searchsorted(bucket, visited, side="right")
                at = np.concatenate([np.arange(a, b) for a, b in zip(start, stop, strict=True) if b > a] or [np.empty(0, dtype=np.int64)])
                if not len(at):
                    continue
                near = full[at] @ q / (norm[at] * np.linalg.norm(q))
                if len(at) > k + 1:
                    at = at[near >= np.partition(near, len(near) - k - 1)[len(near) - k - 1] - 1e-9]
                exact = [(-float(np.dot(full[i], q) / (norm[i] * np.linalg.norm(q))), x) for i in at for x in ids[i] if x != query_id]
                out += [(number, query_id, x, -s) for s, x in sorted(exact)[:k]]
        return pd.DataFrame(out, columns=["query_no", "query_id", "vec_id", "score"])

    def nearest(held, queries) -> DataFrame:
        found = held.groupBy("tbl", "cell").cogroup(queries.groupBy("tbl", "cell")).applyInPandas(compare, _FOUND)
        merged = found.groupBy("query_no", "query_id", "vec_id").agg(F.max("score").alias("score"))
        return best(merged, ["query_no", "query_id"], k, F.col("score"))

    top = materialize(nearest(left, right), "ann-found")
    counts = top.groupBy("query_no").agg(F.count(F.lit(1)).alias("n"))
    short = materialize(asked.join(counts, "query_no", "left").where(F.coalesce("n", F.lit(0)) < k).drop("n"), "ann-short")
    result = top.select("query_id", "rank", "vec_id", "score")
    if short.isEmpty():
        return result
    none = F.lit(0).cast("long")
    held = index.select(F.lit(0).alias("tbl"), F.pmod("vec_no", F.lit(n_cells)).cast("int").alias("cell"), none.alias("bucket"), "ids", F.col("v").cast(f"array<{single}>").alias("v"))
    queries = short.select(F.lit(0).alias("tbl"), F.explode(F.sequence(F.lit(0), F.lit(n_cells - 1))).alias("cell"), "query_no", F.array(none).alias("buckets"), "query_id", "v")
    rest = nearest(held, queries).select("query_id", "rank", "vec_id", "score")
    return top.join(short.select("query_no"), "query_no", "left_anti").select("query_id", "rank", "vec_id", "score").unionByName(rest)
