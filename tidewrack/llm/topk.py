"""Exact top-k search by exhaustive term-at-a-time accumulation.

Candidates and queries are dealt into a grid of cells of bounded size (a block
of candidates by a block of queries). A cell inverts its candidates into
postings per term; each sparse query row scatters its weighted postings into a
dense array of scores; a partition selection keeps the k best, and the partial
results of the cells are merged. The work is the product of the two sides, as
an exhaustive search must be, but no cell grows with the input.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.llm.vectors import QUERY_STEP, best, finite_vectors
from tidewrack.session import materialize

#: Candidates and queries of a cell.
CANDIDATE_BLOCK = 8192
QUERY_BLOCK = 4096
#: Components are turned into floor(SCALE * x).
SCALE = 256

_PARTIAL = "query_id long, query_no long, vec_id long, score long"


def postings(rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per term, the candidates that have it and their weights."""
    out = []
    for term in rows.T:
        held = np.flatnonzero(term)
        out.append((held, term[held]))
    return out


def accumulate(query: np.ndarray, lists: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """Scores of all candidates, one term of the query after the other."""
    scores = np.zeros(n, dtype=np.int64)
    for term in np.flatnonzero(query[: len(lists)]):
        held, weights = lists[term]
        scores[held] += query[term] * weights
    return scores


def select(scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores; of equal ones the smallest positions."""
    if len(scores) <= k:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > least)
    return np.concatenate([above, np.flatnonzero(scores == least)[: k - len(above)]])


def _matrix(vectors: pd.Series) -> np.ndarray:
    width = max(map(len, vectors))
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def search(vectors: DataFrame, k: int = 5, query_step: int = QUERY_STEP, candidate_block: int = CANDIDATE_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (long): the ``k`` highest inner products of each query.

    ``vectors`` has vec_id and embedding; every component x counts as
    floor(256 * x). Queries are the rows whose id is divisible by
    ``query_step``; rows with the query's id are no candidates of it. Ties go to
    the smaller id. A query with fewer than k candidates returns all. Vectors of
    different lengths compare as if the shorter ended in zeros. Null ids, null
    or empty vectors and non-finite components take no part; a repeated row
    counts once, and rows of one id with different vectors count each; an empty
    table gives an empty result. Sums are 64-bit integers: floor(256 * x) beyond
    64 bits saturates, and products that leave 64 bits wrap around.
    """
    rows = materialize(finite_vectors(vectors).select("vec_id", F.transform("v", lambda x: F.floor(x * F.lit(float(SCALE))).cast("long")).alias("v")), "topk-vectors")
    queries = rows.where(F.col("vec_id") % query_step == 0).withColumn("query_no", F.xxhash64("vec_id", "v"))
    n, q = rows.count(), queries.count()
    n_blocks, q_blocks = max(1, math.ceil(n / candidate_block)), max(1, math.ceil(q / query_block))

    def every(count: int):
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    left = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int")).withColumn("query_block", every(q_blocks))
    right = queries.withColumn("query_block", F.pmod(F.col("query_no"), F.lit(q_blocks)).cast("int")).withColumn("block", every(n_blocks))

    def cell(candidates: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(candidates) or not len(asked):
            return pd.DataFrame({"query_id": [], "query_no": [], "vec_id": [], "score": []}, dtype="int64")
        candidates = candidates.sort_values("vec_id", kind="stable")
        ids, lists, found = candidates["vec_id"].to_numpy(), postings(_matrix(candidates["v"])), []
        for query_id, number, v in zip(asked["vec_id"], asked["query_no"], asked["v"], strict=True):
            scores = accumulate(np.asarray(v, dtype=np.int64), lists, len(ids))
            others = np.flatnonzero(ids != query_id) if query_id in ids else None
            at = select(scores, k) if others is None else others[select(scores[others], k)]
            found.append(pd.DataFrame({"query_id": query_id, "query_no": number, "vec_id": ids[at], "score": scores[at]}))
        return pd.concat(found, ignore_index=True)

    cells = left.groupBy("block", "query_block").cogroup(right.groupBy("block", "query_block")).applyInPandas(cell, _PARTIAL)
    return best(cells, ["query_id", "query_no"], k, F.col("score")).select("query_id", "rank", "vec_id", "score")
