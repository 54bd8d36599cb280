"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order of nearness. Inverted files post,
per pivot, the vectors that have it among their nearest ones, with its rank. A query walks
the files of its own nearest pivots and sums up, per vector found, how far the footrule
distance of the two orders falls below its maximum; the best share of a block and a fixed
number more are compared by the inner product itself, one rule at every size.

Pivots are ``PIVOTS`` vectors chosen by a hash of their id (a bounded sample); every row is
indexed. Largest inner product becomes smallest angle by one more coordinate, the root of
the greatest squared norm less the own, which is 0 for queries. Orders are taken on vectors
scaled by a power of two near their greatest component, so that no square overflows.

Queries and vectors are dealt into blocks by a hash of the id; a pair of blocks is one
task, which builds the inverted files of its vectors and hands back the best of each query.
Memory is bounded by the block sizes, and a query's results are merged from one short list
per block.

Defined cases: vectors that are null, empty, zero or hold a component that is null or not
finite take no part, nor do rows without id; vectors of different length have no inner
product, so each length is an index of its own; products beyond the range of doubles are
infinite, and one that is not a number ranks last; a query's own id is never its neighbour; a repeated id is asked once, but each of its rows is a candidate
for others; ties go to the smaller id; fewer candidates than asked for give them all; an
empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biparta.llm.vectors import is_vector, matrix
from biparta.session import materialize

PIVOTS = 512
NEAREST_PIVOTS = 128
SEED = 17
# Compared exactly: this share of a block, and this many times the number asked for.
SHARE = 0.1
EXTRA = 10
BLOCK_ROWS = 16_384
BLOCK_QUERIES = 2_048


def lift(x: np.ndarray, top: float) -> np.ndarray:
    """Append the coordinate that gives all rows the norm ``top``."""
    return np.hstack([x, np.sqrt(np.maximum(top * top - (x * x).sum(axis=1, keepdims=True), 0))])


def permutations(x: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """Per row its nearest pivots, nearest first."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :nearest]


def inverted_files(perm: np.ndarray, n_pivots: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per pivot the rows that list it and its rank there."""
    order = np.argsort(perm.ravel(), kind="stable")
    cuts = np.searchsorted(perm.ravel()[order], np.arange(n_pivots + 1))
    rows, ranks = order // perm.shape[1], (order % perm.shape[1]).astype(np.int32)
    return [(rows[a:b], ranks[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def footrule_gain(q: np.ndarray, files: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """Half of what the footrule distance of each row lies below its maximum.

    A pivot that a row does not list ranks just after its last one; a shared pivot of
    ranks r and s lowers the distance by 2 (k - max(r, s)).
    """
    k, gain = len(q), np.zeros(n, np.int32)
    for r, p in enumerate(q):
        rows, ranks = files[p]
        gain[rows] += k - np.maximum(ranks, r)
    return gain


class Index(NamedTuple):
    """What all blocks of vectors of one length share; pivots and top are of scaled vectors."""

    pivots: np.ndarray
    scale: float
    top: float
    nearest: int


def search_block(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, index: Index, k: int, share: float, extra: int) -> Iterator[tuple]:
    """``(query id, ids, scores)`` of each query's best rows of one block."""
    listed = min(index.nearest, len(index.pivots))
    files = inverted_files(permutations(lift(x / index.scale, index.top), index.pivots, listed), len(index.pivots))
    asked = permutations(np.hstack([q / index.scale, np.zeros((len(q), 1))]), index.pivots, listed)
    m = extra * k + int(np.ceil(share * len(ids)))
    for i in range(len(q_ids)):
        if m < len(ids):
            gain = footrule_gain(asked[i], files, len(ids))
            # ties at the edge are all compared
            edge = np.partition(gain, len(ids) - m)[len(ids) - m]
            rows = np.flatnonzero(gain >= edge)
        else:
            rows = np.arange(len(ids))
        rows = rows[ids[rows] != q_ids[i]]
        with np.errstate(over="ignore", invalid="ignore"):
            score = x[rows] @ q[i]
        best = np.lexsort((ids[rows], -score))[:k]
        yield q_ids[i], ids[rows[best]], score[best]


def squared_norm(v: Column, scale: float) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + (x / F.lit(scale)) * (x / F.lit(scale)))


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    n_pivots: int = PIVOTS,
    nearest_pivots: int = NEAREST_PIVOTS,
    share: float = SHARE,
    extra: int = EXTRA,
    block_rows: int = BLOCK_ROWS,
    block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest found of each query row."""
    raw = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    valid = materialize(raw.filter(F.col("vec_id").isNotNull() & is_vector(F.col("v"))).withColumn("d", F.size("v")), "vectors")
    result = "query_id bigint, vec_id bigint, score double"
    greatest = F.max(F.array_max(F.transform("v", F.abs))).alias("greatest")
    lengths = [r for r in valid.groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("q"), greatest).collect() if r["q"]]
    if not lengths:
        return valid.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    indexes = {}
    for r in lengths:
        same = valid.filter(F.col("d") == r["d"])
        scale = 2.0 ** (math.frexp(r["greatest"])[1] - 1)
        top = math.sqrt(same.agg(F.max(squared_norm(F.col("v"), scale)).alias("m")).first()["m"])
        picked = same.orderBy(F.xxhash64(F.lit(SEED), "vec_id"), "vec_id").select("v").limit(n_pivots).collect()
        indexes[r["d"]] = Index(lift(np.array([p["v"] for p in picked]) / scale, top), scale, top, nearest_pivots)

    of_length = lambda counts: F.element_at(F.create_map(*[F.lit(c) for pair in counts for c in pair]), F.col("d"))
    n_blocks = of_length([(r["d"], -(-r["n"] // block_rows)) for r in lengths])
    n_asks = of_length([(r["d"], -(-r["q"] // block_queries)) for r in lengths])
    slot = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "vec_id"), n.cast("bigint")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))
    known = valid.filter(F.col("d").isin([r["d"] for r in lengths]))
    data = known.select("d", "vec_id", "v", slot(n_blocks, 1).alias("b"), every(n_asks).alias("a"))
    # columns of their own names: both sides of the cogroup come from one table
    asks = known.filter("asks").dropDuplicates(["vec_id"]).select(
        F.col("d").alias("q_d"), F.col("vec_id").alias("q_id"), F.col("v").alias("q"), slot(n_asks, 2).alias("a"), every(n_blocks).alias("b")
    )

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            x, q = matrix(left["v"]), matrix(right["q"])
            out = list(search_block(left["vec_id"].to_numpy(), x, right["q_id"].to_numpy(), q, indexes[x.shape[1]], k, share, extra))
        q = np.concatenate([np.full(len(i), a) for a, i, _ in out]) if out else np.zeros(0, np.int64)
        ids = np.concatenate([i for _, i, _ in out]) if out else q
        s = np.concatenate([x for _, _, x in out]) if out else np.zeros(0)
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(s, pa.float64())})

    found = data.groupBy("d", "a", "b").cogroup(asks.groupBy("q_d", "a", "b")).applyInArrow(search, result)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.nanvl("score", F.lit(-math.inf)).desc(), F.col("vec_id").asc()))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
