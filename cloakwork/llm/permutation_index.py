"""Nearest neighbours by a permutation index.

Every vector is represented by its nearest pivots, in the order of their nearness.  The
index posts it, with the places of its pivots, in the inverted files of these pivots.
A query reads the files of its own nearest pivots and sums, for each vector in them, the
footrule distance of the two orders: the differences of the places, where a pivot
that one of the two lacks counts as the place after its last.  The vectors of the
least distance are scored on the original vectors in double precision.

The largest inner product is a nearest neighbour of its own kind: each vector gets one
more coordinate that makes all of them as long as the longest, and queries get a zero.

Vectors that are equal are one entry, which keeps as many of its smallest ids as a result
can hold.  The index is cut into blocks of entries; a query is answered by every block,
and the best of the blocks' answers are its result.  Only the pivots, a bounded sample,
are fitted; every row is posted.

Vectors of different lengths have no inner product: each length has an index of its own, and
a query is answered among the vectors of its length.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components
take no part, neither do null ids; rows of equal id and vector are one; equal scores go to the smaller id; fewer candidates than asked for
give fewer rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakwork.llm.shared import smallest_by_hash, staged

NEIGHBOURS = 20
#: The pivots are chosen, far from each other, of a sample `SAMPLED` times as large; a vector
#: is posted in the files of the `PREFIX` nearest.
PIVOTS, SAMPLED, PREFIX = 256, 4, 64
#: The part of a block's entries that is scored, and how many at least.
RERANKED, LEAST = 0.3, 500
BLOCK_ENTRIES, BLOCK_QUERIES = 25_000, 4_000


def valid_vector(vector: str) -> Column:
    """Whether a vector takes part."""
    v = F.col(vector)
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def dot(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows with a row, each summed alike wherever it is computed."""
    return np.einsum("ij,j->i", x, y)


@dataclass
class Pivots:
    vectors: np.ndarray  # unit vectors, with the added coordinate
    longest: float

    def lifted(self, x: np.ndarray, is_query: bool) -> np.ndarray:
        norms = np.linalg.norm(x, axis=1)
        if is_query:
            return np.column_stack([x / norms[:, None], np.zeros(len(x))])
        scaled = x / self.longest
        return np.column_stack([scaled, np.sqrt(np.maximum(0, 1 - (scaled**2).sum(axis=1)))])

    def nearest(self, x: np.ndarray, is_query: bool, prefix: int) -> np.ndarray:
        """Numbers of the nearest pivots of each row, nearest first."""
        near = -(self.lifted(x, is_query) @ self.vectors.T)
        prefix = min(prefix, near.shape[1])
        first = np.argpartition(near, prefix - 1, axis=1)[:, :prefix]
        order = np.argsort(np.take_along_axis(near, first, axis=1), axis=1, kind="stable")
        return np.take_along_axis(first, order, axis=1)


def far_apart(vectors: np.ndarray, n: int) -> np.ndarray:
    """Up to `n` of some unit vectors, each the one farthest from those before; none twice."""
    chosen, distance = [0], np.full(len(vectors), np.inf)
    while len(chosen) < min(n, len(vectors)):
        distance = np.minimum(distance, 1 - vectors @ vectors[chosen[-1]])
        distance[chosen[-1]] = -np.inf
        chosen.append(int(distance.argmax()))
    return vectors[chosen]


def inverted_files(orders: np.ndarray, n_pivots: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pivot the entries that have it and its place among their pivots."""
    prefix = orders.shape[1]
    flat = orders.reshape(-1)
    by_pivot = np.argsort(flat, kind="stable")
    ends = np.searchsorted(flat[by_pivot], np.arange(n_pivots + 1))
    entry, place = by_pivot // prefix, by_pivot % prefix
    return [(entry[a:b], place[a:b]) for a, b in zip(ends[:-1], ends[1:])]


def footrule(files: list, order: np.ndarray, n_entries: int) -> np.ndarray:
    """Distance of the query's order to that of every entry, less what is the same for all.

    A pivot that both have saves, of what it would cost to miss it on either side, all
    but the difference of its places.
    """
    prefix = len(order)
    saved = np.zeros(n_entries, np.int64)
    for place, pivot in enumerate(order.tolist()):
        entries, places = files[pivot]
        saved[entries] += (prefix - place) + (prefix - places) - np.abs(place - places)
    return -saved


def search_block(
    pivots: Pivots, entries: np.ndarray, queries: np.ndarray, k: int, prefix: int = PREFIX
) -> tuple[np.ndarray, np.ndarray]:
    """For each query the places and scores of its best entries in a block, padded with -1."""
    files = inverted_files(pivots.nearest(entries, False, prefix), len(pivots.vectors))
    n = len(entries)
    scored = min(n, max(LEAST, int(np.ceil(RERANKED * n))))
    best, scores = np.full((len(queries), min(k, n)), -1), np.zeros((len(queries), min(k, n)))
    for i, order in enumerate(pivots.nearest(queries, True, prefix)):
        distance = footrule(files, order, n)
        near = np.argpartition(distance, scored - 1)[:scored] if scored < n else np.arange(n)
        near.sort()
        own = dot(entries[near], queries[i])
        top = np.lexsort((near, -own))[: min(k, n)]
        best[i, : len(top)], scores[i, : len(top)] = near[top], own[top]
    return best, scores


def nearest(
    df: DataFrame,
    is_query: Column,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    k: int = NEIGHBOURS,
    n_pivots: int = PIVOTS,
    prefix: int = PREFIX,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row for which `is_query` holds."""
    taken = df.where(valid_vector(vector) & F.col(vec_id).isNotNull()).select(
        F.col(vec_id).cast("long").alias("id"),
        F.transform(vector, lambda x: x.cast("double")).alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    )
    # Lengths are few numbers; those that no query has need no index.
    lengths = taken.where("asks").select(F.size("v").alias("n")).distinct().orderBy("n").collect()
    if not lengths:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    of_each = [_nearest_alike(taken.where(F.size("v") == r["n"]), k, n_pivots, prefix) for r in lengths]
    return reduce(DataFrame.unionByName, of_each)


def _nearest_alike(taken: DataFrame, k: int, n_pivots: int, prefix: int) -> DataFrame:
    """The result of `nearest` among vectors of one length, given as (id, v, asks)."""
    spark = taken.sparkSession
    taken = taken.dropDuplicates(["id", "v"])
    # Of an entry's ids no more than the k + 1 smallest can be in a result.
    copies = Window.partitionBy("v").orderBy("id")
    entries = taken.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1)
    entries = entries.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    entries = staged(entries.withColumn("first", F.col("ids")[0]), "permutation-entries")
    queries = staged(taken.where("asks").select("id", "v"), "permutation-queries")
    n_entries, n_queries = entries.count(), queries.count()
    longest = entries.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))).first()[0]
    sample = smallest_by_hash(entries.select("first", "v"), SAMPLED * n_pivots, "first").collect()
    pivots = Pivots(np.empty(0), longest)
    pivots.vectors = far_apart(pivots.lifted(np.array([r.v for r in sample]), False), n_pivots)
    shared = spark.sparkContext.broadcast(pivots)
    entry_blocks = -(-n_entries // BLOCK_ENTRIES)
    query_blocks = max(1, -(-n_queries // BLOCK_QUERIES))
    placed = entries.withColumn("eb", F.pmod(F.xxhash64("first"), F.lit(entry_blocks))).withColumn(
        "qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))
    )
    asked = queries.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(query_blocks))).withColumn(
        "eb", F.explode(F.sequence(F.lit(0), F.lit(entry_blocks - 1)))
    )

    def search(own: pa.Table, asking: pa.Table) -> pa.Table:
        if not own.num_rows or not asking.num_rows:
            return pa.table({c: [] for c in ("query_id", "vec_id", "score")}, found)
        # Smaller ids first, so that of equal scores the smaller id is taken.
        own = own.sort_by("first")
        lists = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (own["v"], asking["v"])]
        x, q = (np.asarray(c.flatten()).reshape(len(c), -1) for c in lists)
        best, scores = search_block(shared.value, x, q, k + 1, prefix)
        ids, asks = own["ids"].to_pylist(), asking["id"].to_pylist()
        rows: tuple[list, list, list] = ([], [], [])
        for query, near, score in zip(asks, best.tolist(), scores.tolist()):
            expanded = [(-s, i) for e, s in zip(near, score) if e >= 0 for i in ids[e] if i != query]
            for negative, i in sorted(expanded)[:k]:
                rows[0].append(query)
                rows[1].append(i)
                rows[2].append(-negative)
        return pa.table([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.float64())], schema=found)

    found = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
    answers = (
        placed.groupBy("eb", "qb")
        .cogroup(asked.groupBy("eb", "qb"))
        .applyInArrow(search, "query_id long, vec_id long, score double")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
