"""Approximate nearest neighbours with a permutation index.

Pivots are vectors that lie far apart. A vector is represented by its ``PREFIX`` nearest
pivots in order. In every shard these lists are posted in one inverted file per pivot
(which vectors have it, at which position); a query walks the files of its own pivots,
adds up what they say about the Spearman footrule distance between the two orders, and
the nearest ``SHARE`` of the shard is compared exactly.

With positions from 0 and ``PREFIX`` for a pivot that is missing, the footrule distance is
a constant less 2 * (PREFIX - the larger position) for each pivot that both lists hold,
so only shared pivots need a look.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Pivots, chosen from this many vectors (those with the smallest hash of their id).
PIVOTS, PIVOT_SAMPLE = 256, 4096
#: Pivots in a vector's list.
PREFIX = 128
#: Part of each shard that is compared exactly, and so is all that is nearer than CLOSE times the median footrule distance.
SHARE, CLOSE = 0.1, 0.3
#: Vectors of a shard and queries of a block, about: together they are one group's memory.
SHARD, BLOCK = 16384, 4096


def spread(sample: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` distinct vectors of a sample, each as far as possible from those before it."""
    chosen = [0]
    nearest = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < count and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def orders(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """For each vector its nearest pivots, nearest first, ties to the earlier pivot."""
    squares = (vectors**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * vectors @ pivots.T
    return np.argsort(squares, 1, kind="stable")[:, :prefix]


def inverted(lists: np.ndarray, pivots: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pivot the vectors whose list holds it, and at which position."""
    prefix = lists.shape[1]
    order = np.argsort(lists.ravel(), kind="stable")
    ends = np.searchsorted(lists.ravel()[order], np.arange(pivots + 1))
    return [(order[a:b] // prefix, order[a:b] % prefix) for a, b in zip(ends, ends[1:])]


def footrules(own: np.ndarray, files: list[tuple[np.ndarray, np.ndarray]], size: int) -> np.ndarray:
    """The footrule distance of a query's list to every vector of the inverted files."""
    prefix = len(own)
    shared = np.zeros(size, np.int64)
    for position, pivot in enumerate(own):
        rows, positions = files[pivot]
        shared[rows] += prefix - np.maximum(position, positions)
    return prefix * (prefix + 1) - 2 * shared


def search(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, pivots: np.ndarray, k: int, share: float) -> tuple:
    """The ``k`` nearest found of one shard for each query, as arrays (query id, id, distance)."""
    prefix = min(PREFIX, len(pivots))
    files, lists = inverted(orders(vectors, pivots, prefix), len(pivots)), orders(queries, pivots, prefix)
    wanted = min(len(ids), max(10 * k, int(np.ceil(share * len(ids)))))
    found = []
    for query_id, query, own in zip(query_ids, queries, lists):
        distance = footrules(own, files, len(ids))
        limit = max(np.partition(distance, wanted - 1)[wanted - 1], CLOSE * np.median(distance))
        near = np.flatnonzero((distance <= limit) & (ids != query_id))
        exact = np.sqrt(((vectors[near] - query) ** 2).sum(1))
        best = near[(order := np.lexsort((ids[near], exact))[:k])]
        found.append((np.full(len(best), query_id), ids[best], exact[order]))
    return tuple(np.concatenate(part) for part in zip(*found)) if found else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)


def _vectors(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids, lists = table["vec_id"].to_numpy(), table["embedding"].combine_chunks()
    return ids, lists.flatten().to_numpy().reshape(len(ids), -1)


def nearest(embeddings: DataFrame, k: int = 10, every: int = 100, share: float = SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by ``every`` its ``k`` nearest other vectors.

    ``score`` is the Euclidean distance in double precision, ``rank`` counts from 1, ties go
    to the smaller vec_id. All rows are indexed. Rows with a null vec_id, and vectors that
    are null, empty or zero, hold a null, NaN or infinite component, or have another length
    than most (on a tie the shorter), take no part. Rows that share a query's vec_id are
    not its neighbours; of several such rows the smallest vector is the query. Repeated
    other rows are neighbours each. Other columns play no part; without queries or
    neighbours there are no rows.
    """
    vectors = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    fit = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    vectors = vectors.filter(F.col("vec_id").isNotNull() & F.coalesce(fit, F.lit(False)) & F.exists("embedding", lambda x: x != 0))
    lengths = vectors.groupBy(F.size("embedding").alias("length")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "length").first()
    if lengths is None:
        return embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    vectors = vectors.filter(F.size("embedding") == lengths["length"])
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(PIVOT_SAMPLE).collect()
    pivots = spread(np.array([row["embedding"] for row in sample]), PIVOTS)

    shards = max(1, -(-lengths["n"] // SHARD))
    queries = vectors.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    blocks = max(1, -(-lengths["n"] // (every * BLOCK)))
    indexed = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(shards)))
    indexed = indexed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        else:
            found = search(*_vectors(left), *_vectors(right), pivots, k, share)
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())})

    cells = indexed.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block"))
    found = cells.applyInArrow(cell, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
