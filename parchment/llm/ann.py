"""Nearest neighbours by collision-counting hashing.

A block of vectors is indexed by m random projections, each a sorted array. A query opens a window around its own
projection in every array and widens all windows with the search radius (virtual rehashing: the same arrays serve every
radius). A vector that falls into enough windows is verified on the original vectors. A vector within the radius collides
in a projection with a fixed probability, so the threshold is set to lose one with probability MISS at most; the search
of a block ends when the k-th verified distance lies within the radius, and takes everything where windows cover the block.

Every chunk of queries meets every block of rows once, as a group of its own: a task holds one block and one chunk, a block's
arrays are sorted once for all queries of the chunk, and neither side is broadcast or collected. While blocks are few, the
queries are cut into more chunks, so that there are enough groups for all executors.
"""

from __future__ import annotations

from math import erf, sqrt
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parchment.llm.common import discard, materialise, read
from parchment.llm.vectors import matrix, usable

K = 10
PROJECTIONS = 48
#: Half of a window's width, as a multiple of the search radius.
WIDTH = 1.0
#: Probability that a vector within the radius stays below the threshold.
MISS = 0.1
#: Factor between search radii, and the first one as a share of the block's typical distance.
GROWTH, FIRST = 1.3, 0.05
#: Rows of a block and queries of a chunk at most; groups to aim at, and the queries that are worth sorting a block for.
BLOCK_ROWS, CHUNK_ROWS, GROUPS, LEAST_ROWS = 8192, 4096, 24, 64


def threshold(m: int = PROJECTIONS, width: float = WIDTH, miss: float = MISS) -> int:
    """Collisions that a vector within the radius reaches with probability 1 - miss."""
    p = erf(width / sqrt(2))
    return max(1, int(m * p + NormalDist().inv_cdf(miss) * sqrt(m * p * (1 - p))))


class Index:
    """Sorted projections of a block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, m: int = PROJECTIONS, seed: int = 11) -> None:
        self.ids, self.vectors, self.m = ids, vectors, m
        self.axes = np.random.default_rng([seed, vectors.shape[1]]).standard_normal((vectors.shape[1], m))
        on = vectors @ self.axes
        order = np.argsort(on, axis=0, kind="stable")
        # all arrays in one, each shifted beyond the one before, so that one search serves all projections
        self.most = float(np.abs(on).max(initial=0.0)) + 1.0
        self.shift = np.arange(m) * (2 * self.most + 1)
        self.order = np.ascontiguousarray(order.T).astype(np.int32).ravel()
        self.values = (np.take_along_axis(on, order, axis=0).T + self.shift[:, None]).ravel()
        self.scale = sqrt(2 * max(float(vectors.var(axis=0).sum()), 1e-300))

    def nearest(self, query: int, vector: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the k nearest found, the query's own id left out; ties go to the smaller id."""
        n, need = len(self.ids), threshold(self.m)
        at = vector @ self.axes
        first, last = np.arange(self.m) * n, (np.arange(self.m) + 1) * n
        left = np.searchsorted(self.values, np.clip(at, -self.most, self.most) + self.shift)
        right, count, done = left.copy(), np.zeros(n, np.int64), self.ids == query
        found, distance = np.zeros(0, np.int64), np.zeros(0)
        radius = self.scale * FIRST
        while True:
            low = np.searchsorted(self.values, np.clip(at - WIDTH * radius, -self.most, self.most) + self.shift, "left")
            high = np.searchsorted(self.values, np.clip(at + WIDTH * radius, -self.most, self.most) + self.shift, "right")
            low, high = np.minimum(low, left), np.maximum(high, right)
            fresh = [self.order[a:b] for a, b in zip(low, left, strict=True) if a < b] + [self.order[a:b] for a, b in zip(right, high, strict=True) if a < b]
            if fresh:
                count += np.bincount(np.concatenate(fresh), minlength=n)
            left, right = low, high
            full = bool((left == first).all() and (right == last).all())
            new = np.flatnonzero(~done if full else (count >= need) & ~done)
            if len(new):
                done[new] = True
                gap = self.vectors[new] - vector
                found, distance = np.concatenate([found, new]), np.concatenate([distance, np.sqrt((gap * gap).sum(axis=1))])
                best = np.lexsort((self.ids[found], distance))[:k]
                found, distance = found[best], distance[best]
            if full or done.all() or (len(found) == k and distance[-1] <= radius):
                return self.ids[found], distance
            radius *= GROWTH


def _probe(k: int):
    def run(block: pa.Table, chunk: pa.Table) -> pa.Table:
        hits = []
        if block.num_rows and chunk.num_rows:
            index = Index(block["id"].to_numpy().astype(np.int64), matrix(block["vector"]))
            hits = [(q, *index.nearest(q, v, k)) for q, v in zip(chunk["id"].to_pylist(), matrix(chunk["vector"]), strict=True)]
        none = np.zeros(0)
        return pa.table(
            {
                "query_id": pa.array(np.concatenate([np.full(len(i), q, np.int64) for q, i, _ in hits] or [none]), pa.int64()),
                "vec_id": pa.array(np.concatenate([i for _, i, _ in hits] or [none]), pa.int64()),
                "score": pa.array(np.concatenate([d for _, _, d in hits] or [none])),
            }
        )

    return run


def nearest(table: DataFrame, queries: Column, k: int = K, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance): for each row that queries selects its k nearest other rows.

    queries is a condition on table's columns. Vectors that are null, zero or hold null or non-finite components, and rows
    of null id, take no part; vectors of another dimension than the query's are no candidates. Ties go to the smaller id;
    a query with fewer than k candidates has them all. Rows that repeat an id are searched once, with the largest of its vectors.
    No usable rows, or no queries, give no rows; other columns play no part.
    """
    base = table.where(F.col(vec_id).isNotNull() & usable(F.col(vector)))
    base = base.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks"))
    base = materialise(base.groupBy("id").agg(F.max("vector").alias("vector"), F.max("asks").alias("asks")).withColumn("dim", F.size("vector")))
    # blocks and chunks of each dimension: a row for each dimension that occurs
    rows, asked = F.count("*"), F.count_if("asks")
    blocks = F.ceil(rows / F.lit(BLOCK_ROWS))
    chunks = F.greatest(F.ceil(asked / F.lit(CHUNK_ROWS)), F.least(F.ceil(F.lit(GROUPS) / blocks), F.ceil(asked / F.lit(LEAST_ROWS))))
    dims = base.groupBy("dim").agg(blocks.cast("int").alias("blocks"), chunks.cast("int").alias("chunks")).where("chunks > 0")
    spread = base.join(F.broadcast(dims), "dim")
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys = ["dim", "block", "chunk"]
    own = spread.select("dim", dealt("blocks").alias("block"), every("chunks").alias("chunk"), "id", "vector")
    # named anew, as both sides of the cogroup come from one table
    asking = spread.where("asks").select(*[F.col(c).alias(c) for c in spread.columns])
    asking = asking.select("dim", every("blocks").alias("block"), dealt("chunks").alias("chunk"), "id", "vector")
    probed = own.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInArrow(_probe(k), "query_id long, vec_id long, score double")
    found = materialise(probed)
    discard(base)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 100 == 0)
