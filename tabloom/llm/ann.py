"""Approximate nearest neighbours by inner product with a hash-prefix forest.

Each vector is hashed once per tree to a long string of bits, the signs of random projections; a
tree is the sorted array of these strings. A query descends in every tree to its longest matching
prefix, then all trees ascend together, a bit at a time; what the ranges of equal prefixes hold is
scored exactly, in double precision. For inner products of vectors of unequal length, vectors are
lifted by one coordinate so that the angle orders them.

The data say when a query stops. A vector at angle a shares a prefix of d bits with the query in one
tree with probability (1 - a / pi)^d, so it is in none of the trees' ranges with probability
(1 - (1 - a / pi)^d)^trees. The ascent ends at the first depth where this is at most MISS for a vector
as near as the k-th best found so far: nearer ones are missed more rarely still. Where vectors have
near neighbours a query ends deep in the trees with few candidates; where they have none (directions
drawn at random) it has to look at a large part of its block. There is no cap on candidates: a range
of equal prefixes is always taken whole.

Spark's part: equal vectors form a class and are searched once. Classes are dealt into blocks of
about BLOCK by hash, each block is a forest of its own, and the query classes visit all blocks. A task
sorts a block's points before the queries, builds the forest once and lets the queries stream
through it; only where there are more than QUERIES of them, or fewer blocks than cores, are they dealt
into groups that have a copy of the block each. The blocks' results meet by a grouped top-k, which
Spark limits before it shuffles.

Defined results: vectors that are null, zero, of another dimension than the query's, or hold null
or non-finite components take no part; rows without id neither; rows equal in id and vector count
once; equal scores are ordered by id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ._common import arrow_schema, batch_of, staged

TREES, BITS, SEED = 160, 31, 5
BLOCK, QUERIES = 1 << 15, 1 << 16
#: How probable it may be that a vector as near as the k-th best is in no range.
MISS = 0.05
#: Queries of a task that ascend at the same time.
TOGETHER = 256


def usable(vector: Column) -> Column:
    """True for vectors that take part."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


class Forest:
    """Sorted hash strings of the rows of x (lifted to unit length by `longest`) in each tree; `ties` orders rows of equal score."""

    def __init__(self, x: np.ndarray, ties: np.ndarray, longest: float, trees: int = TREES, bits: int = BITS, seed: int = SEED):
        self.x, self.ties, self.longest, self.bits, self.scored = x, ties, longest, bits, 0
        self.planes = np.random.default_rng(seed).standard_normal((trees, x.shape[1] + 1, bits)).astype(np.float32)
        unit = x / longest
        codes = self.strings(np.hstack([unit, np.sqrt(np.clip(1 - (unit * unit).sum(axis=1, keepdims=True), 0, None))]))
        self.order = np.argsort(codes, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(codes, self.order, axis=1)

    def strings(self, lifted: np.ndarray) -> np.ndarray:
        """[trees, rows]: the hash string of each row, as a number whose first bit is the highest."""
        lifted, worth = lifted.astype(np.float32), 2.0 ** np.arange(self.bits - 1, -1, -1)
        return np.stack([(lifted @ p > 0).astype(np.float64) @ worth for p in self.planes]).astype(np.int32)

    def ranges(self, codes: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[trees, queries] begin and end of the range that shares each query's first `depth` bits."""
        rest = ((1 << (self.bits - depth)) - 1).astype(np.int32)
        low, high = np.empty(codes.shape, np.int64), np.empty(codes.shape, np.int64)
        for t, tree in enumerate(self.sorted):
            low[t] = np.searchsorted(tree, codes[t] & ~rest)
            high[t] = np.searchsorted(tree, codes[t] | rest, "right")
        return low, high

    def enough(self, cosine: np.ndarray) -> np.ndarray:
        """The greatest depth at which a vector of this cosine is missed with probability MISS at most."""
        p = np.clip(1 - np.arccos(np.clip(cosine, -1, 1)) / np.pi, 1e-12, 1 - 1e-12)
        return np.floor(np.log(1 - MISS ** (1 / len(self.sorted))) / np.log(p))

    def nearest(self, q: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Rows and scores of the k best found of each query, nearest first."""
        length = np.sqrt((q * q).sum(axis=1))
        codes = self.strings(np.hstack([q / length[:, None], np.zeros((len(q), 1))]))
        depth = np.zeros(len(q), np.int64)
        for step in (16, 8, 4, 2, 1):  # the longest prefixes that k slots share
            deeper = np.minimum(depth + step, self.bits)
            low, high = self.ranges(codes, deeper)
            depth = np.where((high - low).sum(axis=0) >= k, deeper, depth)
        best = [(np.zeros(0, np.int64), np.zeros(0))] * len(q)
        seen = np.zeros((len(q), len(self.x)), bool)
        climbing = np.arange(len(q))
        while len(climbing):
            low, high = self.ranges(codes[:, climbing], depth[climbing])
            fresh = np.zeros((len(climbing), len(self.x)), bool)
            for t, order in enumerate(self.order):
                size = high[t] - low[t]
                row = np.repeat(np.arange(len(climbing)), size)
                at = np.arange(len(row)) + np.repeat(low[t] - (np.cumsum(size) - size), size)
                fresh[row, order[at]] = True
            fresh &= ~seen[climbing]
            seen[climbing] |= fresh
            worst = np.full(len(climbing), -np.inf)
            for j, i in enumerate(climbing):
                new = np.flatnonzero(fresh[j])
                self.scored += len(new)
                rows, scores = np.concatenate([best[i][0], new]), np.concatenate([best[i][1], (self.x[new] * q[i]).sum(axis=1)])
                first = np.lexsort((self.ties[rows], -scores))[:k]
                best[i] = rows[first], scores[first]
                if len(first) == k:
                    worst[j] = scores[first[-1]]
            done = (depth[climbing] == 0) | (depth[climbing] <= self.enough(worst / (length[climbing] * self.longest)))
            climbing = climbing[~done]
            depth[climbing] -= 1
        return best


FOUND = "query_class bigint, class_id bigint, low bigint, score double"


def visits(k: int, longest: dict[int, float]):
    """Searches of the queries of each (width, cell), whose rows come sorted, points before queries."""
    schema = arrow_schema(FOUND)

    def vectors_of(part: pa.RecordBatch) -> np.ndarray:
        return part["vector"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, points, forest, ids = None, [], None, None
        for batch in batches:
            key = np.stack([batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("width", "cell", "asks")])
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b == a:
                    continue
                part = batch.slice(a, b - a)
                if cell != tuple(key[:2, a]):
                    cell, points, forest = tuple(key[:2, a]), [], None
                if not key[2, a]:
                    points.append((vectors_of(part), part["class_id"].to_numpy(), part["low"].to_numpy()))
                    continue
                if not points and forest is None:
                    continue
                if forest is None:
                    x, ids, low = (np.concatenate(c) for c in zip(*points, strict=True))
                    forest, points = Forest(x, low, longest[x.shape[1]]), []
                q, asking = vectors_of(part), part["class_id"].to_numpy()
                for i in range(0, len(q), TOGETHER):
                    near = forest.nearest(q[i : i + TOGETHER], k)
                    rows, scores = (np.concatenate(c) for c in zip(*near, strict=True))
                    yield batch_of(schema, np.repeat(asking[i : i + TOGETHER], [len(r) for r, _ in near]), ids[rows], forest.ties[rows], scores)

    return run


def nearest_inner(vectors: DataFrame, is_query: Column, k=20, id_col="vec_id", vector_col="embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k nearest found of each query row, itself left out."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(usable(F.col("vector")) & F.col("vec_id").isNotNull()).withColumn("class_id", F.xxhash64("vector"))
    rows = staged(rows, "ann-rows")
    classes = staged(rows.groupBy("class_id").agg(F.first("vector").alias("vector"), F.min("vec_id").alias("low"), F.max("asks").alias("asks")).withColumn("width", F.size("vector")), "ann-classes")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    sizes = {r["width"]: r for r in classes.groupBy("width").agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("q"), F.max(norm).alias("longest")).collect()}
    if not sizes:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    blocks = -(-max(r["n"] for r in sizes.values()) // BLOCK)
    groups = max(1, -(-max(r["q"] for r in sizes.values()) // QUERIES), -(-cores // blocks))
    dealt = lambda seed, n: F.pmod(F.xxhash64("class_id", F.lit(seed)), F.lit(n))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    points = classes.select("class_id", "low", "vector", "width", F.lit(False).alias("asks"), dealt(1, blocks).alias("block"), upto(groups).alias("part"))
    asking = classes.where("asks").select("class_id", "low", "vector", "width", "asks", upto(blocks).alias("block"), dealt(2, groups).alias("part"))
    visiting = points.unionByName(asking).withColumn("cell", F.col("block") * groups + F.col("part")).drop("block", "part")
    visiting = visiting.repartitionById(blocks * groups, F.col("cell").cast("int")).sortWithinPartitions("width", "cell", "asks")
    found = visiting.mapInArrow(visits(k + 1, {w: max(r["longest"], 1e-300) for w, r in sizes.items()}), FOUND)
    best = F.row_number().over(Window.partitionBy("query_class").orderBy(F.desc("score"), "low"))
    found = found.withColumn("place", best).where(F.col("place") <= k + 1)
    each = rows.select("class_id", "vec_id").distinct()
    first = F.row_number().over(Window.partitionBy("class_id").orderBy("vec_id"))
    members = each.withColumn("place", first).where(F.col("place") <= k + 1).groupBy("class_id").agg(F.collect_list("vec_id").alias("ids"))
    listed = found.join(members, "class_id").select("query_class", "score", F.explode("ids").alias("vec_id"))
    listed = listed.withColumn("place", F.row_number().over(Window.partitionBy("query_class").orderBy(F.desc("score"), "vec_id"))).where(F.col("place") <= k + 1)
    lists = listed.groupBy("query_class").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("near"))
    queries = rows.where("asks").select(F.col("vec_id").alias("query_id"), F.col("class_id").alias("query_class")).distinct()
    answers = queries.join(lists, "query_class").select("query_id", F.posexplode(F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)).alias("at", "hit"))
    return answers.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
