"""Short codes of vectors: eight small integer codebooks, one for each eighth of a vector, by filtering Lloyd.

Vectors become integers, floor(4096 * x), and are cut into PARTS equal consecutive parts. A task puts its
rows into blocks of up to BLOCK and builds a kd-tree over each part position of a block, once: nodes are
split at the median of their widest dimension and keep their bounding box, count and sum. In a round the
codebooks, a few kilobytes, go to all tasks. A tree is descended level by level with the entries that may
still be nearest to some point of a node's box: the entry nearest to the middle of the box rules out each
other entry that is farther off even at the corner which suits that one best. A node left with one entry
goes to it whole, by its cached sum and count; only in leaves with several entries points are compared one
by one. All of this is integer arithmetic, so the result is that of plain Lloyd rounds with ties to the
lower index. Tasks send one sum and count for each entry; the driver sees nothing that grows with the rows.

Defined results: rows whose vector is null or holds null or non-finite components are left out, and so are
those with a component of 4096 or more in absolute value, whose squares would not fit 64 bits. Shorter
vectors are filled up with zeros to the longest one's width, and that to a multiple of eight. Where several
rows have the same id, or none, the first entries are those of the smallest vectors, null ids last; with
fewer than ENTRIES rows there are fewer entries. Repeated rows count each. An empty table gives an empty
result. Other columns do not matter.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ._common import discard, staged

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Rows of a block, and points of a leaf at most.
BLOCK, LEAF = 4096, 8
LARGEST = 4096.0
#: Up to so many labels their sums are broadcast; beyond, they are joined by a shuffle dealt over SALT tasks for each label.
LABELS, SALT = 100_000, 32
_BLOCK = "orders binary, points binary, low binary, high binary, sums binary"


def kept(vector: Column) -> Column:
    """True for vectors that take part."""
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < LARGEST), F.lit(False))), F.lit(False))


@functools.lru_cache(maxsize=64)
def shape(n: int) -> tuple[np.ndarray, np.ndarray]:
    """[nodes, 2] the range of each node of a tree over n points, and [nodes] its first child (0 for a leaf), level by level."""
    spans, child, at = [(0, n)], [], 0
    while at < len(spans):
        a, b = spans[at]
        child.append(len(spans) if b - a > LEAF else 0)
        if b - a > LEAF:
            spans += [(a, (a + b) // 2), ((a + b) // 2, b)]
        at += 1
    return np.array(spans), np.array(child)


class Tree:
    """A kd-tree over integer points: their order, and box and sum of each node."""

    def __init__(self, order: np.ndarray, points: np.ndarray, low: np.ndarray, high: np.ndarray, sums: np.ndarray):
        self.order, self.points, self.low, self.high, self.sums = order, points, low, high, sums
        self.spans, self.child = shape(len(order))

    @classmethod
    def over(cls, x: np.ndarray) -> Tree:
        spans, child = shape(len(x))
        order = np.arange(len(x))
        low, high, sums = (np.zeros((len(spans), x.shape[1]), np.int64) for _ in range(3))
        for i, (a, b) in enumerate(spans):
            own = x[order[a:b]]
            low[i], high[i], sums[i] = own.min(axis=0), own.max(axis=0), own.sum(axis=0)
            if child[i]:
                order[a:b] = order[a:b][np.argpartition(own[:, np.argmax(high[i] - low[i])], (a + b) // 2 - a)]
        return cls(order, x[order], low, high, sums)

    def owners(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest entry of each point, in the tree's order, and the count and sum of each entry's points."""
        k = len(entries)
        owner = np.zeros(len(self.order), np.int64)
        counts, sums = np.zeros(k, np.int64), np.zeros(entries.shape, np.int64)
        norm = (entries * entries).sum(axis=1)
        nodes, able = np.zeros(1, np.int64), np.ones((1, k), bool)
        while len(nodes):
            low, high = self.low[nodes], self.high[nodes]
            middle = 4 * norm - 4 * (low + high) @ entries.T  # four times the squared distance, but for a constant
            best = np.argmin(np.where(able, middle, np.iinfo(np.int64).max), axis=1)
            away = entries[None] - entries[best][:, None]
            corner = np.where(away > 0, high[:, None], low[:, None])
            gain = norm - norm[best][:, None] - 2 * (corner * away).sum(axis=2)
            able &= (gain < 0) | ((gain == 0) & (np.arange(k) <= best[:, None]))
            one, leaf = able.sum(axis=1) == 1, self.child[nodes] == 0
            whole = nodes[one]
            for (a, b), e in zip(self.spans[whole], best[one], strict=True):
                owner[a:b] = e
            np.add.at(counts, best[one], np.diff(self.spans[whole], axis=1)[:, 0])
            np.add.at(sums, best[one], self.sums[whole])
            if (leaf & ~one).any():
                spans, may = self.spans[nodes[leaf & ~one]], able[leaf & ~one]
                size = spans[:, 1] - spans[:, 0]
                at = np.arange(size.sum()) + np.repeat(spans[:, 0] - (np.cumsum(size) - size), size)
                x = self.points[at]
                near = np.argmin(np.where(np.repeat(may, size, axis=0), norm - 2 * x @ entries.T, np.iinfo(np.int64).max), axis=1)
                owner[at] = near
                np.add.at(counts, near, 1)
                np.add.at(sums, near, x)
            inner = ~leaf & ~one
            first = self.child[nodes[inner]]
            nodes, able = np.concatenate([first, first + 1]), np.concatenate([able[inner], able[inner]])
        return owner, counts, sums


def integers(vectors: pa.Array, width: int) -> np.ndarray:
    """[rows, PARTS, width / PARTS] integer components of list vectors, filled up with zeros."""
    size = np.diff(vectors.offsets.to_numpy())
    flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE).astype(np.int64)
    out = np.zeros((len(vectors), width), np.int64)
    out[np.arange(width) < size[:, None]] = flat
    return out.reshape(len(vectors), PARTS, -1)


def lists_of(values: pa.Array) -> pa.Array:
    """One list that holds all values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def built(width: int):
    """Blocks of kd-trees from batches of vec_id, label and vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                trees = [Tree.over(x) for x in np.ascontiguousarray(integers(part["vector"], width).transpose(1, 0, 2))]
                blobs = (np.concatenate([getattr(t, name) for t in trees]).astype(kind).tobytes() for name, kind in (("order", np.int32), ("points", np.int32), ("low", np.int32), ("high", np.int32), ("sums", np.int64)))
                yield pa.RecordBatch.from_arrays([lists_of(part["vec_id"]), lists_of(part["label"]), *(pa.array([x], pa.binary()) for x in blobs)], ["ids", "labels", *(c.split()[0] for c in _BLOCK.split(", "))])

    return run


def trees_of(batch: pa.RecordBatch, i: int, width: int) -> list[Tree]:
    """The trees of the i-th block of a batch, one for each part position."""
    read = lambda name, kind: np.frombuffer(batch[name][i].as_buffer(), kind).astype(np.int64)
    order = read("orders", np.int32).reshape(PARTS, -1)
    wide = [read(name, kind).reshape(PARTS, -1, width // PARTS) for name, kind in (("points", np.int32), ("low", np.int32), ("high", np.int32), ("sums", np.int64))]
    return [Tree(order[p], *(x[p] for x in wide)) for p in range(PARTS)]


def codebooks(blocks: DataFrame, first: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """[PARTS, entries, width / PARTS] the entries after so many rounds."""
    books, width = first, first.shape[0] * first.shape[2]
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], books=books) -> Iterator[pa.RecordBatch]:
            counts, sums = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
            for batch in batches:
                for i in range(batch.num_rows):
                    for p, tree in enumerate(trees_of(batch, i, width)):
                        _, n, s = tree.owners(books[p])
                        counts[p] += n
                        sums[p] += s
            part, entry = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

        sent = blocks.mapInArrow(run, "part int, entry int, n bigint, sums array<bigint>")
        total = sent.select("part", "entry", "n", F.posexplode("sums").alias("at", "s")).groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        books = books.copy()
        for r in total.collect():
            books[r["part"], r["entry"], r["at"]] = r["s"] // r["n"]
    return books


def coded(books: np.ndarray):
    """vec_id, label, code and error of the rows of blocks."""
    width = books.shape[0] * books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                trees = trees_of(batch, i, width)
                codes = np.zeros((len(trees[0].order), PARTS), np.uint8)
                error = np.zeros(len(codes), np.int64)
                for p, tree in enumerate(trees):
                    owner, _, _ = tree.owners(books[p])
                    codes[tree.order, p] = owner
                    error[tree.order] += ((tree.points - books[p][owner]) ** 2).sum(axis=1)
                ids, labels = (batch[c].slice(i, 1).flatten() for c in ("ids", "labels"))
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return run


def fingerprint(books: np.ndarray) -> str:
    """The hash of all components, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, id_col="vec_id", vector_col="embedding", label_col="label") -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code and error of every row that takes part, staged, and the codebooks."""
    spark = vectors.sparkSession
    label = vectors.select(label_col).schema[0].dataType.simpleString()
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector")).where(kept(F.col("vector")))
    widest = rows.agg(F.max(F.size("vector"))).first()[0]
    if widest is None:
        return spark.createDataFrame([], f"vec_id long, label {label}, code string, error long"), np.zeros((PARTS, 0, 1), np.int64)
    width = PARTS * max(1, -(-widest // PARTS))
    first = rows.select("vec_id", F.col("vector").cast("array<double>").alias("vector")).orderBy(F.asc_nulls_last("vec_id"), "vector").limit(ENTRIES).collect()
    books = np.ascontiguousarray(integers(pa.array([r["vector"] for r in first], pa.list_(pa.float64())), width).transpose(1, 0, 2))
    blocks = staged(rows.mapInArrow(built(width), f"ids array<bigint>, labels array<{label}>, {_BLOCK}"), "codes-blocks")
    books = codebooks(blocks, books)
    out = staged(blocks.mapInArrow(coded(books), f"vec_id bigint, label {label}, code string, error bigint"), "codes")
    discard(blocks)
    return out, books


def with_label_error(rows: DataFrame) -> DataFrame:
    """rows plus label_error: the error summed over the rows of equal label, nulls together."""
    sums = rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    if rows.select("label").distinct().limit(LABELS + 1).count() <= LABELS:
        return rows.join(F.broadcast(sums), rows["label"].eqNullSafe(sums["of"])).drop("of")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALT)))
    sums = sums.withColumn("salt_", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    return salted.join(sums, salted["label"].eqNullSafe(sums["of"]) & (salted["salt"] == sums["salt_"])).drop("of", "salt", "salt_")
