"""Near-duplicate vectors of equal label by an inverted multi-index.

Vectors are scaled to unit length and cut in two; each half has a codebook of its own, fitted on a bounded
sample, and the two codes of a vector name its cell in a product grid. Two unit vectors of cosine t are
sqrt(2 - 2t) apart, and the squares of their halves' distances add up to that square. How far a half of a
vector must at least be from any vector with code j is known from the codebook: half of the way over to the
plane between j's entry and the nearest one. With both halves' bounds in ascending order, the cells whose sum
of squares stays within 2 - 2t are a staircase from the nearest cell on; traversing cells in that order, a
multi-sequence traversal, ends where the recall is 1: no cell beyond holds a partner. So no link is lost, and
pairs that meet in a cell are verified by their cosine in double precision.

Spark's part: rows equal in label and vector are one class. The grid of a label is cut, cell after cell, into
units of about STRIP classes (a small label is one unit), and a unit with a crowded cell is dealt by hash over
several strips, so that no group of copies meets in one task. A class is at home in one strip and visits those
units after its own that its traversal reaches, so each pair meets once. Inside a strip, homes lie sorted by cell
and visitors stream through them. What leaves a task are counts of links and links that connect what its links
connect (a spanning forest), never all pairs. Components come from these by large-star and small-star. The cut
is known to all tasks; units grow with the table, so that there are never more than about UNITS of them.
A group of n near but unequal vectors still takes about n * n / 2 cosines and n / STRIP / 2 copies of its rows.

Defined results: vectors that are null, zero or hold null or non-finite components, and rows without label,
link with nothing and stay; vectors of other widths do not link. A null id is never the smallest; it is kept
with a null component where it is alone. Repeated rows (equal ids too) link with one another. Empty tables give
an empty result. Other columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ._common import arrow_schema, batch_of, discard, staged
from .ann import usable
from .neardup import components

#: Vectors and bytes of the sample that fits the codebooks.
SAMPLE, SAMPLE_BYTES = 16_384, 16 << 20
#: Classes for each cell that the size of the codebooks aims at, and the largest codebook.
FILL, LARGEST = 64, 1024
STRIP, TOGETHER = 8192, 1024
#: Units that a table is cut into, at most about twice as many.
UNITS = 100_000
#: What rounding may add to a squared distance, and how near to the threshold a cosine is computed again term by term.
ROUNDING = 1e-9


def unit_halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and second half of each vector, scaled to unit length."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x[:, : x.shape[1] // 2], x[:, x.shape[1] // 2 :]


def fitted(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """k entries for the rows of x by Lloyd rounds from evenly spaced rows."""
    book = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)]
    for _ in range(rounds):
        near = np.argmin((book * book).sum(axis=1) - 2 * x @ book.T, axis=1)
        n = np.bincount(near, minlength=len(book))
        order = np.argsort(near, kind="stable")
        some = np.flatnonzero(n)
        book = book.copy()
        book[some] = np.add.reduceat(x[order], np.concatenate([[0], np.cumsum(n[some])[:-1]]), axis=0) / n[some][:, None]
    return book


def bounds(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code of each row, and [rows, entries] the square of the least distance to a vector with that code."""
    if not x.shape[1]:
        return np.zeros(len(x), np.int64), np.zeros((len(x), len(book)))
    square = np.maximum((x * x).sum(axis=1, keepdims=True) + (book * book).sum(axis=1) - 2 * x @ book.T, 0)
    code = np.argmin(square, axis=1)
    apart = np.sqrt(np.maximum((book * book).sum(axis=1)[:, None] + (book * book).sum(axis=1) - 2 * book @ book.T, 0))[code]
    over = square - square[np.arange(len(x)), code][:, None]
    to_plane = np.divide(over, 2 * apart, out=np.zeros_like(over), where=apart > 1e-6)
    return code, np.maximum(to_plane, 0) ** 2


def vectors_of(part) -> np.ndarray:
    return part.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(part), -1)


Books = dict[int, tuple[np.ndarray, np.ndarray]]


def codes_of(books: Books, vectors: pa.Array, width: np.ndarray):
    """For each width of a batch: its rows, their cells, and the bounds of both halves (None without a codebook)."""
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        if int(w) not in books:
            yield at, np.zeros(len(at), np.int64), None
            continue
        halves = unit_halves(vectors_of(vectors.take(pa.array(at))))
        (first, b1), (second, b2) = (bounds(h, book) for h, book in zip(halves, books[int(w)], strict=True))
        yield at, first * b2.shape[1] + second, (b1, b2)


def placed(books: Books):
    """class_id, label, width, times and vector plus the cell of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.zeros(batch.num_rows, np.int64)
            for at, own, _ in codes_of(books, batch["vector"], batch["width"].to_numpy()):
                cell[at] = own
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

    return run


class Cut:
    """Where the units of the large grids begin, and over how many strips each is dealt."""

    def __init__(self, rows: list):
        rows = sorted((r["grid"], r["start"], r["strips"]) for r in rows)
        self.grids, self.first = np.unique(np.array([g for g, _, _ in rows], np.int64), return_index=True)
        self.first = np.append(self.first, len(rows))
        self.starts, self.strips = np.array([x for _, x, _ in rows], np.int64), np.array([x for _, _, x in rows], np.int64)

    def of(self, grid: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and strips of the units of a grid."""
        i = int(np.searchsorted(self.grids, grid))
        if i == len(self.grids) or self.grids[i] != grid:
            return np.zeros(1, np.int64), np.ones(1, np.int64)
        s = slice(self.first[i], self.first[i + 1])
        return self.starts[s], self.strips[s]


def cut_grids(home: DataFrame, strip: int) -> Cut:
    """The cut of all grids of more than `strip` classes, cell after cell."""
    cells = home.groupBy("grid", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("grid").orderBy("cell")) - F.col("n")
    cells = cells.select("grid", "cell", "n", before.alias("before"), F.sum("n").over(Window.partitionBy("grid")).alias("total")).where(F.col("total") > strip)
    units = cells.groupBy("grid", F.floor(F.col("before") / strip)).agg(F.min("cell").alias("start"), F.ceil(F.sum("n") / (2 * strip)).cast("int").alias("strips"))
    return Cut(units.select("grid", "start", "strips").collect())


def visiting(books: Books, cut, reach: float):
    """The rows plus `to`: the strips (unit, strip) where a class is at home (asks is false) or asks for partners."""
    kind = pa.list_(pa.struct([("unit", pa.int32()), ("strip", pa.int32()), ("asks", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grid, cell, ids = (batch[c].to_numpy() for c in ("grid", "cell", "class_id"))
            width = batch["width"].to_numpy()
            to: list = [None] * batch.num_rows
            for at, _, bound in codes_of(books, batch["vector"], width):
                for g in np.unique(grid[at]):
                    own = np.flatnonzero(grid[at] == g)
                    starts, strips = cut.value.of(int(g))
                    unit = np.searchsorted(starts, cell[at[own]], "right") - 1
                    seen = np.zeros((len(own), len(starts)), bool)
                    if bound is not None and len(starts) > 1:
                        b1, b2 = bound[0][own], bound[1][own]
                        q, i = np.nonzero(b1 <= reach)
                        for s in range(0, len(q), 4096):  # the stairs, row by row
                            a, row = q[s : s + 4096], i[s : s + 4096]
                            pair, j = np.nonzero(b2[a] <= (reach - b1[a, row])[:, None])
                            seen[a[pair], np.searchsorted(starts, row[pair] * b2.shape[1] + j, "right") - 1] = True
                    for n, k in enumerate(own):
                        u = int(unit[n])
                        mine = int(ids[at[k]] % strips[u])
                        out = [{"unit": u, "strip": mine, "asks": False}]
                        out += [{"unit": u, "strip": s, "asks": True} for s in range(mine + 1, int(strips[u]))]
                        out += [{"unit": int(v), "strip": s, "asks": True} for v in np.flatnonzero(seen[n, u + 1 :]) + u + 1 for s in range(int(strips[v]))]
                        to[at[k]] = out
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(to, kind)], [*batch.schema.names, "to"])

    return run


class Strip:
    """Classes at home in one strip, sorted by cell, and what was found of them."""

    def __init__(self, ids: np.ndarray, times: np.ndarray, x: np.ndarray, cell: np.ndarray, books: tuple[np.ndarray, np.ndarray] | None, t: float):
        order = np.argsort(cell, kind="stable")
        self.ids, self.times, self.x, self.books, self.t = ids[order], times[order], x[order], books, t
        first, second = unit_halves(self.x)
        self.unit = np.hstack([first, second])
        self.root = np.arange(len(ids))
        self.links = np.zeros(len(ids), np.int64)
        self.cells, starts = np.unique(cell[order], return_index=True)
        self.ends = np.append(starts, len(ids))

    def same(self, cosine: np.ndarray, x: np.ndarray, begin: int) -> np.ndarray:
        """Which of x and the homes from begin on are linked; cosines at the threshold are computed again, with exact sums."""
        linked = cosine >= self.t
        for i, j in zip(*np.nonzero(np.abs(cosine - self.t) < ROUNDING), strict=True):
            u, v = x[i], self.x[begin + j]
            linked[i, j] = math.fsum(u * v) / (math.sqrt(math.fsum(u * u)) * math.sqrt(math.fsum(v * v))) >= self.t
        return linked

    def meet(self, ids: np.ndarray, times: np.ndarray, x: np.ndarray, own: np.ndarray | None = None) -> tuple[np.ndarray, list[int], list[int]]:
        """Links of each asking class with homes, and spanning links; `own` are the places of asking classes that are at
        home here, which meet only homes after them."""
        halves = unit_halves(x)
        unit, reach = np.hstack(halves), 2 - 2 * self.t + ROUNDING
        b1, b2 = (bounds(h, book)[1] for h, book in zip(halves, self.books, strict=True)) if self.books else [np.zeros((len(x), 1))] * 2
        found, a, b = np.zeros(len(x), np.int64), [], []
        for cell, begin, end in zip(self.cells, self.ends[:-1], self.ends[1:], strict=True):
            near = b1[:, cell // b2.shape[1]] + b2[:, cell % b2.shape[1]] <= reach
            asks = np.flatnonzero(near if own is None else near & (own < end - 1))
            if not len(asks):
                continue
            linked = self.same(unit[asks] @ self.unit[begin:end].T, x[asks], begin)
            if own is not None:
                linked &= np.arange(begin, end) > own[asks][:, None]
            some = np.flatnonzero(linked.any(axis=1))
            found[asks[some]] += linked[some] @ self.times[begin:end]
            self.links[begin:end] += times[asks[some]] @ linked[some]
            if own is not None:
                self.links[own[asks[some]]] += linked[some] @ self.times[begin:end]
            for i in some:
                partners = begin + np.flatnonzero(linked[i])
                roots, at = np.unique(self.root[partners], return_index=True)
                mine = self.root[own[asks[i]]] if own is not None else roots[0]
                for r, p in zip(roots, partners[at], strict=True):
                    if own is None or r != mine:
                        a.append(int(ids[asks[i]]))
                        b.append(int(self.ids[p]))
                if len(roots) > 1 or roots[0] != mine:
                    self.root[np.isin(self.root, roots)] = mine
        return found, a, b

    def among(self) -> tuple[list[int], list[int]]:
        """Spanning links among the homes."""
        a, b = [], []
        for i in range(0, len(self.ids), TOGETHER):
            own = np.arange(i, min(i + TOGETHER, len(self.ids)))
            _, u, v = self.meet(self.ids[own], self.times[own], self.x[own], own)
            a, b = a + u, b + v
        return a, b


FOUND = "a bigint, b bigint, links bigint"


def met(books: Books, t: float):
    """Rows (class, null, links with others) and (class, class, null) for a link; rows come sorted by strip, homes first."""
    schema = arrow_schema(FOUND)

    def counted(ids: np.ndarray, links: np.ndarray) -> pa.RecordBatch:
        some = links > 0
        return batch_of(schema, ids[some], pa.nulls(int(some.sum()), pa.int64()), links[some])

    def linked(a: list[int], b: list[int]) -> pa.RecordBatch:
        return batch_of(schema, a, b, pa.nulls(len(a), pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, homes, strip = None, [], None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            keys = [table[c] for c in ("strip_key", "asks")]
            marks = np.stack([keys[0].to_numpy(), keys[1].to_numpy().astype(np.int64)])
            cuts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1), batch.num_rows]
            for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
                if start == stop:
                    continue
                part = batch.slice(start, stop - start)
                if marks[0, start] != key:
                    yield from finished(strip, homes)
                    key, homes, strip = marks[0, start], [], None
                if not marks[1, start]:
                    homes.append(part)
                    continue
                if strip is None:
                    if not homes:
                        continue
                    strip, first = opened(homes)
                    homes = []
                    yield linked(*first)
                ids, times, x = part["class_id"].to_numpy(), part["times"].to_numpy(), vectors_of(part["vector"])
                for i in range(0, len(ids), TOGETHER):
                    s = slice(i, i + TOGETHER)
                    links, a, b = strip.meet(ids[s], times[s], x[s])
                    yield counted(ids[s], links)
                    yield linked(a, b)
        yield from finished(strip, homes)

    def opened(homes: list[pa.RecordBatch]) -> tuple[Strip, tuple]:
        width = homes[0]["width"][0].as_py()
        column = lambda c: np.concatenate([h[c].to_numpy() for h in homes])
        strip = Strip(column("class_id"), column("times"), np.concatenate([vectors_of(h["vector"]) for h in homes]), column("cell"), books.get(width), t)
        return strip, strip.among()

    def finished(strip: Strip | None, homes: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if strip is None and homes:
            strip, first = opened(homes)
            yield linked(*first)
        if strip is not None:
            yield counted(strip.ids, strip.links)

    return run


def classes_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows with class_id, and class_id, label, width, vector and times of each class. Ids are 64-bit hashes of label and
    vector; should two classes share one, all are drawn again with another seed."""
    seed = 0
    while True:
        named = staged(rows.withColumn("class_id", F.xxhash64(F.lit(seed), "label", "vector")), "multi-rows")
        groups = named.groupBy("class_id", "label", "vector").agg(F.count(F.lit(1)).alias("times"))
        classes = staged(groups.select("class_id", "label", F.size("vector").alias("width"), "vector", "times"), "multi-classes")
        if classes.select("class_id").distinct().count() == classes.count():
            return named, classes
        discard(named, classes)
        seed += 1


def fitted_books(classes: DataFrame, size: int) -> Books:
    """Codebooks of the halves for each width that a sample of at most SAMPLE classes and SAMPLE_BYTES has; the others have none."""
    widest = classes.agg(F.max("width")).first()[0]
    if widest is None:
        return {}
    n = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * widest)))
    sample = classes.select("class_id", F.col("vector").cast("array<double>").alias("vector")).orderBy("class_id").limit(n).collect()
    k = max(1, min(LARGEST, round(math.sqrt(size / FILL)), len(sample) // 4))
    by_width: dict[int, list] = {}
    for r in sample:
        by_width.setdefault(len(r["vector"]), []).append(r["vector"])
    return {w: tuple(fitted(h, k) for h in unit_halves(np.array(x, np.float64))) for w, x in by_width.items()}


def linked_classes(classes: DataFrame, t: float) -> DataFrame:
    """FOUND: counts of links with other classes, and links that connect what is linked; staged."""
    size = classes.count()
    books = fitted_books(classes, size)
    kinds = ", ".join(f"{c} {classes.schema[c].dataType.simpleString()}" for c in classes.columns)
    home = staged(classes.mapInArrow(placed(books), f"{kinds}, cell bigint").withColumn("grid", F.xxhash64("label", "width")), "multi-placed")
    cut = classes.sparkSession.sparkContext.broadcast(cut_grids(home, max(STRIP, size // UNITS)))
    sent = home.mapInArrow(visiting(books, cut, 2 - 2 * t + ROUNDING), f"{kinds}, cell bigint, grid bigint, to array<struct<unit:int,strip:int,asks:boolean>>")
    sent = sent.select("*", F.explode("to").alias("at")).select("class_id", "label", "width", "times", "vector", "cell", "at.unit", "at.strip", "at.asks")
    dealt = sent.repartition("label", "width", "unit", "strip").sortWithinPartitions("label", "width", "unit", "strip", "asks")
    numbered = dealt.withColumn("strip_key", F.xxhash64("label", "width", "unit", "strip")).select("class_id", "width", "times", "vector", "cell", "asks", "strip_key")
    out = staged(numbered.mapInArrow(met(books, t), FOUND), "multi-found")
    discard(home)
    return out


def near_vectors(vectors: DataFrame, similarity=0.98, id_col="vec_id", vector_col="embedding", label_col="label") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    able = usable(F.col("vector")) & F.col("label").isNotNull()
    alone = rows.where(~able).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    named, classes = classes_of(rows.where(able))
    found = linked_classes(classes, similarity)
    links = found.where("b IS NULL").groupBy(F.col("a").alias("class_id")).agg(F.sum("links").alias("links"))
    edges = found.where("b IS NOT NULL").select("a", "b")
    roots = components(edges, "multi-edges").select(F.col("node").alias("class_id"), "root") if not edges.isEmpty() else classes.select("class_id", F.col("class_id").alias("root")).limit(0)
    lows = named.groupBy("class_id").agg(F.min("vec_id").alias("low"))
    facts = classes.select("class_id", "times").join(links, "class_id", "left").join(roots, "class_id", "left").join(lows, "class_id")
    facts = staged(facts.select("class_id", (F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "class_id").alias("root"), "low"), "multi-facts")
    least = facts.groupBy("root").agg(F.min("low").alias("component_id"))
    facts = facts.join(least, "root").select("class_id", "n_links", "component_id")
    out = named.select("vec_id", "class_id").join(facts, "class_id")
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")).unionByName(alone)
