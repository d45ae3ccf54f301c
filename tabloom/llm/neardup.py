"""Near-duplicate groups from bottom-k sketches of one hash function.

Steps, each a distributed job:
1. A text becomes its set of distinct word shingles, hashed to 64 bits; equal sets form a class.
2. A class keeps the k smallest hashes. Two sets whose Jaccard similarity is at least t share at
   least `needed` of these: exactly so when both sets are within k, else but for odds of about
   1e-9 (six standard deviations of the count).
3. Inverted lists of retained values. Values that one class alone retains are left out, and so
   are classes that have fewer than `needed` others. Of the rest, in one order of all values from
   the least to the most frequent, sketches that share `needed` values share one of their first
   (number - needed + 1); only these go into lists, which thus hold few unrelated texts.
4. In each list every class is held against one (its hub: the one with most shared values). A pair goes on
   if the sizes of the sets and 128 one-bit minima allow t (again within six standard deviations),
   then if the estimate from the union's k smallest values does, and it is a link if the Jaccard
   similarity of the full sets reaches t. Connected components follow.
5. In lists that still hold several components, classes outside the list's largest component are
   held against all others of another component. Lists with one largest component are a group; its
   members meet in blocks of bounded size, which compare sizes and bits, then full sets, by matrix
   products, and report links that connect what the block connects. Every pair that shares a list
   has then been checked or is connected already; a group of n members, m of them outside its largest
   component, costs n * m / CELL rows.

Defined results: texts without words have an empty set and stay alone; rows with equal ids are
rows of their own; a group's id is its smallest non-null id (null when all are null); an empty
table gives an empty result. Columns other than the named ones do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ._common import arrow_schema, batch_of, discard, hash_words, mixed, pieces_of, staged, texts_of, words_of

SAFETY = 6.0
BITS = 1 << 25
LANES = 128
#: Members of a group that meet in one task, of either kind.
CELL = 512
SETS = "doc_id bigint, text_code bigint, n bigint, class_id bigint, bits bigint, more bigint, sketch array<bigint>"


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words is one shingle."""
    words, codes, offsets = words_of(texts)
    h = hash_words(words)[codes] if len(codes) else np.zeros(0, np.uint64)
    size = np.diff(offsets)
    rolled = np.full(max(len(h) - width + 1, 0), width, np.uint64)
    for i in range(width if len(rolled) else 0):
        rolled = mixed(rolled * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(rolled)])
    out = []
    for a, n in zip(offsets[:-1], size, strict=True):
        if n >= width:
            s = np.sort(rolled[a : a + n - width + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif n:
            one = np.full(1, n, np.uint64)
            for x in h[a : a + n]:
                one = mixed(one * np.uint64(0x9E3779B97F4A7C15) + x)
            out.append(one)
        else:
            out.append(h[:0])
    return out


def class_of(s: np.ndarray) -> int:
    """A 64-bit fingerprint of a set."""
    return int(mixed(mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(keepdims=True) + np.uint64(len(s)))[0].astype(np.int64))


def bits_of(s: np.ndarray) -> tuple[int, int]:
    """The parity of the smallest hash in each of LANES lanes of a set, in two numbers; an empty lane has 0.

    A lane differs in half of the cases in which the smallest hash of the union is not in both
    sets, and never otherwise, so at most a share of (1 - similarity) / 2 of all lanes is expected to.
    """
    lane = s >> np.uint64(57)
    first = np.flatnonzero(np.concatenate([[True], lane[1:] != lane[:-1]])) if len(s) else np.zeros(0, np.int64)
    odd = lane[first][(mixed(s[first]) & np.uint64(1)) == 1]
    half = [(np.uint64(1) << x).sum(dtype=np.uint64).astype(np.int64) for x in (odd[odd < 64], odd[odd >= 64] - np.uint64(64))]
    return int(half[0]), int(half[1])


def sketches(docs: DataFrame, width: int, k: int, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, text_code (a hash of the text), n (size of the set), class_id, bits and more (null for an empty set) and the sketch."""
    schema = arrow_schema(SETS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces_of(batch, "text"):
                sets = shingle_sets(texts, width)
                yield batch_of(schema, part.column(0), part.column(2), [len(s) for s in sets], [class_of(s) if len(s) else None for s in sets], *zip(*[bits_of(s) if len(s) else (None, None) for s in sets], strict=True), [s[:k].astype(np.int64) for s in sets])

    return texts_of(docs, F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_code")).mapInArrow(run, SETS)


def needed(n: int, k: int, t: float) -> int:
    """How many retained values a set of n shares with any set that is similar enough.

    Beyond k * t, the k smallest values of the union (of at most n / t) are a random sample of it
    without replacement, of which a share of t at least lies in both sets.
    """
    if n <= k * t:
        return max(1, int(np.ceil(t * n - 1e-9)))
    left = max(0.0, 1 - k * t / n)
    return max(1, int(np.floor(k * t - SAFETY * np.sqrt(k * t * (1 - t) * left) - 1)))


def inverted_lists(reps: DataFrame, k: int, t: float) -> DataFrame:
    """value, class_id, held: the values of each sketch by which it can be found, and how many of its values are shared.

    Only values that two classes retain can be shared. A class that has fewer of these than it
    must share with a partner has none, and is dropped where it lies, by a bitmap of those values.
    The others' shared values are ordered, the least frequent first, and those in front kept.
    """
    seen = staged(reps.select(F.explode("sketch").alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("sharers")).where("sharers > 1"), "near-values")
    shared = reps.sparkSession.sparkContext.broadcast(bitmap(seen, "value"))
    ddl = "value bigint, class_id bigint, least bigint"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, lists = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            own = np.repeat(np.arange(len(ids)), np.diff(ends))
            flat = flat[ends[0] : ends[-1]]
            hit = marked(shared.value, flat)
            least = np.array([needed(int(n), k, t) for n in sizes], np.int64)
            hit &= (np.bincount(own[hit], minlength=len(ids)) >= least)[own]
            yield batch_of(schema, flat[hit], ids[own[hit]], least[own[hit]])

    found = reps.select("class_id", "n", "sketch").mapInArrow(run, ddl).join(seen, "value")
    of_class = Window.partitionBy("class_id")
    place = F.row_number().over(of_class.orderBy("sharers", "value"))
    found = found.withColumn("held", F.count(F.lit(1)).over(of_class)).withColumn("place", place)
    return found.where(F.col("place") <= F.col("held") - F.col("least") + 1).select("value", "class_id", "held")


def bitmap(nodes: DataFrame, column: str = "class_id") -> np.ndarray:
    """A bitmap of fixed size (BITS) of the values of a column, built by Spark; it may seem to hold other values, never fewer."""
    cells = nodes.selectExpr(f"pmod({column}, {BITS}) AS at").selectExpr("CAST(at DIV 64 AS INT) AS cell", "shiftleft(1L, CAST(at % 64 AS INT)) AS bit").groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow().to_pandas()
    words = np.zeros(BITS // 64, np.int64)
    words[cells["cell"].to_numpy(np.int64)] = cells["bits"].to_numpy(np.int64)
    return words.view(np.uint64)


def marked(words: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = np.mod(ids, BITS)
    return (words[at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1) == 1


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("class_id"))


def estimated(pairs: DataFrame, reps: DataFrame, k: int, t: float) -> DataFrame:
    """The pairs (a, b) whose sketches allow a similarity of t."""
    shared = reps.sparkSession.sparkContext.broadcast(bitmap(ends_of(pairs)))

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(marked(shared.value, batch.column(0).to_numpy())))

    own = reps.select("class_id", "n", F.col("sketch").alias("s")).mapInArrow(wanted, "class_id bigint, n bigint, s array<bigint>")
    both = pairs.join(own.select(F.col("class_id").alias("a"), F.col("n").alias("n_a"), F.col("s").alias("s_a")), "a").join(own.select(F.col("class_id").alias("b"), F.col("n").alias("n_b"), F.col("s").alias("s_b")), "b").select("a", "b", "n_a", "n_b", "s_a", "s_b")
    ddl = "a bigint, b bigint"
    schema = arrow_schema(ddl)
    least = t - SAFETY * np.sqrt(t * (1 - t) / k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n_a, n_b = (batch.column(i).to_numpy() for i in range(4))
            (e_a, v_a), (e_b, v_b) = ((c.offsets.to_numpy(), c.values.to_numpy().astype(np.uint64)) for c in (batch.column(4), batch.column(5)))
            keep = np.zeros(len(a), bool)
            for i in range(len(a)):
                x = np.sort(np.concatenate([v_a[e_a[i] : e_a[i + 1]], v_b[e_b[i] : e_b[i + 1]]]))
                twice = x[1:] == x[:-1]
                union = x[np.concatenate([[True], ~twice])]
                if max(n_a[i], n_b[i]) <= k:
                    keep[i] = twice.sum() >= t * len(union) - 1e-9
                else:
                    top = union[min(k, len(union)) - 1]
                    keep[i] = (x[1:][twice] <= top).sum() >= least * min(k, len(union))
            yield batch_of(schema, a[keep], b[keep])

    return both.mapInArrow(run, ddl)


def full_sets(docs: DataFrame, nodes: DataFrame, width: int, text_col="text") -> DataFrame:
    """class_id and whole shingle set (packed) of the classes in nodes, and of a few more.

    The classes go to the tasks as a bitmap; texts that it rules out are not sent on.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(nodes))
    ddl = "class_id bigint, packed binary"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = set()
        for batch in batches:
            for _, texts in pieces_of(batch, "text"):
                sets = [s for s in shingle_sets(texts, width) if len(s)]
                ids = np.array([class_of(s) for s in sets], np.int64)
                hit = [i for i in np.flatnonzero(marked(shared.value, ids)) if ids[i] not in sent]
                sent.update(ids[hit])
                yield batch_of(schema, ids[hit], [sets[i].tobytes() for i in hit])

    return texts_of(docs, F.col(text_col).alias("text")).mapInArrow(run, ddl).groupBy("class_id").agg(F.first("packed").alias("packed"))


def confirmed(pairs: DataFrame, sets: DataFrame, t: float) -> DataFrame:
    """The pairs (a, b) whose full sets reach a Jaccard similarity of t."""
    both = pairs.join(sets.selectExpr("class_id AS b", "packed AS s_b"), "b").join(sets.selectExpr("class_id AS a", "packed AS s_a"), "a").select("a", "b", "s_a", "s_b")
    ddl = "a bigint, b bigint"
    schema = arrow_schema(ddl)
    percent = round(100 * t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            keep = np.zeros(len(a), bool)
            for i in range(len(a)):
                x, y = (np.frombuffer(batch.column(j)[i].as_buffer(), np.uint64) for j in (2, 3))
                z = np.sort(np.concatenate([x, y]))
                same = int((z[1:] == z[:-1]).sum())
                keep[i] = 100 * same >= percent * (len(z) - same)
            yield batch_of(schema, a[keep], b[keep])

    return both.mapInArrow(run, ddl)


def components(links: DataFrame, label="links") -> DataFrame:
    """node and root (smallest node of its component), by alternating large-star and small-star
    steps; each step is one grouping and one join, and the edges are staged after each round."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, before = staged(edges, label), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        edges = staged(small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct(), label)
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def most_apart(t: float) -> int:
    """In how many of LANES bits two sets that are similar enough may differ."""
    return int(np.ceil(LANES * (1 - t) / 2 + SAFETY * np.sqrt(LANES * (1 - t) / 2 * (1 + t) / 2)))


def near(x: str, y: str, t: float):
    """Sizes and bits (columns n, bits and more with these suffixes) allow t."""
    n, m = F.col(f"n{x}"), F.col(f"n{y}")
    apart = sum(F.bit_count(F.col(f"{c}{x}").bitwiseXOR(F.col(f"{c}{y}"))) for c in ("bits", "more"))
    return (n >= t * m - 1e-9) & (m >= t * n - 1e-9) & (apart <= most_apart(t))


def dealt(mixed: DataFrame) -> DataFrame:
    """The members of each group (main) in blocks of about CELL: all in i, and once more, as `odd`,
    those outside its largest component in j; each block meets each block of the other kind in one task."""
    sizes = mixed.groupBy("main").agg(F.count(F.lit(1)).alias("all_n"), F.count_if(F.col("root") != F.col("main")).alias("odd_n")).where("odd_n > 0")
    blocks = sizes.select("main", F.ceil(F.col("all_n") / CELL).alias("rows"), F.ceil(F.col("odd_n") / CELL).alias("columns"))
    held = mixed.join(blocks, "main")
    place = lambda n: F.pmod(F.xxhash64("class_id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    cols = mixed.columns
    all_rows = held.select(*cols, place("rows").alias("i"), every("columns").alias("j"), F.lit(False).alias("odd"))
    odd_rows = held.where("root <> main").select(*cols, every("rows").alias("i"), place("columns").alias("j"), F.lit(True).alias("odd"))
    return all_rows.unionByName(odd_rows).repartition("main", "i", "j").sortWithinPartitions("main", "i", "j")


def cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (main, i, j) from batches sorted by these."""
    held: list[pa.Table] = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        key = np.stack([table[c].to_numpy() for c in ("main", "i", "j")])
        cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1), table.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = table.slice(a, b - a)
            if held and [held[0][c][0] for c in ("main", "i", "j")] != [part[c][0] for c in ("main", "i", "j")]:
                yield pa.concat_tables(held)
                held = []
            held.append(part)
    if held:
        yield pa.concat_tables(held)


def near_pairs(cell: pa.Table, t: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a cell: the rows that are odd, those that are not, and which pairs of them sizes and bits allow."""
    odd = cell["odd"].to_numpy(zero_copy_only=False) if cell.num_rows else np.zeros(0, bool)
    x, y = np.flatnonzero(odd), np.flatnonzero(~odd)
    n, root, *bits = (cell[c].to_numpy() for c in ("n", "root", "bits", "more"))
    small, large = np.minimum(n[x][:, None], n[y]), np.maximum(n[x][:, None], n[y])
    apart = sum(np.bitwise_count((b[x][:, None] ^ b[y]).view(np.uint64)) for b in bits)
    return x, y, (root[x][:, None] != root[y]) & (small >= t * large - 1e-9) & (apart <= most_apart(t))


def shared_counts(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """[x, y] sizes of the intersections of sets, by products of 0/1 matrices over slices of their elements."""
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, code, times = np.unique(flat, return_inverse=True, return_counts=True)
    often = times[code] > 1
    code, owner = np.unique(code[often], return_inverse=True)[1], owner[often]
    out = np.zeros((len(x), len(y)), np.float32)
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    for low in range(0, int(code[-1]) + 1 if len(code) else 0, 4096):
        s = slice(*np.searchsorted(code, [low, low + 4096]))
        part = np.zeros((len(sets), 4096), np.float32)
        part[owner[s], code[s] - low] = 1
        out += part[x] @ part[y].T
    return out


def likely_members(mixed: DataFrame, t: float) -> DataFrame:
    """main, class_id: the members with at least one other of another component that sizes and bits allow."""
    ddl = "main bigint, class_id bigint"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mains, ids, size = [], [], 0
        for cell in cells_of(batches):
            x, y, can = near_pairs(cell, t)
            hit = np.concatenate([x[can.any(axis=1)], y[can.any(axis=0)]])
            own = cell["class_id"].to_numpy()[hit]
            mains.append(np.full(len(own), cell["main"][0].as_py()))
            ids.append(own)
            size += len(own)
            if size > 50_000:
                yield batch_of(schema, np.concatenate(mains), np.concatenate(ids))
                mains, ids, size = [], [], 0
        if size:
            yield batch_of(schema, np.concatenate(mains), np.concatenate(ids))

    return dealt(mixed).mapInArrow(run, ddl).distinct()


def spanning_links(mixed: DataFrame, t: float) -> DataFrame:
    """a, b: in each cell, links between components that connect all that its links connect."""
    ddl = "a bigint, b bigint"
    schema = arrow_schema(ddl)
    percent = round(100 * t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in cells_of(batches):
            x, y, can = near_pairs(cell, t)
            if not can.any():
                continue
            sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in cell["packed"]]
            n, ids, roots = (cell[c].to_numpy() for c in ("n", "class_id", "root"))
            if can.sum() <= len(x) + len(y):
                both = np.zeros(can.shape, np.float32)
                for i, j in zip(*np.nonzero(can), strict=True):
                    z = np.sort(np.concatenate([sets[x[i]], sets[y[j]]]))
                    both[i, j] = (z[1:] == z[:-1]).sum()
            else:
                both = shared_counts(sets, x, y)
            linked = can & (100 * both.astype(np.int64) >= percent * (n[x][:, None] + n[y] - both.astype(np.int64)))
            parent: dict[int, int] = {}

            def find(r: int, parent: dict[int, int] = parent) -> int:
                while parent.get(r, r) != r:
                    r = parent[r]
                return r

            a, b = [], []
            for i in np.flatnonzero(linked.any(axis=1)):
                partners = y[linked[i]]
                _, first = np.unique(roots[partners], return_index=True)
                for p in partners[first]:
                    u, v = find(int(roots[x[i]])), find(int(roots[p]))
                    if u != v:
                        parent[u] = v
                        a.append(ids[x[i]])
                        b.append(ids[p])
            if a:
                yield batch_of(schema, np.array(a), np.array(b))

    return dealt(mixed).mapInArrow(run, ddl)


def linked(docs: DataFrame, reps: DataFrame, width: int, k: int, t: float, text_col="text") -> DataFrame:
    """node (class) and root of every class that has a link."""
    lists = staged(inverted_lists(reps, k, t), "near-lists")
    heads = lists.groupBy("value").agg(F.max(F.struct("held", "class_id")).alias("top"), F.min("class_id").alias("low"), F.max("class_id").alias("high")).where("low <> high").select("value", F.col("top.class_id").alias("hub"))
    shared = staged(lists.join(heads, "value").select("value", "class_id", "hub"), "near-shared")
    discard(lists)
    facts = reps.select("class_id", "n", "bits", "more")
    side = lambda x, name: facts.selectExpr(f"class_id AS {name}", f"n AS n{x}", f"bits AS bits{x}", f"more AS more{x}")
    pairs = shared.where("class_id <> hub").select(F.col("hub").alias("a"), F.col("class_id").alias("b")).distinct().join(side("_a", "a"), "a").join(side("_b", "b"), "b").where(near("_a", "_b", t)).select("a", "b")
    pairs = staged(pairs, "near-pairs")
    likely = staged(estimated(pairs, reps, k, t), "near-likely")
    sets = staged(full_sets(docs, ends_of(likely), width, text_col), "near-sets")
    links = staged(confirmed(likely, sets, t), "near-links")
    discard(pairs, likely, sets)
    roots = components(links)
    members = shared.join(roots.withColumnRenamed("node", "class_id"), "class_id", "left").withColumn("root", F.coalesce("root", "class_id"))
    by_root = members.groupBy("value", "root").agg(F.count(F.lit(1)).alias("size"))
    main = by_root.groupBy("value").agg(F.max(F.struct("size", "root")).alias("main"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    mixed = staged(members.join(main.select("value", F.col("main.root").alias("main")), "value").select("main", "class_id", "root").distinct().join(facts, "class_id").select("main", "class_id", "root", "n", "bits", "more"), "near-mixed")
    wanted = staged(likely_members(mixed, t), "near-wanted")
    if wanted.isEmpty():
        return roots
    sets = staged(full_sets(docs, wanted, width, text_col), "near-sets")
    held = mixed.join(wanted, ["main", "class_id"], "left_semi").join(sets, "class_id").select("main", "class_id", "root", "n", "bits", "more", "packed")
    more = staged(spanning_links(held, t), "near-links")
    discard(shared, mixed, wanted, sets)
    return roots if more.isEmpty() else components(links.union(more))


def grouped_rows(docs: DataFrame, width: int, t: float, k: int, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, text_code, n, root (null for an empty set) and component_id of every row."""
    rows = staged(sketches(docs, width, k, id_col, text_col), "near-sketches")
    full = rows.where("n > 0")
    reps = staged(full.groupBy("class_id").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("more").alias("more"), F.min("doc_id").alias("low"), F.first("sketch").alias("sketch")), "near-classes")
    roots = linked(docs, reps, width, k, t, text_col)
    grouped = reps.select("class_id", "low").join(roots.withColumnRenamed("node", "class_id"), "class_id", "left").withColumn("root", F.coalesce("root", "class_id"))
    lows = grouped.groupBy("root").agg(F.min("low").alias("component_id"))
    out = rows.select("doc_id", "text_code", "n", "class_id").join(grouped.join(lows, "root").select("class_id", "root", "component_id"), "class_id", "left")
    return out.select("doc_id", "text_code", "n", "root", F.when(F.col("class_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, width=5, similarity=0.8, k=64, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id of the group) and kept of every row."""
    out = grouped_rows(docs, width, similarity, k, id_col, text_col)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, width=5, similarity=0.8, k=64) -> DataFrame:
    """docs with one row of each group, that of the smallest id; texts without words stay.

    Rows are told apart by id and text; rows equal in both are one.
    """
    found = staged(grouped_rows(docs, width, similarity, k).where("n > 0").groupBy("doc_id", "text_code", "root").agg(F.count(F.lit(1)).alias("times")), "near-found")
    best = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("blank"), "doc_id", "text_code")).alias("best"))
    marked_rows = staged(found.join(best, "root").select("doc_id", "text_code", "times", (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_code") == F.col("best.text_code"))).alias("stays")), "near-marked")
    same = lambda x: docs["doc_id"].cast("long").eqNullSafe(x["doc_id"]) & (F.xxhash64(docs["text"]) == x["text_code"])
    gone = marked_rows.where("not stays").select("doc_id", "text_code")
    stay = docs.join(gone, same(gone), "left_anti")
    twice = marked_rows.where("stays and times > 1").select("doc_id", "text_code")
    if twice.isEmpty():
        return stay
    return stay.join(twice, same(twice), "left_anti").unionByName(stay.join(twice, same(twice), "left_semi").dropDuplicates(["doc_id", "text"]))
