"""A Merkle manifest of a dataset: a tree for each group of rows, a tree over the groups, and a proof for each row.

A node is the SHA-256 (as hex text) of its up to ARITY children in a row. As the number of leaves of a group is
known from a count, so is the arity of every run of siblings, the last one's too: a run is complete as soon as
that many of it are there. A `Forest` holds nodes that have not found all their siblings, keyed by group, level
and index; merging two forests joins the keys and makes every node whose run is complete. That is associative
and commutative, with the empty forest as its unit.

Spark's part: leaves are hashed where the text is read, and only digests move from there on. They are sorted by
range into parts of about ROWS; a count by part and group, summed up over parts, gives every leaf its index.
Each part makes the nodes that it has all leaves of. What it can't resolve, at most ARITY - 1 nodes on either
edge and level of the two groups that reach over the part's ends, is its forest; forests of neighbouring parts
are merged step by step by reduceByKey and then treeReduce, and the driver gets the nodes that were made on the
way: at most one for each level and end of a part, and nothing that grows with a part's rows. Groups inside of
one part never leave it. The trees' tops are the leaves of the same function for the tree over the groups. For
the proofs, the parts are visited again, with the few nodes outside that its leaves have as siblings, joined by
key, and with its groups' proofs from the upper tree; paths are hashed there and never stored.

Defined results: null values are `-` in a leaf; a null group is a group of its own, before all others, and a null
id comes before all others and is never tampered with. Rows with equal ids are ordered by their leaves; equal
rows are leaves of their own, and which of them has which place doesn't matter to anyone. An empty table gives
an empty result, a single row is its own subroot and root. Columns other than the named ones take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ._common import discard, staged

ARITY = 8
#: Leaves of a part: about so many at most, and not fewer than FEW only to keep all tasks busy.
ROWS, FEW = 1 << 19, 1000
#: Neighbouring forests that are merged in one step.
TOGETHER = 32
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
Key = tuple[str, int, int]


def digest(children: str) -> str:
    return sha256(children.encode()).hexdigest()


def leaf_of(*values: Column) -> Column:
    """The digest of values: `-` for null, else the UTF-8 byte count, a colon and the value."""
    said = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*said).cast("binary"), 256)


def widths(n: int) -> list[int]:
    """How many nodes each level of a tree over n leaves has, from the leaves to the top."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // ARITY))
    return out


class Forest:
    """Nodes without all their siblings, the leaf counts of their groups, and the nodes made so far by merging."""

    def __init__(self, nodes: dict[Key, str] | None = None, totals: dict[str, int] | None = None):
        self.nodes, self.totals, self.made = nodes or {}, totals or {}, {}

    def __add__(self, other: Forest) -> Forest:
        """Both forests' nodes; complete runs become their parents, level by level."""
        out = Forest(self.nodes | other.nodes, self.totals | other.totals)
        out.made = self.made | other.made
        small = other if len(other.nodes) < len(self.nodes) else self
        due = {(g, level + 1, i // ARITY) for g, level, i in small.nodes}
        while due:
            parent = due.pop()
            group, level, index = parent
            counts = widths(out.totals[group])
            if level >= len(counts):
                continue
            run = [(group, level - 1, i) for i in range(index * ARITY, min((index + 1) * ARITY, counts[level - 1]))]
            if all(k in out.nodes for k in run):
                out.nodes[parent] = out.made[parent] = digest("".join(out.nodes.pop(k) for k in run))
                due.add((group, level + 1, index // ARITY))
        return out


class Patch:
    """All nodes that a run of leaves, first .. first + len(leaves) - 1 of a group of n, determines."""

    def __init__(self, leaves: list[str], first: int, n: int):
        self.counts = widths(n)
        self.levels = [(first, leaves)]
        for below in self.counts[:-1]:
            start, nodes = self.levels[-1]
            begin, end = -(-start // ARITY), (start + len(nodes)) // ARITY
            if nodes and start + len(nodes) == below:
                end = -(-below // ARITY)
            cut = lambda i: nodes[max(i * ARITY - start, 0) : (i + 1) * ARITY - start]  # noqa: B023, E731
            self.levels.append((begin, [digest("".join(cut(i))) for i in range(begin, end)]))

    def get(self, level: int, index: int) -> str | None:
        start, nodes = self.levels[level]
        return nodes[index - start] if start <= index < start + len(nodes) else None

    def open_nodes(self) -> Iterator[tuple[int, int, str]]:
        """level, index and digest of the nodes whose parent is not here; a tree's top has none."""
        for level, (start, nodes) in enumerate(self.levels):
            above = self.levels[level + 1] if level + 1 < len(self.levels) else (0, [])
            low, high = above[0] * ARITY, (above[0] + len(above[1])) * ARITY
            inside = range(max(low, start), min(high, start + len(nodes))) if above[1] else range(0)
            for i in [*range(start, min(inside.start, start + len(nodes))), *range(max(inside.stop, start), start + len(nodes))] if len(inside) else range(start, start + len(nodes)):
                yield level, i, nodes[i - start]

    def needs(self) -> Iterator[tuple[int, int]]:
        """level and index of the nodes outside that are siblings on the way up from these leaves."""
        first, last = self.levels[0][0], self.levels[0][0] + len(self.levels[0][1]) - 1
        for level, n in enumerate(self.counts[:-1]):
            low, high = first // ARITY * ARITY, min((last // ARITY + 1) * ARITY, n)
            start, nodes = self.levels[level]
            for i in [*range(low, min(start, high)), *range(max(start + len(nodes), low), high)] if nodes else range(low, high):
                yield level, i
            first, last = first // ARITY, last // ARITY


def ordered_leaves(leaves: DataFrame, parts: int, order: str, more: list[str]) -> DataFrame:
    """leaves plus part: the number of the range, by grp, order and leaf, that a row falls into. Equal rows are told apart
    by their place, so that any number of them can be dealt over several parts."""
    placed = leaves.withColumn("place", F.monotonically_increasing_id())
    ranged = placed.repartitionByRange(parts, F.asc_nulls_first("grp"), F.asc_nulls_first(order), "leaf", "place")
    return staged(ranged.select("grp", order, "leaf", "place", *more, F.spark_partition_id().alias("part")), "merkle-ordered")


def spans_of(ordered: DataFrame) -> DataFrame:
    """part, key, start (leaves of the group in earlier parts), n (in this part) and total of each group."""
    counts = ordered.groupBy("part", "grp").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("n").over(Window.partitionBy("grp"))
    key = F.coalesce(F.concat(F.lit("="), "grp"), F.lit("-"))
    return counts.select("part", key.alias("key"), F.coalesce(upto, F.lit(0)).alias("start"), "n", total.alias("total"))


def patches(rows: pa.Table, spans: pa.Table, order: str):
    """The part's rows in order, and for each of its groups: key, first row, Patch."""
    key = [("-" if g is None else f"={g}") for g in rows["grp"].to_pylist()]
    known = {r["key"]: r for r in spans.to_pylist()}
    ids, leaf, place = rows[order].to_pylist(), rows["leaf"].to_pylist(), rows["place"].to_pylist()
    rank = [(False, 0) if v is None else (True, v.encode() if isinstance(v, str) else v) for v in ids]
    at = sorted(range(len(key)), key=lambda i: (key[i] != "-", key[i].encode(), rank[i], leaf[i], place[i]))
    out, begin = [], 0
    while begin < len(at):
        span = known[key[at[begin]]]
        out.append((span, begin, Patch([leaf[i] for i in at[begin : begin + span["n"]]], span["start"], span["total"])))
        begin += span["n"]
    return at, out


def resolved(parts: DataFrame, spans: DataFrame, order: str) -> DataFrame:
    """part, key, total, level, index, node, kind: the open nodes of a part (kind 0), tops of groups inside of one part
    (kind 1), and keys of nodes elsewhere that the part's paths need (kind 2)."""
    schema = pa.schema([("part", pa.int32()), ("key", pa.string()), ("total", pa.int64()), ("level", pa.int32()), ("index", pa.int64()), ("node", pa.string()), ("kind", pa.int32())])

    def run(rows: pa.Table, own: pa.Table) -> pa.Table:
        out = []
        for span, _, patch in patches(rows, own, order)[1]:
            said = (own["part"][0].as_py(), span["key"], span["total"])
            whole = span["n"] == span["total"]
            out += [(*said, level, i, node, int(whole)) for level, i, node in patch.open_nodes()]
            out += [(*said, level, i, None, 2) for level, i in patch.needs()]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)] if out else [pa.array([], f.type) for f in schema], schema=schema)

    return parts.groupBy("part").cogroup(spans.groupBy("part")).applyInArrow(run, "part int, key string, total bigint, level int, index bigint, node string, kind int")


def merged(open_nodes: DataFrame, parts: int) -> Forest:
    """The sum of all parts' forests: neighbours first, so that what goes on stays as small as one part's."""
    forests = open_nodes.rdd.map(lambda r: (r["part"] // TOGETHER, Forest({(r["key"], r["level"], r["index"]): r["node"]}, {r["key"]: r["total"]})))
    width = -(-parts // TOGETHER)
    forests = forests.reduceByKey(lambda a, b: a + b)
    while width > TOGETHER:
        width = -(-width // TOGETHER)
        forests = forests.map(lambda x: (x[0] // TOGETHER, x[1])).reduceByKey(lambda a, b: a + b)
    return forests.values().treeReduce(lambda a, b: a + b)


class Tree:
    """Leaves in their parts, with what is needed to visit them again: `tops` (key, node) and `outside` (part, key, level, index, node)."""

    def __init__(self, leaves: DataFrame, order: str, more: list[str]):
        self.order, self.spark = order, leaves.sparkSession
        n = leaves.count()
        parts = max(1, -(-n // ROWS), min(-(-n // FEW), int(self.spark.conf.get("spark.sql.shuffle.partitions"))))
        self.ordered = ordered_leaves(leaves, parts, order, more)
        self.spans = staged(spans_of(self.ordered), "merkle-spans")
        found = staged(resolved(self.ordered, self.spans, order), "merkle-found")
        open_nodes = found.where("kind = 0")
        forest = Forest() if open_nodes.isEmpty() else merged(open_nodes, parts)
        made = [(*k, v) for k, v in forest.made.items()]
        whole = [(g, v) for (g, level, _), v in forest.nodes.items() if level == len(widths(forest.totals[g])) - 1]
        self.tops = found.where("kind = 1").select("key", "node").union(self.spark.createDataFrame(whole, "key string, node string"))
        nodes = open_nodes.select("key", "level", "index", "node").union(self.spark.createDataFrame(made, "key string, level int, index long, node string"))
        self.outside = found.where("kind = 2").select("part", "key", "level", "index").join(nodes, ["key", "level", "index"])
        self.staged = [self.ordered, self.spans, found]

    def visit(self, upper: DataFrame, make, schema: str) -> DataFrame:
        """make(rows, order of rows, groups with their paths) for each part; upper has key, and what `make` wants to know of it."""
        facts = self.spans.join(upper, "key", "left")
        none = lambda kind: F.lit(None).cast(kind)
        extra = [c for c in upper.columns if c != "key"]
        kinds = {c: upper.schema[c].dataType for c in extra}
        spans = facts.select("part", "key", "start", "n", "total", none("int").alias("level"), none("long").alias("index"), none("string").alias("node"), *extra)
        nodes = self.outside.select("part", "key", none("long").alias("start"), none("long").alias("n"), none("long").alias("total"), "level", "index", "node", *[none(kinds[c]).alias(c) for c in extra])
        order = self.order

        def run(rows: pa.Table, known: pa.Table) -> pa.Table:
            own = known.filter(pc.is_valid(known["n"]))
            more = known.filter(pc.is_null(known["n"]))
            elsewhere = {(k, level, i): v for k, level, i, v in zip(*(more[c].to_pylist() for c in ("key", "level", "index", "node")), strict=True)}
            at, groups = patches(rows, own, order)
            return make(rows, at, groups, elsewhere)

        return self.ordered.groupBy("part").cogroup(spans.union(nodes).groupBy("part")).applyInArrow(run, schema)


def sides(patch: Patch, key: str, elsewhere: dict[Key, str], place: int) -> Iterator[tuple[str, str]]:
    """The siblings before and after, level by level, on the way from a leaf to the top."""
    first = patch.levels[0][0]
    index = first + place
    for level, n in enumerate(patch.counts[:-1]):
        low = index // ARITY * ARITY
        run = [elsewhere[key, level, i] if (v := patch.get(level, i)) is None else v for i in range(low, min(low + ARITY, n)) if i != index]
        yield "".join(run[: index - low]), "".join(run[index - low :])
        index //= ARITY


PATH = "array<struct<before:string,after:string>>"


def group_paths(tops: DataFrame) -> tuple[DataFrame, str | None]:
    """key, subroot, path (siblings before and after, level by level) of each group in the tree over all of them, and the root."""
    leaves = staged(tops.select(F.lit("").alias("grp"), F.when(F.col("key") != "-", F.substring("key", 2, 2**31 - 1)).alias("name"), F.col("node").alias("leaf")), "merkle-groups")
    tree = Tree(leaves, "name", [])
    found = tree.tops.first()
    schema = pa.schema([("key", pa.string()), ("subroot", pa.string()), ("path", pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())])))])

    def make(rows: pa.Table, at: list[int], groups: list, elsewhere: dict[Key, str]) -> pa.Table:
        names, leaf = rows["name"].to_pylist(), rows["leaf"].to_pylist()
        out = [(names[i], leaf[i], [{"before": b, "after": a} for b, a in sides(patch, span["key"], elsewhere, j)]) for span, begin, patch in groups for j, i in enumerate(at[begin : begin + span["n"]])]
        return pa.Table.from_arrays([pa.array(["-" if n is None else f"={n}" for n, _, _ in out]), pa.array([x for _, x, _ in out]), pa.array([p for _, _, p in out], schema.field("path").type)], schema=schema)

    none = tree.spans.select("key").distinct()
    return staged(tree.visit(none, make, f"key string, subroot string, path {PATH}"), "merkle-paths"), found["node"] if found else None


def manifest(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), group="lang", id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row; rows whose crc32(id) is divisible by
    three are verified with A-Z of their text in lower case."""
    spark = docs.sparkSession
    value = lambda c: F.col(f"`{c}`")
    touched = F.coalesce(F.crc32(value(id_col).cast("string").cast("binary")) % 3 == 0, F.lit(False))
    altered = F.when(touched, leaf_of(*[F.translate(value(c), CAPITALS, CAPITALS.lower()) if c == text_col else value(c) for c in fields]))
    leaves = staged(docs.select(value(group).cast("string").alias("grp"), value(id_col).cast("long").alias("doc_id"), leaf_of(*map(value, fields)).alias("leaf"), altered.alias("altered")), "merkle-leaves")
    ddl = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if leaves.isEmpty():
        return spark.createDataFrame([], ddl)
    tree = Tree(leaves, "doc_id", ["altered"])
    upper, root = group_paths(tree.tops)
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]

    def make(rows: pa.Table, at: list[int], groups: list, elsewhere: dict[Key, str]) -> pa.Table:
        leaf, altered = rows["leaf"].to_pylist(), rows["altered"].to_pylist()
        subroots, proofs, folds = [], [], []
        for span, begin, patch in groups:
            above = [(p["before"], p["after"]) for p in span["path"]]
            for j, i in enumerate(at[begin : begin + span["n"]]):
                proof, node = sha256(), altered[i] or leaf[i]
                for before, after in [*sides(patch, span["key"], elsewhere, j), *above]:
                    proof.update(before.encode())
                    proof.update(after.encode())
                    node = digest(before + node + after)
                subroots.append(span["subroot"])
                proofs.append(proof.hexdigest())
                folds.append(node)
        ids = rows["doc_id"].take(pa.array(at, pa.int64()))
        columns = [ids, [leaf[i] for i in at], subroots, [root] * len(at), proofs, folds, [x == root for x in folds]]
        return pa.Table.from_arrays([c if isinstance(c, pa.ChunkedArray) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    out = tree.visit(upper, make, ddl)
    discard(leaves)
    return out
