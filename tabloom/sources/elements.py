"""The record elements of an XML file, found and read in parallel.

The file is cut at every `>` by Spark's text reader, so each piece ends a tag, or belongs to a comment, a CDATA section, a
quoted attribute or an instruction that holds a `>`. What a piece means depends on which of these it begins in, and how
deep; so each byte range first gives, for every beginning that its text allows, where it ends and by how much the
depth changes. A scan over these few numbers tells how each range really begins. Then every range counts its elements
by depth, parent and name, which settles the record element, and after that puts its records together; only a record that
goes over the end of a range is put together from its parts by a shuffle.

Nothing is taken from the head of the file. Entity declarations that hold markup are not understood: such files are refused as broken.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .sniff import FileError

# How a piece may begin.
TEXT, DOUBLE, SINGLE, COMMENT, CDATA, INSTRUCTION, IMPOSSIBLE = range(7)
MARKS = [("!--", "--", COMMENT), ("![CDATA[", "]]", CDATA), ("?", "?", INSTRUCTION)]
ENDS = {inside: end for _, end, inside in MARKS}
NAME = re.compile(r"[^\s/]+")
FIELDS = "row long, names array<string>, texts array<string>, nested boolean, broken boolean"


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """block (where a piece's byte range begins) and value, in order in each range."""
    text = spark.read.option("lineSep", ">").text(path)
    return text.select(F.col("_metadata.file_block_start").alias("block"), "value")


def quoted(text: str, state: int) -> int:
    """How a tag's text ends that begins inside of no quote, or of one. No quoted value holds `<`, which rules beginnings out."""
    at = 0
    while True:
        if state == TEXT:
            double, single = text.find('"', at), text.find("'", at)
            if double < 0 and single < 0:
                return TEXT
            state, at = (DOUBLE, double + 1) if single < 0 or 0 <= double < single else (SINGLE, single + 1)
        else:
            end = text.find('"' if state == DOUBLE else "'", at)
            if text.find("<", at, end if end >= 0 else len(text)) >= 0:
                return IMPOSSIBLE
            if end < 0:
                return state
            state, at = TEXT, end + 1


def after(state: int, piece: str) -> tuple[int, str | None, int]:
    """How the next piece begins, the element that this one opens, and how many elements it closes."""
    if state == TEXT:
        start = piece.find("<")
        if start < 0:
            return TEXT, None, 0
        tag = piece[start + 1 :]
        if tag.startswith("/"):
            return TEXT, None, 1
        for mark, end, inside in MARKS:
            if tag.startswith(mark):
                return TEXT if tag.endswith(end) and len(tag) >= len(mark) + len(end) else inside, None, 0
        name = NAME.match(tag)
        if tag.startswith("!") or not name:
            return TEXT, None, 0
        state = quoted(tag, TEXT)
        return state, name[0], int(state == TEXT and tag.endswith("/"))
    if state in ENDS:
        return TEXT if piece.endswith(ENDS[state]) else state, None, 0
    state = quoted(piece, state)
    return state, None, int(state == TEXT and piece.endswith("/"))


def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[str]]]:
    """The byte ranges of a task, each with its pieces. Pieces must be used up before the next range is asked for."""
    flat = ((b, v) for batch in batches for b, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
    ahead = next(flat, None)
    while ahead is not None:
        block = ahead[0]

        def own() -> Iterator[str]:
            nonlocal ahead
            while ahead is not None and ahead[0] == block:  # noqa: B023
                piece = ahead[1]
                ahead = next(flat, None)
                yield piece

        yield block, own()


def _table(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each range and each way that it may begin: how it ends, and the change of depth."""
    for block, own in by_block(batches):
        now = {s: (s, 0) for s in range(IMPOSSIBLE)}
        for piece in own:
            step = {s: after(s, piece) for s in {state for state, _ in now.values()}}
            now = {begin: (step[s][0], depth + (step[s][1] is not None) - step[s][2]) for begin, (s, depth) in now.items() if step[s][0] != IMPOSSIBLE}
        yield _table([(block, begin, end, depth) for begin, (end, depth) in now.items()] or [(block, -1, -1, 0)], ["block", "begin", "end", "depth"], [pa.int64(), pa.int32(), pa.int32(), pa.int64()])


def beginnings(spark: SparkSession, path: str) -> dict[int, tuple[int, int]]:
    """How each byte range begins, and how deep: one entry for each range of the file."""
    found: dict[int, dict[int, tuple[int, int]]] = {}
    for block, begin, end, depth in pieces(spark, path).mapInArrow(_effects, "block long, begin int, end int, depth long").collect():
        found.setdefault(block, {})[begin] = (end, depth)
    state, depth, out = TEXT, 0, {}
    for block in sorted(found):
        out[block] = (state, depth)
        if state not in found[block]:
            raise FileError("broken XML: a tag or a quoted value is not closed")
        state, change = found[block][state]
        depth += change
    if state != TEXT or depth != 0:
        raise FileError("broken XML: elements are not closed")
    return out


def _census(starts: dict[int, tuple[int, int]]):
    """Elements of a range by depth (4 stands for more), parent (null where it began in an earlier range) and name: how many, and the first and last place."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, own in by_block(batches):
            state, depth = starts[block]
            parent, seen = None, {}
            for n, piece in enumerate(own):
                state, name, closes = after(state, piece)
                if name is not None:
                    depth += 1
                    key = (min(depth, 4), parent if depth == 3 else None, name)
                    at = seen.setdefault(key, [0, block + n, 0])  # a piece is a byte at least, so places ascend over ranges
                    at[0] += 1
                    at[2] = block + n
                    if depth == 2:
                        parent = name
                depth -= closes
            if seen:
                yield _table([(block, *k, *v) for k, v in seen.items()], ["block", "depth", "parent", "name", "n", "first", "last"], [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()])

    return count


@dataclass
class Layout:
    """Where a file's records are, and how each byte range begins."""

    level: int
    parent: str | None
    name: str
    starts: dict[int, tuple[int, int]]
    children: dict[int, str | None]  # the root's last child before a range
    rows: dict[int, tuple[int, bool]]  # the records before a range, and whether it begins in the last of them


def _record_element(children: DataFrame, grandchildren: DataFrame) -> tuple[str | None, str]:
    """Parent (null: the root) and name of the records: the root's child that repeats most, or that of the first of
    the root's children whose own children repeat. Equal counts go to the name that comes first in the file."""
    top = children.groupBy("name").agg(F.sum("n").alias("n"), F.min("first").alias("first")).orderBy(F.desc("n"), "first").first()
    if top is not None and top["n"] >= 2:
        return None, top["name"]
    counts = grandchildren.groupBy("parent", "name").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    best = counts.groupBy("parent").agg(F.max(F.struct("n", (-F.col("first")).alias("early"), "name")).alias("top"), F.min("first").alias("first"))
    row = best.where("top.n >= 2").orderBy("first").select("parent", "top.name").first()
    if row is None:
        raise FileError("no element repeats in the XML")
    return row["parent"], row["name"]


def layout(spark: SparkSession, path: str) -> Layout:
    """What the whole file's elements say of its records."""
    starts = beginnings(spark, path)
    census = pieces(spark, path).mapInArrow(_census(starts), "block long, depth int, parent string, name string, n long, first long, last long").persist()
    try:
        lasts = {(b, d): top for b, d, top in census.where("depth < 4").groupBy("block", "depth").agg(F.max(F.struct("last", "parent", "name"))).collect()}
        children, child = {}, None
        for block in sorted(starts):
            children[block] = child
            child = lasts[block, 2]["name"] if (block, 2) in lasts else child
        known = spark.createDataFrame(list(children.items()), "block long, carried string")
        grandchildren = census.where("depth = 3").join(known, "block").withColumn("parent", F.coalesce("parent", "carried"))
        parent, name = _record_element(census.where("depth = 2"), grandchildren)
        level = 2 if parent is None else 3
        mine = census.where("depth = 2") if parent is None else grandchildren.where(F.col("parent") == parent)
        counts = dict(mine.where(F.col("name") == name).groupBy("block").agg(F.sum("n")).collect())
        rows, before, last = {}, 0, None
        for block in sorted(starts):
            rows[block] = (before, starts[block][1] >= level and last == (parent, name))
            before += counts.get(block, 0)
            if (block, level) in lasts:
                top = lasts[block, level]
                last = (None if parent is None else top["parent"] or children[block], top["name"])
        return Layout(level, parent, name, starts, children, rows)
    finally:
        census.unpersist()


def _texts(where: Layout):
    """The records of a range: row, part, text, and whether the text is the whole of it."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = lambda rows: _table(rows, ["row", "part", "text", "whole"], [pa.int64(), pa.int64(), pa.string(), pa.bool_()])
        for block, own in by_block(batches):
            (state, depth), child, (row, inside) = where.starts[block], where.children[block], where.rows[block]
            began, text, out, size = False, [], [], 0
            for piece in own:
                state, opened, closes = after(state, piece)
                if opened is not None:
                    depth += 1
                    if depth == 2:
                        child = opened
                    if depth == where.level and opened == where.name and where.parent in (None, child):
                        row, inside, began = row + 1, True, True
                        piece = piece[piece.index("<") :]
                depth -= closes
                if inside:
                    text.append(piece + ">")
                    size += len(piece)
                    if depth < where.level:
                        out.append((row, block, "".join(text), began))
                        inside, text = False, []
                        if size > 1 << 22:
                            yield batch(out)
                            out, size = [], 0
            if inside and text:
                out.append((row, block, "".join(text), False))
            if out:
                yield batch(out)

    return read


def fields_of(text: str) -> tuple[list[str], list[str | None], bool]:
    """Names and texts of a record: its attributes, then its children (of one name, the last), and whether a child has children."""
    found: dict[str, str | None] = {}
    depth, nested, words = 0, False, []

    def start(name: str, attributes: dict[str, str]) -> None:
        nonlocal depth, nested
        depth += 1
        if depth == 1:
            found.update(attributes)
        nested |= depth > 2
        words.clear()

    def end(name: str) -> None:
        nonlocal depth
        if depth == 2:
            found[name] = "".join(words)
        depth -= 1

    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, words.append
    parser.Parse(text, True)
    return list(found), list(found.values()), nested


def _fields(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            try:
                rows.append((row, *fields_of(text), False))
            except expat.ExpatError:
                rows.append((row, [], [], False, True))
        if rows:
            yield _table(rows, ["row", "names", "texts", "nested", "broken"], [pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.bool_(), pa.bool_()])


def records(spark: SparkSession, path: str, where: Layout) -> DataFrame:
    """row (from 1, in the file's order), names and texts of each record's fields, and whether it is nested or broken."""
    texts = pieces(spark, path).mapInArrow(_texts(where), "row long, part long, text string, whole boolean")
    parts = texts.where("NOT whole").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("part", "text"))).alias("parts"))
    joined = parts.select("row", F.array_join(F.col("parts.text"), "").alias("text"))
    return texts.where("whole").select("row", "text").unionByName(joined).mapInArrow(_fields, FIELDS)
