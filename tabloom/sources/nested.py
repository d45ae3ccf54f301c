"""The records of a large JSON file, found and read in parallel.

The file is cut at every `}` by Spark's text reader. Whether a byte range begins inside of a string, and how deep, is told by a scan
over what each range does for either beginning. Then every range gives the texts of its records (the objects of the root's
array, or of lists among an object's own values), and what is left around them, with a mark for each run of records. The rests
together are the envelope: small, and parsed on the driver, which also shows that the file is whole. Only a
record that goes over the end of a range is put together by a shuffle.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import scratch
from .elements import by_block
from .sniff import MOST_BYTES, FileError

#: Stands for records in an envelope; no JSON text holds it.
MARK = "\0"
TOKEN = re.compile(r'"[^"\\]*+(?:\\.[^"\\]*+)*+("?)|[{}\[\]]', re.S)
STRING_END = re.compile(r'[^"\\]*+(?:\\.[^"\\]*+)*+("?)', re.S)
RUN = re.compile(r"(\0\s*,\s*)+(?=\0)")


def pieces(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_block_start").alias("block"), "value")


def tokens(piece: str, inside: bool) -> Iterator[tuple[str, int, int]]:
    """Brackets outside of strings, each with its ends; at last `"` if the piece ends inside of a string."""
    at = 0
    if inside:
        found = STRING_END.match(piece)
        at = found.end()
        if not found[1]:
            yield '"', at, at
            return
    for found in TOKEN.finditer(piece, at):
        c = piece[found.start()]
        if c != '"':
            yield c, found.start(), found.end()
        elif not found[1]:
            yield '"', found.end(), found.end()
            return


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each range and either beginning: whether it ends inside of a string, and the change of depth."""
    for block, own in by_block(batches):
        now = [(False, 0), (True, 0)]
        for piece in own:
            steps = {inside: [c for c, _, _ in tokens(piece + "}", inside)] for inside in {x[0] for x in now}}
            change = {inside: sum((c in "{[") - (c in "}]") for c in found) for inside, found in steps.items()}
            now = [(steps[inside][-1:] == ['"'], depth + change[inside]) for inside, depth in now]
        yield pa.RecordBatch.from_pydict({"block": [block], "end0": [now[0][0]], "depth0": [now[0][1]], "end1": [now[1][0]], "depth1": [now[1][1]]})


def _parts(starts: dict[int, tuple[bool, int]], level: int):
    """Of each range: its records (n: which in the range, 0 for one that began before; list: which list of the range, 0 for one
    that began before), and with n = -1 what is around them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, own in by_block(batches):
            inside, depth = starts[block]
            n, lists, text, rest, out = 0, 0, [], [], []
            began = False
            for piece in own:
                piece += "}"
                at, ended = 0, False
                for c, start, end in tokens(piece, inside):
                    if c == '"':
                        ended = True
                        continue
                    if c in "{[":
                        if c == "[" and depth == level - 1:
                            lists += 1
                        if c == "{" and depth == level:
                            rest.append(piece[at:start])
                            at, n, began = start, n + 1, True
                        depth += 1
                    else:
                        depth -= 1
                        if c == "}" and depth == level:
                            out.append((block, n, lists, piece_text(text, piece[at:end]), began))
                            rest.append(MARK)
                            at, began, text = end, False, []
                inside = ended
                (text if depth > level else rest).append(piece[at:])
                if len(out) >= 5000:
                    yield table(out)
                    out = []
            if depth > level:
                out.append((block, n, lists, "".join(text), False))
            out.append((block, -1, lists, RUN.sub("", "".join(rest)), False))
            yield table(out)

    def piece_text(text: list[str], last: str) -> str:
        return "".join([*text, last])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()))], ["block", "n", "list", "text", "whole"])

    return run


def records(spark: SparkSession, path: str) -> tuple[DataFrame, list | tuple] | None:
    """number (from 1, in the file's order), list (which, from 1) and text of each record, and the envelope: lists of records are [MARK],
    objects tuples of pairs, numbers texts. None where the file is no list of objects and no object with such lists."""
    found = pieces(spark, path).mapInArrow(_effects, "block long, end0 boolean, depth0 long, end1 boolean, depth1 long").collect()
    inside, depth, starts = False, 0, {}
    for r in sorted(found, key=lambda r: r["block"]):
        starts[r["block"]] = inside, depth
        depth += r["depth1"] if inside else r["depth0"]
        inside = r["end1"] if inside else r["end0"]
    # the last piece gets a bracket that may not be there
    if inside or depth not in (0, -1):
        raise FileError("broken JSON")
    first = pieces(spark, path).where("block = 0").first()
    first = first["value"].lstrip("\ufeff \t\r\n")[:1] if first else ""
    if first not in ("{", "["):
        return None
    out = scratch(spark, "json-records")
    pieces(spark, path).mapInArrow(_parts(starts, 1 if first == "[" else 2), "block long, n long, list long, text string, whole boolean").write.parquet(out)
    parts = spark.read.parquet(out)
    around = parts.where("n = -1").select("block", "list", F.when(F.length("text") <= MOST_BYTES, F.col("text")).alias("text")).collect()
    around.sort(key=lambda r: r["block"])
    if sum(len(r["text"] or " " * MOST_BYTES) for r in around) > MOST_BYTES:
        raise FileError(f"the JSON has over {MOST_BYTES >> 20} MB outside of records")
    envelope = RUN.sub("", "".join(r["text"] for r in around)).lstrip("\ufeff").rstrip()
    envelope = envelope[:-1] if depth == -1 else envelope
    tops = dict(parts.where("n >= 0").groupBy("block").agg(F.max("n")).collect())
    offsets, before, lists = [], 0, 0
    for r in around:
        offsets.append((r["block"], before, lists))
        before, lists = before + tops.get(r["block"], 0), lists + r["list"]
    placed = parts.where("n >= 0").join(F.broadcast(spark.createDataFrame(offsets, "block long, before long, lists long")), "block")
    placed = placed.select((F.col("before") + F.col("n")).alias("number"), (F.col("lists") + F.col("list")).alias("list"), "block", "text", "whole")
    split = placed.where("NOT whole").groupBy("number").agg(F.min("list").alias("list"), F.array_sort(F.collect_list(F.struct("block", "text"))).alias("x"))
    joined = split.select("number", "list", F.array_join("x.text", "").alias("text"))
    text, runs = re.subn(r"\[\s*\0\s*\]", json.dumps([MARK]).replace("\\", "\\\\"), envelope)
    if not runs or MARK in text:
        return None
    try:
        root = json.loads(text, object_pairs_hook=tuple, parse_int=str, parse_float=str, parse_constant=str)
    except json.JSONDecodeError as error:
        raise FileError("broken JSON") from error
    return placed.where("whole").select("number", "list", "text").unionByName(joined), root
