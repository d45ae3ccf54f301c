"""CSV records whose quoted values hold line breaks, read in parallel.

Whether a line ends inside of quotes depends on whether it begins there, so a line is a function of one
bit: it ends outside, inside, as it began, or the other way round. Spark's text reader cuts the file into
byte ranges wherever it likes; each range gives the composition of its lines' functions, and how many
records begin in it for either beginning. A scan over these few numbers tells where every range begins and
which record its first lines belong to. Then each range puts its records together on its own; only the two
ends of a range can belong to a record that goes on elsewhere, and those pieces alone are shuffled.

Quotes count where a field begins, as in the CSV reader itself: one in the middle of a value is a character.
A file that ends inside of quotes has a quote that was never closed; what follows it can't be told from a
value, so its lines are taken as records, as they stand, and a warning says so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

NOT_BLANK = "[^\\x00-\\x20]"


def ends_inside(line: Column, delimiter: str, inside: bool) -> Column:
    """Whether a line that begins inside of quotes, or not, ends there."""
    start = f"(^|\\Q{delimiter}\\E)\""
    text = F.concat(F.lit('"'), line) if inside else line
    # closed values that begin a field are taken out; what still begins a field with a quote is open
    return F.regexp_replace(text, start + '[^"]*+(?:""[^"]*+)*+"', "$1").rlike(start)


def physical_lines(spark: SparkSession, path: str, delimiter: str) -> DataFrame:
    """block (where its byte range begins), value, full (not blank), and how it ends if it begins outside (out) or inside of quotes (into)."""
    value = F.col("value")
    value = F.when(value.startswith("\ufeff"), F.substring(value, 2, 2**31 - 1)).otherwise(value)  # bytes of other encodings stay as they are
    lines = spark.read.text(path).select(F.col("_metadata.file_block_start").alias("block"), value.alias("value"))
    quoted = F.contains("value", F.lit('"'))
    return lines.select("block", "value", F.col("value").rlike(NOT_BLANK).alias("full"), (quoted & ends_inside(F.col("value"), delimiter, False)).alias("out"), (~quoted | ends_inside(F.col("value"), delimiter, True)).alias("into"))


def spans_lines(spark: SparkSession, path: str, delimiter: str) -> bool:
    """Whether any value may go on in the next line."""
    return not physical_lines(spark, path, delimiter).where("out").isEmpty()


def states(out: np.ndarray, into: np.ndarray, start: bool) -> np.ndarray:
    """[lines + 1] whether each line begins inside of quotes, and at last how the last one ends."""
    fixed, turns = out == into, np.concatenate([[0], np.cumsum(out & ~into)])
    at = np.maximum.accumulate(np.where(fixed, np.arange(len(out)), -1)) if len(out) else np.zeros(0, int)
    known = at >= 0
    base = np.where(known, out[at], start) if len(out) else out
    since = turns[1:] - np.where(known, turns[np.maximum(at, -1) + 1], 0)
    return np.concatenate([[start], base ^ (since % 2 == 1)])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """block and its lines, piece by piece in order."""
    for batch in batches:
        block = batch["block"].to_numpy()
        cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1), len(block)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                yield int(block[a]), batch.slice(a, b - a)


def _flags(part: pa.RecordBatch) -> Iterator[np.ndarray]:
    return (part[c].to_numpy(zero_copy_only=False).astype(bool) for c in ("full", "out", "into"))


def summaries(lines: DataFrame) -> DataFrame:
    """block, and for both beginnings how it ends and how many records begin in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for block, part in _runs(batches):
            full, out, into = _flags(part)
            now = found.setdefault(block, [False, True, 0, 0])
            for start in (0, 1):
                inside = states(out, into, bool(now[start]))
                now[start], now[2 + start] = bool(inside[-1]), now[2 + start] + int((~inside[:-1] & full).sum())
        yield pa.RecordBatch.from_pylist([dict(zip(("block", "end0", "end1", "n0", "n1"), (b, *x), strict=True)) for b, x in found.items()], pa.schema([("block", pa.int64()), ("end0", pa.bool_()), ("end1", pa.bool_()), ("n0", pa.int64()), ("n1", pa.int64())]))

    return lines.mapInArrow(run, "block bigint, end0 boolean, end1 boolean, n0 bigint, n1 bigint")


def beginnings(found: list) -> tuple[dict[int, tuple[bool, int]], bool]:
    """For each block whether it begins inside of quotes and how many records begin before it; and how the file ends."""
    inside, before, out = False, 0, {}
    for r in sorted(found, key=lambda r: r["block"]):
        out[r["block"]] = inside, before
        before += r["n1"] if inside else r["n0"]
        inside = r["end1"] if inside else r["end0"]
    return out, inside


def assembled(lines: DataFrame, begins: dict[int, tuple[bool, int]], encoding: str = "utf-8") -> DataFrame:
    """number (from 1) and text of every record that is not blank."""
    plain = encoding in ("utf-8", "utf-8-sig")
    sent = lines.select("block", F.col("value") if plain else F.col("value").cast("binary").alias("value"), "full", "out", "into")
    ddl = "number bigint, block bigint, text string, whole boolean"
    schema = pa.schema([("number", pa.int64()), ("block", pa.int64()), ("text", pa.string()), ("whole", pa.bool_())])

    def said(values: pa.Array) -> pa.Array:
        return values if plain else pa.array([v.decode(encoding, "replace") for v in values.to_pylist()], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, number, inside, leading = None, [], 0, False, False

        def rest() -> Iterator[pa.RecordBatch]:
            # what is open at the end of a range is a piece of its last record, or of an earlier range's
            if held:
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([block]), pa.array(["\n".join(held)]), pa.array([False])], schema=schema)

        for at, part in _runs(batches):
            if at != block:
                yield from rest()
                block, held, (inside, number) = at, [], begins[at]
                leading = inside
            full, out, into = _flags(part)
            begin = states(out, into, inside)
            inside = bool(begin[-1])
            starts = np.flatnonzero(~begin[:-1])
            ends = np.append(starts[1:], len(full)) if len(starts) else starts
            values = said(part["value"])
            head = int(starts[0]) if len(starts) else len(full)
            if head:  # lines that go on with what is held
                held += values.slice(0, head).to_pylist()
            if not len(starts):
                continue
            if held:
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([block]), pa.array(["\n".join(held)]), pa.array([not leading])], schema=schema)
            held, leading = [], False
            last_open = inside
            single, blank = ends - starts == 1, ~full[starts] & (ends - starts == 1)
            if last_open:
                single[-1] = False
            numbers = number + np.cumsum(~blank)
            number = int(numbers[-1])
            keep = np.flatnonzero(single & ~blank)
            if len(keep):
                yield pa.RecordBatch.from_arrays([pa.array(numbers[keep]), pa.array(np.full(len(keep), block)), values.take(pa.array(starts[keep])), pa.array(np.ones(len(keep), bool))], schema=schema)
            several = [int(i) for i in np.flatnonzero(~single)]
            if last_open:
                held = values.slice(int(starts[-1])).to_pylist()
                several.pop()
            if several:
                texts = ["\n".join(values.slice(int(starts[i]), int(ends[i] - starts[i])).to_pylist()) for i in several]
                yield pa.RecordBatch.from_arrays([pa.array(numbers[several]), pa.array(np.full(len(several), block)), pa.array(texts), pa.array(np.ones(len(several), bool))], schema=schema)
        yield from rest()

    pieces = sent.mapInArrow(run, ddl)
    joined = pieces.where("not whole").groupBy("number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return pieces.where("whole").select("number", "text").unionByName(joined)


def records(spark: SparkSession, path: str, delimiter: str, encoding: str = "utf-8") -> tuple[DataFrame, bool]:
    """number (from 1, blank lines left out) and text of each record, and whether every quote is closed."""
    lines = physical_lines(spark, path, delimiter)
    begins, open_end = beginnings(summaries(lines.select("block", "full", "out", "into")).collect())
    if open_end:
        lines = lines.withColumns({"out": F.lit(False), "into": F.lit(False)})
        begins, _ = beginnings(summaries(lines.select("block", "full", "out", "into")).collect())
    return assembled(lines, begins, encoding), not open_end
