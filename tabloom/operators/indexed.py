"""Tables with indexes beside them: a trigram index for searches, and order indexes for deep pages.

Rows are numbered and cut into ranges of RANGE rows, and the Parquet files are written range by range, so
that a filter on the range number skips whole files and row groups. The trigram index says in which ranges
each three letters of the folded texts occur, sorted by trigram. A search asks it for the ranges that hold
all trigrams of the needle and verifies only those: the answer is that of a search over all rows. Needles of
less than three letters have no trigram, so all ranges are read. An order index is the table once more,
in ranges of the sort order, with the number of rows in each; a page reads the one or two ranges it lies in.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..functions.text import search_key
from .browse import LARGEST_PAGE, PAGE_SIZE, Page, search
from .clean import numbered
from .metrics import named

RANGE = 2000
#: Candidate ranges up to which they are named in the filter; beyond, they are joined.
NAMED = 1000
PLACE, PART = "__place", "__range"


def write_indexed(df: DataFrame, path: str, columns: list[str] | None = None, rows: int = RANGE) -> None:
    """df below path, numbered in its order, with the trigrams of `columns` (all, if not given)."""
    spark = df.sparkSession
    held = numbered(df, PLACE).withColumn(PART, F.floor((F.col(PLACE) - 1) / rows))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held.repartitionByRange(tasks, PLACE).sortWithinPartitions(PLACE).write.option("parquet.block.size", 1 << 20).parquet(f"{path}/rows")
    stored = spark.read.parquet(f"{path}/rows")
    kinds = dict(stored.dtypes)
    wanted = columns or [c for c in df.columns]
    forms = [search_key(named(c)) if kinds[c] == "string" else F.lower(named(c).cast("string")) for c in wanted]
    keys = stored.select(PART, *[F.coalesce(k, F.lit("")).alias(f"k{i}") for i, k in enumerate(forms)])
    pairs = keys.mapInArrow(grams_of_ranges, f"{PART} long, gram string")
    lists = pairs.groupBy("gram").agg(F.sort_array(F.collect_set(PART)).alias("ranges")).withColumn("n", F.size("ranges").cast("long"))
    lists.repartitionByRange(max(1, tasks // 4), "gram").sortWithinPartitions("gram").write.parquet(f"{path}/grams")
    spark.createDataFrame([(",".join(wanted), rows)], "columns string, rows int").coalesce(1).write.parquet(f"{path}/about")


def grams_of_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The range and each of its trigrams once, for runs of rows of one range: first column the range, all others texts."""
    for batch in batches:
        part = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1), len(part)] if len(part) else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            codes = np.unique(np.concatenate([gram_codes(batch.column(i).slice(a, b - a)) for i in range(1, batch.num_columns)]))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), part[a])), gram_texts(codes)], [PART, "gram"])


def gram_codes(texts: pa.Array) -> np.ndarray:
    """All trigrams of all texts as numbers, 21 bits for each code point."""
    points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(points) < 3:
        return np.zeros(0, np.uint64)
    size = pc.utf8_length(texts).to_numpy().astype(np.int64)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(points))  # letters from here to the end of the text
    codes = points[:-2] << np.uint64(42) | points[1:-1] << np.uint64(21) | points[2:]
    return codes[left[:-2] >= 3]


def gram_texts(codes: np.ndarray) -> pa.Array:
    """The trigrams of numbers."""
    points = np.stack([codes >> np.uint64(42), codes >> np.uint64(21) & np.uint64(0x1FFFFF), codes & np.uint64(0x1FFFFF)], axis=1).astype("<u4")
    size = (1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)).sum(axis=1)
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(codes), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(points.tobytes().decode("utf-32-le").encode())])


def trigrams(key: str) -> list[str]:
    return sorted({key[i : i + 3] for i in range(len(key) - 2)})


def candidate_ranges(spark: SparkSession, path: str, text: str) -> list[int] | None:
    """The ranges that hold every trigram of the text; None where it has none, so that all may."""
    key = spark.range(1).select(search_key(F.lit(text)).alias("key")).first()["key"]
    wanted = trigrams(key)
    if not wanted:
        return None
    lists = spark.read.parquet(f"{path}/grams").where(F.col("gram").isin(wanted))
    got = lists.select(F.explode("ranges").alias("range")).groupBy("range").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(wanted))
    return [r["range"] for r in got.orderBy("range").collect()]


def search_indexed(spark: SparkSession, path: str, text: str) -> DataFrame:
    """The rows in which some indexed column contains text, as browse.search finds them, from the candidate ranges alone."""
    rows = spark.read.parquet(f"{path}/rows")
    columns = spark.read.parquet(f"{path}/about").first()["columns"].split(",")
    ranges = candidate_ranges(spark, path, text) if text.strip() else None
    if ranges is not None:
        if len(ranges) <= NAMED:
            rows = rows.where(F.col(PART).isin(ranges)) if ranges else rows.where(F.lit(False))
        else:
            rows = rows.join(F.broadcast(spark.createDataFrame([(r,) for r in ranges], f"{PART} long")), PART, "left_semi")
    return search(rows, text, columns).drop(PLACE, PART)


def write_order_index(df: DataFrame, path: str, column: str, descending: bool = False, tie_break: list[str] | None = None, ranges: int | None = None) -> None:
    """df in ranges of its order by a column (nulls last either way), ties by tie_break or all other columns, with the rows of each range."""
    spark = df.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = order_of(df, column, descending, tie_break)
    placed = df.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).withColumn(PART, F.spark_partition_id())
    placed.write.partitionBy(PART).parquet(f"{path}/rows")
    stored = spark.read.schema(placed.schema).parquet(f"{path}/rows")
    stored.groupBy(F.col(PART).alias("range")).agg(F.count(F.lit(1)).alias("n")).coalesce(1).write.parquet(f"{path}/counts")
    ties = tie_break if tie_break is not None else [c for c in df.columns if c != column]
    spark.createDataFrame([(column, descending, ties, placed.schema.json())], "column string, descending boolean, ties array<string>, schema string").coalesce(1).write.parquet(f"{path}/about")


def order_of(df: DataFrame, column: str, descending: bool, tie_break: list[str] | None) -> list:
    first = F.desc_nulls_last(named(column)) if descending else F.asc_nulls_last(named(column))
    return [first, *[F.asc_nulls_last(named(c)) for c in (tie_break if tie_break is not None else [c for c in df.columns if c != column])]]


def page_rows(spark: SparkSession, path: str, page: int = 1, size: int = PAGE_SIZE) -> tuple[DataFrame, int, list[int]]:
    """A page of an order index as a DataFrame in order, the number of all rows, and the ranges that it reads."""
    about = spark.read.parquet(f"{path}/about").first()
    size = max(1, min(size, LARGEST_PAGE))
    first, total, wanted, before = (max(page, 1) - 1) * size, 0, [], None
    for r in spark.read.parquet(f"{path}/counts").orderBy("range").collect():  # one row for each range
        if total < first + size and total + r["n"] > first:
            before = total if before is None else before
            wanted.append(r["range"])
        total += r["n"]
    rows = spark.read.schema(StructType.fromJson(json.loads(about["schema"]))).parquet(f"{path}/rows")
    inside = rows.where(reduce(lambda a, b: a | b, [F.col(PART) == r for r in wanted], F.lit(False))).drop(PART)
    keys = order_of(inside, about["column"], about["descending"], about["ties"])
    return inside.orderBy(*keys).offset(first - (before or 0)).limit(size), total, wanted


def browse_order(spark: SparkSession, path: str, page: int = 1, size: int = PAGE_SIZE) -> Page:
    """As browse.browse without a search, from an order index."""
    rows, total, _ = page_rows(spark, path, page, size)
    return Page([r.asDict() for r in rows.collect()], total, page, max(1, math.ceil(total / max(1, min(size, LARGEST_PAGE)))))
