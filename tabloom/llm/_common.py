"""Helpers shared by the training-data operators: staged tables and bounded Arrow batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Text bytes that a Python worker looks at together (one longer text is still handled whole).
CHUNK_BYTES = 3 << 20
#: Rows that go to a Python worker together, at most.
BATCH_ROWS = 2000
#: Characters that separate words; every operator here uses the same six.
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only on a single machine whose session names none."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tabloom-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores after it until df has no such column in any case of letters."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def smallest(df: DataFrame, group: str, order: str, k: int) -> DataFrame:
    """group and end: the k-th smallest distinct value of `order`, a 64-bit hash, in each group (the largest where there are fewer).

    Values are counted by range first (4096 of equal width), so that only the range of a group in
    which its k-th value lies is ranked, and no group is sorted in one task.
    """
    slim = df.select(group, order, F.shiftright(order, 52).alias("range")).distinct()
    ranges = slim.groupBy(group, "range").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy(group).orderBy("range"))
    ranges = ranges.withColumn("before", upto - F.col("n")).where(F.col("before") < k)
    last = ranges.groupBy(group).agg(F.max(F.struct("range", "before")).alias("x")).select(group, F.col("x.range").alias("range"), F.col("x.before").alias("before"))
    inside = slim.join(last, [group, "range"]).withColumn("place", F.col("before") + F.row_number().over(Window.partitionBy(group).orderBy(order)))
    return inside.where(F.col("place") <= k).groupBy(group).agg(F.max(order).alias("end"))


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it again: the lineage ends there, and a lost
    executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete staged tables that nothing will read again."""
    for df in frames:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.staged_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def texts_of(df: DataFrame, *columns: Column | str) -> DataFrame:
    """df's columns for a Python worker. Texts are long, so fewer rows go together than Spark's default."""
    conf = df.sparkSession.conf
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name, "10000")) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df.select(*columns)


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32(doc_id as text) mod folds; a null id gives null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(folds)


_MEMORIES: list[dict] = []


def worker_memory() -> dict:
    """A dictionary that a Python worker keeps from task to task, for as long as these are of the operator that holds it."""
    _MEMORIES.append({})
    return _MEMORIES[-1]


def pieces_of(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES, memory: dict | None = None):
    """Slices of batch with about `limit` bytes of text each, and their texts with null as ''.

    Spark hands workers from one stage to the next; what another operator remembers in this one is forgotten.
    """
    for other in _MEMORIES:
        if other and other is not memory:
            other.clear()
    texts = batch.column(batch.schema.get_field_index(column))
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        part = batch.slice(start, stop - start)
        yield part, pc.fill_null(part.column(part.schema.get_field_index(column)), "")
        start = stop
    give_back()


def give_back() -> None:
    """Return freed memory to the system: workers that wait for their next batch share an executor's limit with those at work."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # other systems' C libraries have no such call
        pass


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct lower-cased words, the code of each word in order, and where each text begins.

    Words are runs of anything but the six ASCII white-space characters.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = lists.flatten()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    full = pc.greater(pc.binary_length(flat), 0)
    if pc.all(full).as_py() is False:
        before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
        flat, offsets = flat.filter(full), before[offsets]
    coded = flat.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), offsets


#: What a byte adds to a word's hash, before it is multiplied by the power of its place; drawn from a fixed seed.
_BYTE = np.random.default_rng(20).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def spaced(texts: pa.Array, others: str, keep: str) -> pa.Array:
    """Lower-cased texts with blanks for all characters but wanted ones: of ASCII those in `keep`, of the rest those that `others` does not match."""
    low = pc.utf8_lower(texts)
    odd = pc.match_substring_regex(low, others)
    if pc.any(odd).as_py():
        low = pc.replace_with_mask(low, odd, pc.replace_substring_regex(low.filter(odd), f"(?:{others})+", " "))
    table = bytes(i if i > 127 or chr(i) in keep else 32 for i in range(256))
    return pa.Array.from_buffers(low.type, len(low), [None, low.buffers()[1], pa.py_buffer((low.buffers()[2] or pa.py_buffer(b"")).to_pybytes().translate(table))], 0, low.offset)


def hash_words(values: pa.Array) -> np.ndarray:
    """64-bit hashes of an array of strings without nulls: polynomials in their bytes, scrambled."""
    values = values.cast(pa.large_binary())
    ends = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)
    size, out = np.diff(ends), np.zeros(len(values), np.uint64)
    longest = int(size.max(initial=0))
    power = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(longest, _STEP, np.uint64))])
    start = 0
    while start < len(size):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + (1 << 19), "right")) - 1)
        n = size[start:stop]
        first = np.cumsum(n) - n
        place = np.arange(n.sum()) - np.repeat(first, n)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data[ends[start] : ends[stop]]] * power[place])])
        out[start:stop] = total[first + n] - total[first] + n.astype(np.uint64) * _STEP
        start = stop
    return mixed(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive offsets; empty ranges give 0."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a flat DDL string such as 'a bigint, b string'."""
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "float": pa.float32(), "boolean": pa.bool_(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "array<float>": pa.list_(pa.float32())}
    return pa.schema([pa.field(n, kinds[k]) for n, k in (x.strip().split(" ", 1) for x in ddl.split(","))])
