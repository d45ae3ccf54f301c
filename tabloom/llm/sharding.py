"""Size-tiered compaction of immutable Parquet shards under a versioned manifest, in DataFrame operations.

A dataset is a folder with data files and manifests. An append writes arrivals as new small files
and commits a manifest that also lists them. A compaction groups files of like size (a tier spans a
factor of fan_in), in order of arrival, and rewrites each full group as files of at most about
target_bytes; the merged file lands a tier higher, until files reach the target. Readers see what
the newest manifest lists and nothing else; a manifest becomes visible by one rename that fails
if its version exists, so of two writers one commits and the other must retry. Files that no
manifest lists are invisible, whether from a lost task, a failed job or an outdated version.

A manifest holds a row for each file (path, bytes, rows, born), as Parquet; planning is a window
over those rows. Rows are dealt to the files of a merge in turn, by their number in the merge, whatever
they hold; the files of a round are numbered, and each is one task that gets the rows of its number
alone, so a task reads about target_bytes. All columns are kept as they are, of any type and name,
nulls and repeated rows too, and an empty append commits a version without files. The paths of the
files to read pass through the driver, as in Spark's own list of files.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from ._common import free_name

MANIFEST = "path string, bytes long, rows long, born long"
#: Up to so many planned files, the plan is broadcast; beyond, it is joined by a shuffle.
BROADCAST_FILES = 20_000


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    return jvm.org.apache.hadoop.fs.FileContext.getFileContext(jvm.java.net.URI(path.replace(" ", "%20")), spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def versions(spark: SparkSession, root: str) -> list[int]:
    """The committed versions, in order."""
    files, path = _fs(spark, root)
    if not files.util().exists(path(f"{root}/manifest")):
        return []
    names = [s.getPath().getName() for s in files.util().listStatus(path(f"{root}/manifest"))]
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())


def manifest(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The files of a version, by default the newest."""
    known = versions(spark, root)
    if not known:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest/v{version if version is not None else known[-1]:08d}")


def commit(entries: DataFrame, root: str, version: int) -> None:
    """Make entries the manifest of `version`; fails if that version exists."""
    spark = entries.sparkSession
    files, path = _fs(spark, root)
    draft = f"{root}/drafts/{uuid.uuid4().hex}"
    entries.coalesce(1).write.parquet(draft)
    files.mkdir(path(f"{root}/manifest"), None, True)
    kinds = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    files.rename(path(draft), path(f"{root}/manifest/v{version:08d}"), kinds)


def read_files(spark: SparkSession, schema: StructType, paths: list[str]) -> DataFrame:
    """The rows of some data files, with _metadata as Spark gives it."""
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(*paths)


def entries_of(spark: SparkSession, schema: StructType, folder: str, born: int) -> DataFrame:
    """Manifest rows of the data files in a folder that was just written."""
    files, path = _fs(spark, folder)
    if not files.util().exists(path(folder)):
        return spark.createDataFrame([], MANIFEST)
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(folder)
    meta = rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"))
    return meta.groupBy("path", "bytes").agg(F.count(F.lit(1)).alias("rows")).withColumn("born", F.lit(born).cast("long")).select("path", "bytes", "rows", "born")


def append_each(arrivals: DataFrame, root: str, batch: Column, values: Iterable[int], between: Callable[[], object] = lambda: None) -> list[int]:
    """Write arrivals once, in a folder for each value of batch, and commit the folders of `values` one by
    one; `between` runs after each commit. The new versions. Rows of other values are in none of them."""
    spark, out = arrivals.sparkSession, []
    folder = f"{root}/data/{uuid.uuid4().hex}"
    name = free_name(arrivals, "arrival")
    arrivals.withColumn(name, batch).write.partitionBy(name).option("compression", "zstd").parquet(folder)
    for value in values:
        version = (versions(spark, root) or [0])[-1] + 1
        commit(manifest(spark, root).unionByName(entries_of(spark, arrivals.schema, f"{folder}/{name}={value}", version)), root, version)
        out.append(version)
        between()
    return out


def append(arrivals: DataFrame, root: str, batch: Column | None = None) -> int:
    """Write arrivals as small shards (with batch: a folder of shards for each of its values) and commit; the new version."""
    spark = arrivals.sparkSession
    version = (versions(spark, root) or [0])[-1] + 1
    folder = f"{root}/data/{uuid.uuid4().hex}"
    name = free_name(arrivals, "arrival")
    rows = arrivals if batch is None else arrivals.withColumn(name, batch)
    (rows.write if batch is None else rows.write.partitionBy(name)).option("compression", "zstd").parquet(folder)
    commit(manifest(spark, root).unionByName(entries_of(spark, arrivals.schema, folder, version)), root, version)
    return version


def plan(entries: DataFrame, target_bytes: int, fan_in: int, least: int) -> DataFrame:
    """Of each file to merge now: path, before (rows of its group's earlier files), parts (files that its group
    becomes) and first (the number of the first of them among all).

    Files below half the target are in tiers by size; in each, every fan_in of them in order of
    arrival are a group. With least < fan_in, the rest of a tier is a group as well if it has so many.
    """
    tier = F.floor(F.log(F.greatest("bytes", F.lit(1)).cast("double")) / F.log(F.lit(float(fan_in))))
    small = entries.where(F.col("bytes") < target_bytes / 2).withColumn("tier", tier)
    place = F.row_number().over(Window.partitionBy("tier").orderBy("born", "path"))
    groups = small.withColumn("group", F.floor((place - 1) / fan_in))
    whole = Window.partitionBy("tier", "group")
    earlier = whole.orderBy("born", "path").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("members", F.count(F.lit(1)).over(whole)).withColumn("size", F.sum("bytes").over(whole)).withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0))).where(F.col("members") >= least)
    groups = groups.withColumn("parts", F.greatest(F.lit(1), F.round(F.col("size") / target_bytes)).cast("int"))
    sizes = groups.groupBy("tier", "group").agg(F.first("parts").alias("n"))
    sizes = sizes.withColumn("first", F.sum("n").over(Window.orderBy("tier", "group")) - F.col("n"))
    return groups.join(sizes, ["tier", "group"]).select("path", "before", "parts", "first")


def compact(spark: SparkSession, schema: StructType, root: str, target_bytes: int = 512 << 20, fan_in: int = 8, least: int | None = None) -> int | None:
    """One round over all tiers: merge what plan() gives and commit; the new version, or None if there is nothing to do."""
    known = versions(spark, root)
    if not known:
        return None
    now = manifest(spark, root, known[-1])
    todo = plan(now, target_bytes, fan_in, least or fan_in).cache()
    paths = [r[0] for r in todo.select("path").collect()]
    if not paths:
        todo.unpersist()
        return None
    version, folder = known[-1] + 1, f"{root}/data/{uuid.uuid4().hex}"
    wanted = F.broadcast(todo) if len(paths) <= BROADCAST_FILES else todo
    names = [F.col(f"`{n}`") for n in schema.names]
    rows = read_files(spark, schema, paths).select(F.struct(*names).alias("row"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("at")).join(wanted, "path")
    files = todo.agg(F.max(F.col("first") + F.col("parts"))).first()[0]
    number = (F.col("first") + F.pmod(F.col("before") + F.col("at"), F.col("parts"))).cast("int")
    rows.select("row", number.alias("file")).repartitionById(int(files), "file").select("row.*").write.option("compression", "zstd").parquet(folder)
    kept = now.join(todo.select("path"), "path", "left_anti").select("path", "bytes", "rows", "born")
    commit(kept.unionByName(entries_of(spark, schema, folder, version)), root, version)
    todo.unpersist()
    return version


def expire(spark: SparkSession, root: str, keep: int = 1) -> None:
    """Delete all but the newest `keep` versions, and the data files that only those list."""
    known = versions(spark, root)
    old, new = known[:-keep], known[-keep:]
    if not old:
        return
    union = lambda vs: [r[0] for r in spark.read.schema(MANIFEST).parquet(*[f"{root}/manifest/v{v:08d}" for v in vs]).select("path").distinct().collect()]
    files, path = _fs(spark, root)
    for p in set(union(old)) - set(union(new)):
        files.delete(path(p), False)
    for v in old:
        files.delete(path(f"{root}/manifest/v{v:08d}"), True)


def read(spark: SparkSession, schema: StructType, root: str) -> DataFrame:
    """The rows of the newest version, with the file they are in (as shard_path)."""
    paths = [r[0] for r in manifest(spark, root).select("path").collect()]
    if not paths:
        return spark.createDataFrame([], schema.add("shard_path", "string"))
    return read_files(spark, schema, paths).select(*[F.col(f"`{n}`") for n in schema.names], F.col("_metadata.file_path").alias("shard_path"))
