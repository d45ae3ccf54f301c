"""A catalog's state in hash buckets: what a snapshot changes is written, and merged with the rest when it is read.

A version is a folder with the rows that its snapshots changed, by bucket, and a manifest that lists for each bucket the
runs that make up its state: a base, and later rows that replace the base's rows of the same key. The manifest is
written last and once, so a version is there whole or not at all. A bucket whose later rows have become half as many as its
base's, or that has over RUNS runs, gets a new base; other buckets stay as they are.

A full snapshot says of each item in it that it was seen. That is not written by item: an active item was in the last
full snapshot, so its last_seen_at is at least that snapshot's time, which the manifest has.

Manifests have at most buckets * (RUNS + 1) entries. Files of versions that are no longer wanted go by `forget`.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..operators import catalog
from . import files

BUCKETS = 64
RUNS = 8
OWN = ["__at", "__old_price", "__changed"]  # of a run's rows: when they were written, and what the price was


def state_versions(spark: SparkSession, root: str) -> list[int]:
    """The versions of a catalog's state that are complete, in order."""
    found = [n for n in files.names(spark, root) if n.startswith("version=")]
    return sorted(int(n.partition("=")[2]) for n in found if files.exists(spark, f"{root}/{n}/manifest.json"))


def manifest(spark: SparkSession, root: str, version: int) -> dict:
    return json.loads(files.read_text(spark, f"{root}/version={version}/manifest.json"))


def read_state(spark: SparkSession, root: str, known: dict, buckets: list[str] | None = None) -> DataFrame:
    """The state that a manifest describes, or some buckets of it: bases without the keys that came later, and these as they are now."""
    schema = StructType.fromJson(known["schema"])
    runs = {b: r for b, r in known["runs"].items() if buckets is None or b in buckets}
    of = lambda some: spark.read.schema(schema).parquet(*[f"{root}/{folder}/__bucket={b}" for b, folder in some])
    rows = of([(b, r[0][0]) for b, r in runs.items()])
    later = [(b, folder) for b, r in runs.items() for folder, _ in r[1:]]
    if later:
        columns = [c for c in rows.columns if c != catalog.KEY]
        # struct() of quoted names: those of a sender may hold dots
        newest = of(later).groupBy(catalog.KEY).agg(F.max_by(F.struct(*[catalog.named(c) for c in columns]), "__at").alias("__row"))
        newest = newest.select(catalog.KEY, *[F.col("__row")[c].alias(c) for c in columns])
        rows = rows.join(newest.select(catalog.KEY), catalog.KEY, "left_anti").unionByName(newest)
    rows = rows.drop(*OWN)
    if known["full_at"] is None:
        return rows
    return rows.withColumn("last_seen_at", F.when(F.col("active"), F.greatest("last_seen_at", F.timestamp_micros(F.lit(known["full_at"])))).otherwise(F.col("last_seen_at")))


def latest_state(spark: SparkSession, root: str, before: int | None = None) -> DataFrame | None:
    known = [v for v in state_versions(spark, root) if before is None or v < before]
    return read_state(spark, root, manifest(spark, root, known[-1])) if known else None


def _write(rows: DataFrame, buckets: int, path: str) -> None:
    """Rows by bucket, sorted by key in each."""
    placed = rows.withColumn("__bucket", F.pmod(F.xxhash64(catalog.KEY), F.lit(buckets)).cast("int"))
    placed.repartition("__bucket").sortWithinPartitions("__bucket", catalog.KEY).write.mode("overwrite").partitionBy("__bucket").parquet(path)


def _written(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def _apply(spark: SparkSession, root: str, known: dict, items: DataFrame, at: int, mode: str, step: str) -> dict:
    """The manifest after a snapshot, whose changes are written below `step`."""
    previous = read_state(spark, root, known) if known["runs"] else None
    rows = catalog.changed_rows(previous, items, F.timestamp_micros(F.lit(at)), mode).withColumn("__at", F.lit(at))
    _write(rows, known["buckets"], f"{root}/{step}/rows")
    written = _written(spark, f"{root}/{step}/rows", rows.schema)
    counts = written.groupBy(F.col("__bucket").cast("string")).agg(F.count(F.lit(1)), F.count_if("__changed")).collect()
    runs = {b: list(r) for b, r in known["runs"].items()}
    for bucket, n, _ in counts:
        runs.setdefault(bucket, []).append([f"{step}/rows", n])
    if any(changed for _, _, changed in counts):
        changes = written.where("__changed").select(catalog.KEY, F.col("__old_price").alias("old_price"), F.col("price").alias("new_price"), F.timestamp_micros("__at").alias("changed_at"))
        changes.coalesce(8).write.mode("append").parquet(f"{root}/{step.partition('/')[0]}/price_changes")
    after = {**known, "runs": runs, "newest": at, "full_at": at if mode == "full" else known["full_at"], "schema": rows.schema.jsonValue()}
    heavy = [b for b, r in runs.items() if len(r) > RUNS + 1 or 2 * sum(n for _, n in r[1:]) > r[0][1]]
    if heavy:
        base = read_state(spark, root, after, heavy).withColumns({"__at": F.lit(at), "__old_price": F.lit(None).cast("double"), "__changed": F.lit(False)})
        _write(base, known["buckets"], f"{root}/{step}/base")
        for bucket, n in _written(spark, f"{root}/{step}/base", base.schema).groupBy(F.col("__bucket").cast("string")).count().collect():
            runs[bucket] = [[f"{step}/base", n]]
    return after


def sync_batch(items: DataFrame, version: int, root: str, mode: str = "full", buckets: int = BUCKETS) -> None:
    """Merge the snapshots of a batch into the state as version `version`, in the order of synced_at. A version
    that is complete stays as it is, so a batch that is replayed changes nothing; what an attempt left unfinished is written anew.

    A snapshot that is not newer than the state says what no longer holds: it is not merged, but kept beside the version,
    in `late`. The number of buckets is settled by the first version; a bucket should fit a task.
    """
    spark, here = items.sparkSession, f"version={version}"
    if files.exists(spark, f"{root}/{here}/manifest.json"):
        return
    fs, folder = files.located(spark, f"{root}/{here}")
    fs.delete(folder, True)  # an attempt without a manifest
    earlier = [v for v in state_versions(spark, root) if v < version]
    known = manifest(spark, root, earlier[-1]) if earlier else {"buckets": buckets, "runs": {}, "newest": None, "full_at": None, "schema": None}
    at = F.unix_micros(F.col("synced_at").cast("timestamp"))
    if known["newest"] is not None:
        late = items.where(at <= F.lit(known["newest"]))
        if not late.isEmpty():
            late.write.mode("overwrite").parquet(f"{root}/{here}/late")
        items = items.where(at > F.lit(known["newest"]))
    times = [r[0] for r in items.select(at.alias("at")).distinct().orderBy("at").collect()]
    for k, t in enumerate(times):
        snapshot = catalog.accept(items.where(at == F.lit(t)).drop("synced_at"), mode)
        known = _apply(spark, root, known, snapshot, t, mode, f"{here}/step={k}")
    if times:
        files.create_once(spark, f"{root}/{here}/manifest.json", json.dumps(known))


def forget(spark: SparkSession, root: str, keep: int = 10) -> list[str]:
    """Remove what only versions before the last `keep` need, late snapshots and price changes excepted; gives the folders
    that went. Not while a reader is at an older version."""
    versions = state_versions(spark, root)
    kept, old = versions[-keep:], versions[:-keep]
    needed = {f"{run[0]}/__bucket={b}" for v in kept for b, r in manifest(spark, root, v)["runs"].items() for run in r}
    gone = []
    for v in old:
        fs, where = files.located(spark, f"{root}/version={v}/manifest.json")
        fs.delete(where, False)
        for step in [n for n in files.names(spark, f"{root}/version={v}") if n.startswith("step=")]:
            for kind in files.names(spark, f"{root}/version={v}/{step}"):
                for b in files.names(spark, f"{root}/version={v}/{step}/{kind}"):
                    path = f"version={v}/{step}/{kind}/{b}"
                    if b.startswith("__bucket=") and path not in needed:
                        fs.delete(files.located(spark, f"{root}/{path}")[1], True)
                        gone.append(path)
    return gone
