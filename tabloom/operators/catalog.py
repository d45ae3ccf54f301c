"""Catalog merges: snapshots of items with prices, merged into a state that remembers.

The state has the snapshot's columns and active, first_seen_at, last_seen_at, price_changed_at. A
full snapshot deactivates items that are missing from it, a delta leaves them. Nothing is deleted.
How state is stored by version is in `streaming.state`.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructType

from .metrics import named

# The key, the numeric fields and the columns that only the merge writes.
KEY = "item_id"
NUMERIC = ["price", "qty"]
TRACKING = ["active", "first_seen_at", "last_seen_at", "price_changed_at"]


class CatalogError(ValueError):
    """A snapshot that must not be accepted, not even in part."""


@dataclass
class Merge:
    state: DataFrame
    price_changes: DataFrame
    stats: DataFrame


def as_text(c: Column, kind) -> Column:
    """A field as text: lists joined, objects as JSON with sorted keys."""
    if isinstance(kind, ArrayType):
        return F.nullif(F.array_join(F.transform(F.array_compact(c), lambda x: x.cast("string")), " | "), F.lit(""))
    if isinstance(kind, StructType):
        return F.when(c.isNotNull(), F.to_json(F.struct(*[c[f.name].alias(f.name) for f in sorted(kind, key=lambda f: f.name)])))
    if isinstance(kind, MapType):
        return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c))))
    return c if isinstance(kind, StringType) else c.cast("string")


def normalized_items(items: DataFrame) -> DataFrame:
    """Items with texts as text and numeric fields as double, the key first; tracking columns of the sender are dropped."""
    kinds = {f.name: f.dataType for f in items.schema}
    cols = sorted(c for c in items.columns if c not in (KEY, *TRACKING))
    value = lambda c: F.nullif(F.trim(named(c).cast("string")), F.lit("")).try_cast("double") if c in NUMERIC else as_text(named(c), kinds[c])
    return items.select(F.trim(as_text(named(KEY), kinds[KEY])).alias(KEY), *[value(c).alias(c) for c in cols])


@dataclass
class Payload:
    """What a sender says of a snapshot, and its items."""

    items: DataFrame
    mode: str
    declared: int | None
    synced_at: datetime | None
    warehouse: str | None


def payload(spark: SparkSession, path: str) -> Payload:
    """A catalog file: a list of objects, or an object with `items` (else its only list of objects) and what the
    sender declares: mode (full if absent), count, generated_at (UTC where it names no zone). A byte-order mark is skipped."""
    raw = spark.read.option("multiLine", True).option("primitivesAsString", True).option("encoding", "UTF-8").json(path)
    if "_corrupt_record" in raw.columns:
        raise CatalogError("the catalog is broken JSON")
    kinds = {f.name: f.dataType for f in raw.schema}
    lists = [c for c, k in kinds.items() if isinstance(k, ArrayType) and isinstance(k.elementType, StructType)]
    if not lists and KEY in kinds:
        return Payload(raw, "full", None, None, None)
    chosen = "items" if "items" in lists else lists[0] if len(lists) == 1 else None
    if chosen is None:
        raise CatalogError(f"one list of items is needed, not {len(lists)}")
    at = F.to_timestamp(F.col("generated_at")) if "generated_at" in kinds else F.lit(None).cast("timestamp")
    text = lambda c: named(c) if c in kinds else F.lit(None).cast("string")
    said = raw.select(F.coalesce(F.lower(text("mode")), F.lit("full")), text("count").try_cast("int"), at, text("warehouse_id")).first()
    return Payload(raw.select(F.explode(named(chosen)).alias("x")).select("x.*"), *said)


def problems(items: DataFrame) -> DataFrame:
    """One row that counts what makes a snapshot unacceptable: rows, keys without a value, repeated keys, numbers that are none."""
    key = F.trim(named(KEY).cast("string"))
    bad = [(F.count_if((F.length(F.trim(named(c).cast("string"))) > 0) & (F.coalesce(named(c).cast("string").try_cast("double"), F.lit(float("nan"))).isin(float("nan"), float("inf"), float("-inf"))))).alias(f"bad_{c}") for c in NUMERIC if c in items.columns]
    filled = F.when(F.length(key) > 0, key)
    return items.agg(F.count(F.lit(1)).alias("rows"), F.count_if(filled.isNull()).alias("without_key"), (F.count(filled) - F.count_distinct(filled)).alias("repeated"), *bad)


def accept(items: DataFrame, mode: str = "full", declared: int | None = None) -> DataFrame:
    """The normalised items of a snapshot that is whole and unambiguous; raises CatalogError otherwise."""
    if mode not in ("full", "delta"):
        raise CatalogError(f"mode must be full or delta, not {mode!r}")
    if KEY not in items.columns:
        raise CatalogError(f"items have no {KEY}")
    got = problems(items).first().asDict()
    if not got["rows"]:
        raise CatalogError("the catalog is empty")
    if declared is not None and declared != got["rows"]:
        raise CatalogError(f"{declared} items were declared, {got['rows']} came")
    for what in ("without_key", "repeated", *[k for k in got if k.startswith("bad_")]):
        if got[what]:
            raise CatalogError(f"{what}: {got[what]}")
    return normalized_items(items)


def merge(previous: DataFrame | None, items: DataFrame, synced_at: Column, mode: str = "full") -> Merge:
    """The next state, the price changes and one row of statistics.

    One left join of the snapshot to the slim previous state, one anti join of the previous state
    to the snapshot's keys, and a union by name, so that columns may come and go over time.
    """
    now = synced_at.cast("timestamp")
    if previous is None:
        state = items.withColumns({"active": F.lit(True), "first_seen_at": now, "last_seen_at": now, "price_changed_at": F.lit(None).cast("timestamp")})
        changes = items.where(F.lit(False)).select(KEY, F.lit(None).cast("double").alias("old_price"), F.lit(None).cast("double").alias("new_price"), now.alias("changed_at"))
        return Merge(state, changes, items.agg(F.count(F.lit(1)).alias("received"), F.count(F.lit(1)).alias("added"), F.lit(0).cast("long").alias("price_changed"), F.lit(0).cast("long").alias("reactivated"), F.lit(0).cast("long").alias("removed"), F.count(F.lit(1)).alias("active_total")))
    priced = "price" in items.columns and "price" in previous.columns
    slim = previous.select(KEY, *[F.col(c).alias(f"prev_{c}") for c in ("active", "first_seen_at", "price_changed_at", *(["price"] if priced else []))])
    joined = items.join(slim, KEY, "left")
    is_new = F.col("prev_first_seen_at").isNull()
    changed = ~is_new & ~F.col("price").eqNullSafe(F.col("prev_price")) if priced else F.lit(False)
    joined = joined.withColumns({"is_new": is_new, "is_changed": changed})
    old_price, new_price = (F.col("prev_price"), F.col("price")) if priced else (F.lit(None).cast("double"),) * 2
    changes = joined.where("is_changed").select(KEY, old_price.alias("old_price"), new_price.alias("new_price"), now.alias("changed_at"))
    current = joined.select(*map(named, items.columns), F.lit(True).alias("active"), F.coalesce("prev_first_seen_at", now).alias("first_seen_at"), now.alias("last_seen_at"), F.when(F.col("is_changed"), now).otherwise(F.col("prev_price_changed_at")).alias("price_changed_at"))
    absent = previous.join(items.select(KEY), KEY, "left_anti")
    gone = F.count_if("active") if mode == "full" else F.lit(0).cast("long")
    lost = absent.agg(gone.alias("removed"), F.count_if(F.col("active") if mode == "delta" else F.lit(False)).alias("still"))
    if mode == "full":
        absent = absent.withColumn("active", F.lit(False))
    came = joined.agg(F.count(F.lit(1)).alias("received"), F.count_if("is_new").alias("added"), F.count_if("is_changed").alias("price_changed"), F.count_if(~F.col("is_new") & ~F.coalesce("prev_active", F.lit(True))).alias("reactivated"))
    stats = came.crossJoin(lost).select("received", "added", "price_changed", "reactivated", "removed", (F.col("received") + F.col("still")).alias("active_total"))
    return Merge(current.unionByName(absent, allowMissingColumns=True), changes, stats)


def changed_rows(previous: DataFrame | None, items: DataFrame, synced_at: Column, mode: str = "full") -> DataFrame:
    """The rows of the next state that a snapshot changes, with __changed (the price is another) and __old_price.

    By one join. Left out are items of a full snapshot that are as they were: all that is new of them is last_seen_at,
    which is the snapshot's time for every active item.
    """
    now = synced_at.cast("timestamp")
    none = F.lit(None).cast("double")
    if previous is None:
        return items.withColumns({"active": F.lit(True), "first_seen_at": now, "last_seen_at": now, "price_changed_at": F.lit(None).cast("timestamp"), "__old_price": none, "__changed": F.lit(False)})
    kinds = {f.name: f.dataType for df in (previous, items) for f in df.schema if f.name not in (KEY, *TRACKING)}
    pack = lambda df, name: df.select(KEY, F.struct(F.lit(True).alias("__there"), *[named(c) for c in df.columns if c != KEY]).alias(name))
    joined = pack(items, "__new").join(pack(previous, "__old"), KEY, "full" if mode == "full" else "left")
    came, known, old = F.col("__new").isNotNull(), F.col("__old").isNotNull(), F.col("__old")
    of = lambda df, name, c: F.col(name)[c] if c in df.columns else F.lit(None).cast(kinds[c])
    differs = F.lit(mode == "delta")
    for c in kinds:
        differs = differs | ~of(items, "__new", c).eqNullSafe(of(previous, "__old", c))
    priced = "price" in items.columns and "price" in previous.columns
    changed = came & known & ~F.col("__new")["price"].eqNullSafe(old["price"]) if priced else F.lit(False)
    kept = joined.where(F.when(came, ~known | ~old["active"] | differs).otherwise(old["active"]))
    values = [F.when(came, of(items, "__new", c)).otherwise(of(previous, "__old", c)).alias(c) for c in sorted(kinds)]
    seen = [came.alias("active"), F.coalesce(old["first_seen_at"], now).alias("first_seen_at"), F.when(came, now).otherwise(old["last_seen_at"]).alias("last_seen_at")]
    return kept.select(KEY, *values, *seen, F.when(changed, now).otherwise(old["price_changed_at"]).alias("price_changed_at"), (old["price"] if priced else none).alias("__old_price"), changed.alias("__changed"))


def stale_sources(events: DataFrame, source: str, time: str, now: Column, hours: int = 26) -> DataFrame:
    """Sources whose last event is over `hours` before now, with that event's time."""
    last = events.groupBy(named(source).alias("source")).agg(F.max(named(time)).alias("last_seen"))
    return last.where(F.col("last_seen") < now - F.expr(f"INTERVAL {int(hours)} HOURS"))
