"""Cleaning by a declarative recipe: a list of operations that a profile calls for, each a lazy
DataFrame step that can be switched off. Rows are never deleted for being unusual, only flagged.

What operations on cells changed is counted with old and new values side by side, one aggregation
for all of them, when the log is asked for. Examples name rows by an order column, where there is one.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from ..session import scratch
from .metrics import named
from .profile import TableProfile, fence, quartiles

# The prefix of flag columns, and the bounds within which operations apply.
FLAG_PREFIX = "_شاذ_"
LEAST_NUMBERS, MOST_NAMES, EXAMPLES = 10, 200, 5


@dataclass
class Operation:
    kind: str
    columns: list[str]
    reason: str
    enabled: bool = True

    @property
    def key(self) -> str:
        return f"{self.kind}:{','.join(sorted(self.columns))}"


@dataclass
class Change:
    kind: str
    columns: list[str]
    cells: int = 0
    rows: int = 0
    failed: int = 0
    examples: list[dict] = field(default_factory=list)


def plan(profile: TableProfile, dimensions: list[str]) -> list[Operation]:
    """The operations that the profile gives a reason for, in the order in which they run."""
    of = lambda *types: [c.name for c in profile.columns if c.type in types]
    having = lambda kind: [c.name for c in profile.columns if any(i.kind == kind for i in c.issues)]
    named_cols = [c.name for c in profile.columns if c.name in dimensions and c.type in ("categorical", "text") and 1 < c.unique <= MOST_NAMES]
    wanted = [
        ("trim_whitespace", having("whitespace"), "white space around values"),
        ("normalize_arabic", of("text", "categorical", "identifier"), "one form for the same letters"),
        ("normalize_digits", having("arabic_indic_digits"), "Western digits"),
        ("parse_numbers", of("integer", "float"), "numbers written as text"),
        ("parse_dates", of("date", "datetime"), "dates in several forms"),
    ]
    ops = [Operation(k, cols, why) for k, cols, why in wanted if cols]
    if profile.duplicates:
        ops.append(Operation("deduplicate_rows", [], "rows that occur twice"))
    ops += [Operation("fuzzy_entity_merge", [c], "spellings of the same name") for c in named_cols]
    if out := having("outliers"):
        ops.append(Operation("flag_outliers", out, "values far outside the quartiles"))
    return ops


def without(ops: list[Operation], disabled: list[str]) -> list[Operation]:
    """The recipe with the operations of these keys switched off."""
    return [Operation(o.kind, o.columns, o.reason, o.enabled and o.key not in set(disabled)) for o in ops]


def cell_forms(df: DataFrame, op: Operation) -> dict[str, Column]:
    """What an operation on cells makes of each of its columns; empty for other operations."""
    kinds = dict(df.dtypes)
    text = lambda fn: lambda c: fn(named(c).cast("string"))
    forms = {
        "trim_whitespace": text(T.strip), "normalize_arabic": text(T.display_form), "normalize_digits": text(T.western_digits),
        "parse_numbers": lambda c: T.parse_number(named(c)) if kinds[c] == "string" else named(c).cast("double"),
        "parse_dates": lambda c: named(c).cast("date") if kinds[c].startswith(("date", "timestamp")) else T.parse_date(named(c)),  # dates are cast, not read again
    }
    return {c: forms[op.kind](c) for c in op.columns if c in kinds} if op.kind in forms else {}


def deduplicate(df: DataFrame, order: str | None = None) -> DataFrame:
    """One row of each set of equal rows; with an order column the first, which the column then shows."""
    if order is None:
        return df.dropDuplicates()
    rest = [c for c in df.columns if c != order]
    return df.groupBy(*map(named, rest)).agg(F.min(named(order)).alias(order)).select(*map(named, df.columns))


def canonical_names(df: DataFrame, columns: list[str], fold: bool = True) -> DataFrame:
    """column, value, canonical and n (rows) of every spelling that is not its group's best one.

    Spellings of a column with one merge key are a group; the one with the most marked letters wins,
    then the most frequent, then the first in order. One grouping serves all columns.
    """
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), named(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*")
    values = cells.where(F.length("value") > 0).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    keyed = values.withColumn("key", T.merge_key(F.col("value"), fold))
    best = keyed.groupBy("column", "key").agg(F.max_by("value", F.struct(T.richness(F.col("value")), "n", F.xxhash64("value"))).alias("canonical"), F.count(F.lit(1)).alias("forms")).where("forms > 1")
    return keyed.join(best, ["column", "key"]).where("value <> canonical").select("column", "value", "canonical", "n")


def merge_entities(df: DataFrame, columns: list[str], fold: bool = True, names: DataFrame | None = None) -> DataFrame:
    """Each name in its best spelling; names as canonical_names gives them."""
    held = [c for c in columns if c in df.columns]
    names = canonical_names(df, held, fold) if names is None and held else names
    for c in held:
        own = names.where(F.col("column") == c).select(F.col("value").alias("__value"), F.col("canonical").alias("__canonical"))
        df = df.join(own, named(c).cast("string") == F.col("__value"), "left").withColumn(c, F.coalesce("__canonical", named(c))).drop("__value", "__canonical")
    return df


def flag_outliers(df: DataFrame, columns: list[str]) -> DataFrame:
    """A boolean column for each numeric column with at least LEAST_NUMBERS values and spread quartiles: true beyond the fences."""
    kinds = dict(df.dtypes)
    held = [c for c in columns if c in kinds]
    x = {c: T.parse_number(named(c)) if kinds[c] == "string" else named(c).cast("double") for c in held}
    if not held:
        return df
    got = df.agg(*[F.count(x[c]).alias(str(i)) for i, c in enumerate(held)]).first()
    sizes = {c: got[i] for i, c in enumerate(held)}
    wide = {c: x[c] for c in held if sizes[c] >= LEAST_NUMBERS}
    found = quartiles(df, wide, {c: sizes[c] for c in wide}) if wide else {}
    out = {}
    for c, (q1, q3) in found.items():
        if q3 > q1:
            lo, hi = fence(q1, q3)
            out[FLAG_PREFIX + c] = F.coalesce((x[c] < lo) | (x[c] > hi), F.lit(False))
    return df.withColumns(out) if out else df


def flag_columns(columns: list[str]) -> dict[str, str]:
    """The flag column of each column that has one."""
    return {c[len(FLAG_PREFIX) :]: c for c in columns if c.startswith(FLAG_PREFIX) and c[len(FLAG_PREFIX) :] in columns}


def apply(df: DataFrame, op: Operation, order: str | None = None) -> DataFrame:
    """df after one operation."""
    if not op.enabled:
        return df
    if forms := cell_forms(df, op):
        return df.withColumns(forms)
    steps = {"deduplicate_rows": lambda: deduplicate(df, order), "fuzzy_entity_merge": lambda: merge_entities(df, op.columns), "flag_outliers": lambda: flag_outliers(df, op.columns)}
    return steps[op.kind]() if op.kind in steps else df


def run(df: DataFrame, ops: list[Operation], order: str | None = None) -> DataFrame:
    """df after the whole recipe."""
    for op in ops:
        df = apply(df, op, order)
    return df


def cell_changes(df: DataFrame, ops: list[Operation], order: str) -> list[Change]:
    """What operations on cells change, one after the other: old and new values stand side by side in one
    row, so one pass counts for all of them, and another finds the examples."""
    now, cells, out = df, [], []
    for i, op in enumerate(ops):
        out.append(Change(op.kind, op.columns))
        forms = cell_forms(now, op)
        olds = {f"__{i}_{j}": named(c).cast("string") for j, c in enumerate(forms)}
        now = now.withColumns(olds).withColumns(forms)
        for j, (c, form) in enumerate(forms.items()):
            before, after = F.col(f"__{i}_{j}"), named(c).cast("string")
            now = now.withColumn(f"__{i}_{j}_new", after)
            plain = before.try_cast("double").isNotNull() if op.kind == "parse_numbers" else F.lit(False)
            fresh = F.col(f"__{i}_{j}_new")
            lost = fresh.isNull() & (F.length(T.strip(before)) > 0)
            cells.append((i, c, before, fresh, ~before.eqNullSafe(fresh) & fresh.isNotNull() & ~plain, F.coalesce(lost, F.lit(False))))
    if not cells:
        return out
    got = now.agg(*[F.count_if(x[k]).alias(f"{n}_{k}") for n, x in enumerate(cells) for k in (4, 5)]).first()
    for n, x in enumerate(cells):
        out[x[0]].cells += got[f"{n}_4"]
        out[x[0]].failed += got[f"{n}_5"]
    marked = F.array(*[F.when(differs | lost, F.struct(F.lit(i).alias("op"), named(order).alias("row"), F.lit(c).alias("column"), before.alias("before"), fresh.alias("after"))) for i, c, before, fresh, differs, lost in cells])
    rows = now.select(F.explode(F.array_compact(marked)).alias("x")).select("x.*")
    first = rows.withColumn("place", F.row_number().over(Window.partitionBy("op").orderBy("row", "column"))).where(F.col("place") <= EXAMPLES)
    for r in first.orderBy("op", "place").collect():
        out[r["op"]].examples.append({k: r[k] for k in ("row", "column", "before", "after")})
    return out


def log(df: DataFrame, ops: list[Operation], order: str | None = None) -> list[Change]:
    """What each operation changes; with an order column, up to EXAMPLES changed cells too."""
    return logged(df, ops, order)[0]


def logged(df: DataFrame, ops: list[Operation], order: str | None = None) -> tuple[list[Change], DataFrame]:
    """The log, and df after the whole recipe, so that what the log found out is not looked for again."""
    out: list[Change] = []
    todo = [o for o in ops if o.enabled]
    while todo:
        few = [o for o in todo[: next((i for i, o in enumerate(todo) if not cell_forms(df, o)), len(todo))]]
        if few:
            out += cell_changes(df, few, order) if order is not None else [Change(o.kind, o.columns) for o in few]
            df, todo = run(df, few, order), todo[len(few) :]
            continue
        op, todo = todo[0], todo[1:]
        held = [c for c in op.columns if c in df.columns]
        names = written_once(canonical_names(df, held)) if op.kind == "fuzzy_entity_merge" and held else None
        after, change = merge_entities(df, held, names=names) if names is not None else apply(df, op, order), Change(op.kind, op.columns)
        if op.kind == "deduplicate_rows":
            change.rows = df.count() - after.count()
        elif op.kind == "flag_outliers":
            flags = [FLAG_PREFIX + c for c in op.columns if FLAG_PREFIX + c in after.columns]
            change.rows = sum(after.agg(*[F.count_if(named(f)).alias(f) for f in flags]).first()) if flags else 0
        elif names is not None:
            change.cells = names.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
            change.examples = [r.asDict() for r in names.orderBy(F.desc("n"), "column", "value").limit(EXAMPLES).select("column", F.col("value").alias("before"), F.col("canonical").alias("after")).collect()]
        out.append(change)
        df = after
    return out, df


def written_once(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again: several jobs use what one has found."""
    path = scratch(df.sparkSession, "names")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def derive_total(df: DataFrame, quantity: str, price: str, name: str = "total") -> DataFrame:
    """df with quantity times price, under a name that is not taken."""
    while name in df.columns:
        name += "_1"
    number = lambda c: named(c).try_cast("double")
    return df.withColumn(name, number(quantity) * number(price))


def exclusive(df: DataFrame, first: str, second: str) -> bool:
    """True when no row has a value in both columns."""
    return df.where(named(first).isNotNull() & named(second).isNotNull()).isEmpty()


def coalesce_columns(df: DataFrame, first: str, second: str) -> DataFrame:
    """Two columns of one meaning as one; as text where their types differ."""
    kinds = dict(df.dtypes)
    kind = kinds[first] if kinds[first] == kinds[second] else "string"
    return df.withColumn(first, F.coalesce(named(first).cast(kind), named(second).cast(kind))).drop(named(second))


def numbered(df: DataFrame, name: str = "__row") -> DataFrame:
    """df with row numbers from 1 in the order in which it is read.

    Numbers are the rank of Spark's partition-wise ids: partitions are counted once and their
    offsets added, so no sort and no single task is needed.
    """
    held = df.withColumn("__id", F.monotonically_increasing_id())
    part = F.shiftright("__id", 33)
    sizes = held.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return held.withColumn("__part", part).join(F.broadcast(offsets), "__part").withColumn(name, F.col("before") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__id", "__part", "before")
