"""Metrics over one table: totals, groups, time series, comparisons, concentration, histograms.

Each is one aggregation (two where an answer needs the range first), as a DataFrame; `answer` turns
a scalar into a value with its evidence. Group results are ordered with the label as tie-break.
"""

from __future__ import annotations

import time
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, FloatType

AGGREGATES = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}
GRAINS = ("day", "week", "month", "year")


def named(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def where(filters: Iterable[tuple[str, str, object]] = ()) -> Column:
    """All of (column, operator, value); operators are = <> < <= > >=."""
    ops = {"=": "__eq__", "<>": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}
    return reduce(lambda a, b: a & b, [getattr(named(c), ops[op])(F.lit(v)) for c, op, v in filters], F.lit(True))


def group_value(df: DataFrame, measure: str, agg: str = "sum") -> Column:
    """A group's aggregate as a double, 0 over no values. Sums of doubles are the same in any order of rows, so that
    equal groups stay equal: they are added as decimals where every value of the group is read back unchanged."""
    x = named(measure)
    plain = AGGREGATES[agg](x).cast("double")
    if agg == "sum" and isinstance(df.schema[measure].dataType, (DoubleType, FloatType)):
        x = x.cast("double")
        written = x.try_cast("decimal(38,18)")
        kept = F.count_if(~F.coalesce(written.cast("double") == x, x.isNull())) == 0
        plain = F.coalesce(F.when(kept, F.try_sum(written).cast("double")), plain)
    return F.coalesce(plain, F.lit(0.0))


def aggregate(df: DataFrame, measure: str, agg: str = "sum", filters: Iterable[tuple] = ()) -> DataFrame:
    """value (0 over no rows) and rows_in_scope, in one pass."""
    return df.where(where(filters)).agg(F.coalesce(AGGREGATES[agg](named(measure)), F.lit(0)).cast("double").alias("value"), F.count(F.lit(1)).alias("rows_in_scope"))


def aggregates(df: DataFrame, measure: str, filters: Iterable[tuple] = ()) -> DataFrame:
    """All aggregates of a measure in one pass."""
    return df.where(where(filters)).agg(*[f(named(measure)).cast("double").alias(k) for k, f in AGGREGATES.items()], F.count(F.lit(1)).alias("rows_in_scope"))


def per_currency(df: DataFrame, measure: str, code: str, agg: str = "sum") -> DataFrame:
    """One value for each currency code, largest first; amounts of unlike currencies never meet."""
    out = df.where(named(code).isNotNull()).groupBy(named(code).alias("currency_code")).agg(AGGREGATES[agg](named(measure)).cast("double").alias("value"))
    return out.where(F.col("value").isNotNull()).orderBy(F.desc("value"), "currency_code")


def count_rows(df: DataFrame, filters: Iterable[tuple] = ()) -> DataFrame:
    return df.where(where(filters)).agg(F.count(F.lit(1)).alias("value"))


def count_distinct(df: DataFrame, column: str, filters: Iterable[tuple] = ()) -> DataFrame:
    """The exact number of distinct values; nulls do not count."""
    return df.where(where(filters)).agg(F.count_distinct(named(column)).alias("value"))


def top_n(df: DataFrame, measure: str, dimension: str, n: int = 10, agg: str = "sum", ascending: bool = False, filters: Iterable[tuple] = ()) -> DataFrame:
    """label and value of the first n groups; null labels are a group, null values count as 0."""
    g = df.where(where(filters)).groupBy(named(dimension).alias("label")).agg(group_value(df, measure, agg).alias("value"))
    return g.orderBy(F.asc_nulls_last("value") if ascending else F.desc_nulls_last("value"), F.asc_nulls_last("label")).limit(n)


def with_share(groups: DataFrame, total: float) -> DataFrame:
    """Groups with their share of a total, in percent."""
    return groups.withColumn("share_pct", F.try_divide(F.col("value") * 100, F.lit(float(total))))


def timeseries(df: DataFrame, measure: str, time: str, grain: str = "month", agg: str = "sum", filters: Iterable[tuple] = ()) -> DataFrame:
    """period and value in order of time; rows without a time are left out, gaps stay gaps."""
    if grain not in GRAINS:
        raise ValueError(f"unknown grain {grain}")
    rows = df.where(where(filters) & named(time).isNotNull())
    return rows.groupBy(F.date_trunc(grain, named(time)).alias("period")).agg(AGGREGATES[agg](named(measure)).cast("double").alias("value")).orderBy("period")


def compare_periods(df: DataFrame, measure: str, time: str, first: tuple[str, str], second: tuple[str, str], agg: str = "sum", filters: Iterable[tuple] = ()) -> DataFrame:
    """value_1, value_2 and change_pct (null if value_1 is 0) of two date ranges, both ends included, in one pass."""
    inside = lambda p: named(time).between(F.to_date(F.lit(p[0])), F.to_date(F.lit(p[1])))
    either = df.where(where(filters) & (inside(first) | inside(second)))
    out = either.agg(*[F.coalesce(AGGREGATES[agg](F.when(inside(p), named(measure))), F.lit(0)).cast("double").alias(f"value_{i}") for i, p in ((1, first), (2, second))])
    return out.withColumn("change_pct", F.when(F.col("value_1") != 0, (F.col("value_2") - F.col("value_1")) / F.col("value_1") * 100))


def compare_months(df: DataFrame, measure: str, time: str, months: tuple[str, str] | None = None, agg: str = "sum", filters: Iterable[tuple] = ()) -> DataFrame:
    """month_1, month_2 (yyyy-MM), value_1, value_2 and change_pct (null if value_1 is 0): two named months, or the last two that have rows; no row where there are fewer."""
    series = timeseries(df, measure, time, "month", agg, filters).select(F.date_format("period", "yyyy-MM").alias("month"), "value")
    series = series.where(F.col("month").isin(*months)) if months else series.orderBy(F.desc("month")).limit(2)
    both = series.agg(F.sort_array(F.collect_list(F.struct("month", F.coalesce("value", F.lit(0.0)).alias("value")))).alias("m")).where(F.size("m") == 2)
    a, b = ((0, 1) if not months or months[0] <= months[1] else (1, 0))
    out = both.select(F.col("m")[a]["month"].alias("month_1"), F.col("m")[b]["month"].alias("month_2"), F.col("m")[a]["value"].alias("value_1"), F.col("m")[b]["value"].alias("value_2"))
    return out.withColumn("change_pct", F.when(F.col("value_1") != 0, (F.col("value_2") - F.col("value_1")) / F.col("value_1") * 100))


def date_bounds(df: DataFrame, time: str) -> DataFrame:
    return df.agg(F.min(named(time)).alias("first"), F.max(named(time)).alias("last"))


def concentration(df: DataFrame, measure: str, dimension: str, share: float = 0.8) -> DataFrame:
    """entities, entities_for_share (how many of the largest make up `share`), top_label, top_value, top_share and total.

    Groups are summed where they lie. Ranks and running sums run over one row for each entity; to
    keep these out of a single task, entities are cut at approximate quantiles, so that all ranges
    hold about as many, and only the range in which the share is reached is ranked.
    """
    g = df.groupBy(named(dimension).alias("label")).agg(group_value(df, measure).alias("value"))
    spans = 1024
    bounds = g.agg(F.max("value").alias("hi"), F.sum("value").alias("total"), F.count(F.lit(1)).alias("entities"), F.percentile_approx("value", [i / spans for i in range(1, spans)], 4 * spans).alias("cuts"))
    whole = F.when(F.col("total") == 0, 1.0).otherwise(F.col("total"))
    # the number of cuts at or above a value: equal values share a range
    placed = g.crossJoin(F.broadcast(bounds)).withColumn("cell", F.size(F.filter("cuts", lambda c: c >= F.col("value")))).select("label", "value", "hi", whole.alias("whole"), "cell")
    cells = placed.groupBy("cell").agg(F.sum("value").alias("cell_sum"), F.count(F.lit(1)).alias("cell_n"))
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("sum_before", F.coalesce(F.sum("cell_sum").over(before), F.lit(0.0))).withColumn("n_before", F.coalesce(F.sum("cell_n").over(before), F.lit(0)))
    slack = 1e-9  # sums in another order may differ in their last digits
    reach = cells.crossJoin(F.broadcast(bounds.select(whole.alias("whole")))).where((F.col("sum_before") + F.col("cell_sum")) / F.col("whole") >= share - slack).agg(F.min(F.struct("cell", "sum_before", "n_before")).alias("x")).select("x.*")
    inside = Window.partitionBy("cell").orderBy(F.desc("value"), F.asc_nulls_last("label")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = placed.join(F.broadcast(reach), "cell").withColumn("reached", (F.col("sum_before") + F.sum("value").over(inside)) / F.col("whole") >= share).withColumn("rank", F.col("n_before") + F.row_number().over(inside))
    # where rounding moves the end just behind the range, its last entity is the one
    first = at.agg(F.coalesce(F.min(F.when(F.col("reached"), F.col("rank"))), F.max("rank")).alias("entities_for_share"))
    top_label = placed.where("value = hi").agg(F.min("label").alias("top_label"))
    out = bounds.drop("cuts").crossJoin(first).crossJoin(top_label)
    return out.select("entities", F.coalesce("entities_for_share", "entities").alias("entities_for_share"), "top_label", F.col("hi").alias("top_value"), (F.col("hi") / whole).alias("top_share"), F.col("total"))


def histogram(df: DataFrame, measure: str, bins: int = 12) -> DataFrame:
    """bucket, from_value and n over equal widths; the largest value has a bucket of its own at the end."""
    x = named(measure).cast("double")
    ends = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    rows = df.where(x.isNotNull()).select(x.alias("x")).crossJoin(F.broadcast(ends))
    width = (F.col("hi") - F.col("lo")) / bins
    bucket = F.coalesce(F.floor(F.try_divide(F.col("x") - F.col("lo"), width)), F.lit(0)).cast("double")
    return rows.groupBy(bucket.alias("bucket"), "lo", width.alias("width")).agg(F.count(F.lit(1)).alias("n")).select("bucket", (F.col("lo") + F.col("bucket") * F.col("width")).alias("from_value"), "n").orderBy("bucket")


def at_or_below(df: DataFrame, stock: str, level: str, keep: Iterable[str]) -> DataFrame:
    """Rows whose stock is at or below their level, the largest shortfall first, with the gap."""
    keep = list(keep)
    out = df.where(named(stock) <= named(level)).select(*map(named, keep), (named(stock) - named(level)).alias("gap"))
    return out.orderBy(F.asc_nulls_last("gap"), *map(named, keep))


def flagged(df: DataFrame, measure: str, flag: str, k: int = 10) -> DataFrame:
    """The k largest rows of a flag column; none where there is no such column."""
    if flag not in df.columns:
        return df.limit(0)
    return df.where(named(flag)).orderBy(F.desc_nulls_last(named(measure)), *[F.asc_nulls_last(named(c)) for c in df.columns if c != measure]).limit(k)


def conditions(df: DataFrame, **tests: Column) -> DataFrame:
    """How many rows meet each condition, in one pass."""
    return df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(t).alias(k) for k, t in tests.items()])


@dataclass
class Evidence:
    """Where a number comes from."""

    query: str
    columns: list[str]
    filters: list[tuple]
    rows_in_scope: int
    rows_total: int
    seconds: float
    date_range: tuple | None = None


@dataclass
class Metric:
    name: str
    value: object
    unit: str | None = None
    evidence: Evidence | None = field(default=None)


def answer(df: DataFrame, measure: str, agg: str = "sum", filters: Iterable[tuple] = (), time_column: str | None = None, unit: str | None = None) -> Metric:
    """A scalar with its evidence: value, scope, table size and dates come from one aggregation."""
    filters, began = list(filters), time.monotonic()
    test = where(filters)
    held = F.when(test, named(measure))
    dates = [F.min(F.when(test, named(time_column))).alias("first"), F.max(F.when(test, named(time_column))).alias("last")] if time_column else []
    out = df.agg(F.coalesce(AGGREGATES[agg](held), F.lit(0)).cast("double").alias("value"), F.count_if(test).alias("scope"), F.count(F.lit(1)).alias("total"), *dates)
    row = out.first()
    conds = " AND ".join(f"`{c}` {op} {v!r}" for c, op, v in filters)
    query = f"SELECT {agg}(`{measure}`) FROM dataset" + (f" WHERE {conds}" if conds else "")
    return Metric(f"{agg} of {measure}", row["value"], unit, Evidence(query, [measure, *[c for c, _, _ in filters]], filters, row["scope"], row["total"], time.monotonic() - began, (row["first"], row["last"]) if time_column else None))
