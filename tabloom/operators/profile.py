"""Column profiles: types, statistics and quality issues of all columns from a few wide aggregations.

One grouping of all cells gives the distinct values of every column; over these, one pass counts how
many rows read as numbers, dates or booleans, and another finds the most frequent; types follow on
the driver. Then come the statistics of the numeric columns, the order statistics nearest to the
quartiles, and a count of outliers between the fences. The number of jobs does not depend on the
number of columns, but for samples of columns that begin with blanks. Whole columns are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import BooleanType, DateType, FractionalType, IntegralType, TimestampNTZType, TimestampType

from ..functions import text as T
from ..session import removed, stored
from .metrics import named

# The shares and counts at which a type is accepted or an issue is raised.
ACCEPT, FEW_VALUES, FEW_SHARE, MIXED_SHARE, IDENTIFIER_ROWS, CONSTANT_ROWS = 0.95, 50, 0.05, 0.3, 10, 10
SPARSE_PCT, MISSING_PCT, HIJRI_SHARE, OUTLIER_SHARE, FENCE = 80, 5, 0.3, 0.15, 1.5
TOP_VALUES, SAMPLES, HEAD_ROWS = 20, 10, 200
#: Bits that a pass of radix selection looks at, and how many values in all are sorted at once.
RADIX, FEW_LEFT = 16, 1_000_000


@dataclass
class Issue:
    kind: str
    severity: str
    column: str | None
    count: int
    pct: float


@dataclass
class ColumnProfile:
    name: str
    position: int
    type: str
    confidence: float
    total: int
    nulls: int
    unique: int
    stats: dict[str, float] = field(default_factory=dict)
    first_date: str | None = None
    last_date: str | None = None
    grain: str | None = None
    top_values: list[tuple[str, int]] = field(default_factory=list)
    average_length: float | None = None
    samples: list[str] = field(default_factory=list)
    issues: list[Issue] = field(default_factory=list)

    @property
    def null_pct(self) -> float:
        return round(self.nulls / self.total * 100, 2) if self.total else 0.0


@dataclass
class TableProfile:
    rows: int
    duplicates: int
    columns: list[ColumnProfile]
    issues: list[Issue]

    def column(self, name: str) -> ColumnProfile | None:
        return next((c for c in self.columns if c.name == name), None)


def counts(df: DataFrame, columns: list[str] | None = None, counted: DataFrame | None = None) -> DataFrame:
    """One row: for column i, counts named i_total, i_blank, i_unique, i_bool, i_number, i_whole, i_date and more.

    What a cell reads as is found once for each distinct value (of value_counts), and counted for all
    its rows. Values of all columns stand below each other, so the plan is as wide as that of one column.
    """
    names = columns or df.columns
    v, n = F.col("value"), F.col("n")
    read = (value_counts(df, names) if counted is None else counted).withColumns({"x": T.parse_number(v), "d": T.parse_date(v)})
    x, d = F.col("x"), F.col("d")
    tests = {
        "bool": T.is_boolean_word(v), "number": x.isNotNull(), "whole": x == F.floor(x), "date": d.isNotNull(), "zero_led": T.loses_leading_zero(v),
        "indic": T.has_indic_digits(v), "hijri": d.isNotNull() & T.is_hijri_like(v), "negative": x < 0, "zero": x == 0,
    }
    facts = [F.sum(n).alias("full"), F.sum("spaced").alias("spaced"), F.count(F.lit(1)).alias("unique"), *[F.sum(F.when(t, n).otherwise(0)).alias(k) for k, t in tests.items()]]
    facts += [F.min(d).alias("first"), F.max(d).alias("last"), F.round(F.sum("length") / F.sum(n), 1).alias("length")]
    by_column = read.groupBy("column").agg(*facts)
    one = by_column.agg(F.map_from_entries(F.collect_list(F.struct("column", F.struct(*by_column.columns[1:])))).alias("__facts"))
    out: list[Column] = []
    for i in range(len(names)):
        got = F.element_at("__facts", F.lit(i))
        number = lambda k, got=got: F.coalesce(got[k], F.lit(0))
        out += [(F.col("rows") - number("full")).alias(f"{i}_blank"), *[number(k).alias(f"{i}_{k}") for k in (*tests, "spaced", "unique")], *[got[k].alias(f"{i}_{k}") for k in ("first", "last", "length")]]
    return df.agg(F.count(F.lit(1)).alias("rows")).crossJoin(one).select("rows", *out)


def value_counts(df: DataFrame, columns: list[str], order: str | None = None) -> DataFrame:
    """column (its place), value and n of each distinct value that is not blank, with its first place in order, the
    number of rows that have white space around it (spaced) and the total length of all its rows.

    Values are grouped by column and value, so that each row is read once; distinct counts side by
    side in one aggregation would copy every row for every column. Cells are grouped as they are first:
    blanks and white space are looked at once for each distinct cell.
    """
    first = named(order) if order else F.lit(0)
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("column"), named(c).cast("string").alias("raw"), first.alias("at")) for i, c in enumerate(columns)])).alias("x")).select("x.*")
    raw, n = F.col("raw"), F.col("n")
    once = cells.groupBy("column", "raw").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    full = once.where(~T.is_blank(raw)).withColumn("value", T.strip(raw))
    return full.groupBy("column", "value").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.sum(F.when(raw != F.col("value"), n).otherwise(0)).alias("spaced"), F.sum(F.length("raw") * n).alias("length"))


def distinct_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """column (its place) and n, the exact number of distinct values that are not blank."""
    return value_counts(df, columns).groupBy("column").agg(F.count(F.lit(1)).alias("n"))


def top_values(counted: DataFrame, n: int = TOP_VALUES) -> DataFrame:
    """column, value and n of the most frequent values of each column of value_counts, in order; ties by first appearance, then by value."""
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "first", "value"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= n).orderBy("column", "rank").select("column", "value", "n")


def infer_type(kind, got: dict) -> tuple[str, float]:
    """The type of a column from its counts, and how sure it is."""
    n = got["rows"] - got["blank"]
    if n <= 0:
        return "empty", 1.0
    if isinstance(kind, (DateType, TimestampType, TimestampNTZType)):
        return "date", 1.0
    if isinstance(kind, BooleanType):
        return "boolean", 1.0
    if isinstance(kind, IntegralType):
        return "integer", 1.0
    if isinstance(kind, FractionalType):
        return ("integer" if got["whole"] == got["number"] else "float"), 1.0
    number, date, unique = got["number"] / n, got["date"] / n, got["unique"]
    if got["bool"] / n >= ACCEPT and unique <= 3:
        return "boolean", 1.0
    if date >= ACCEPT:
        return "date", date
    if number >= ACCEPT:
        whole = got["whole"] == got["number"]
        return ("identifier", 0.9) if whole and got["zero_led"] else ("integer" if whole else "float", number)
    if unique == n and n > IDENTIFIER_ROWS:
        return "identifier", 0.9
    if unique <= FEW_VALUES or unique / n <= FEW_SHARE:
        return "categorical", 0.85
    if max(number, date) > MIXED_SHARE:
        return "mixed", 1 - max(number, date)
    return "text", 0.8


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Doubles as unsigned integers of the same order; both zeros are one, and what is no number comes last."""
    bits = (x + 0.0).view(np.uint64)
    bits = np.where(np.isnan(x), np.uint64(0x7FF8 << 48), bits)
    return np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))


def double_of(bits: int) -> float:
    """The double of ordered bits."""
    plain = bits ^ (1 << 63) if bits >> 63 else ~bits & (1 << 64) - 1
    return float(np.array([plain], np.uint64).view(np.float64)[0])


def cell_counts(numbers: DataFrame, open_cells: list[tuple[int, int]], done: int) -> DataFrame:
    """slot, cell and n: of the numbers of a column whose first `done` ordered bits are those of an open cell
    (column, bits), how many have which RADIX bits next. A task holds one array of counts for each open cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((len(open_cells), 1 << RADIX), np.int64)
        for batch in batches:
            bits = {}
            for slot, (i, first) in enumerate(open_cells):
                if i not in bits:
                    bits[i] = ordered_bits(batch.column(i).drop_null().to_numpy().astype(np.float64))
                own = bits[i] if not done else bits[i][bits[i] >> np.uint64(64 - done) == np.uint64(first)]
                held[slot] += np.bincount((own >> np.uint64(64 - done - RADIX) & np.uint64((1 << RADIX) - 1)).astype(np.int64), minlength=1 << RADIX)
        slot, cell = np.nonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(cell, pa.int32()), pa.array(held[slot, cell])], ["slot", "cell", "n"])

    return numbers.mapInArrow(run, "slot int, cell int, n bigint").groupBy("slot", "cell").agg(F.sum("n").alias("n"))


def order_statistics(df: DataFrame, values: dict[str, Column], sizes: dict[str, int], ranks: dict[str, list[int]], few: int = FEW_LEFT) -> dict[str, list[float]]:
    """The values of the given ranks (from 0) of each column that has `sizes` values, exactly.

    Radix selection: a pass over all columns counts the numbers of each open cell by their next RADIX
    ordered bits, and the cell that holds a rank is open in the next pass. Once the open cells hold
    `few` values or less, these are sorted in one aggregation; after 64 bits, all values of a cell are
    equal, so any number of ties will do. No task holds more than its counts or `few` values.
    """
    numbers = df.select(*[x.cast("double").alias(f"v{i}") for i, x in enumerate(values.values())])
    at = {(i, r): (0, r, sizes[c]) for i, c in enumerate(values) for r in ranks[c]}  # first bits, rank in the cell, values in it
    done = 0
    while at and done < 64 and sum({(i, bits): n for (i, _), (bits, _, n) in at.items()}.values()) > few:
        open_cells = sorted({(i, bits) for (i, _), (bits, _, _) in at.items()})
        slots = {cell: slot for slot, cell in enumerate(open_cells)}
        counts = cell_counts(numbers, open_cells, done)
        upto = F.sum("n").over(Window.partitionBy("slot").orderBy("cell"))
        wanted = df.sparkSession.createDataFrame([(slots[i, bits], i, r, inner) for (i, r), (bits, inner, _) in at.items()], "slot int, i int, r long, inner long")
        found = counts.withColumn("before", upto - F.col("n")).join(F.broadcast(wanted), "slot").where("before <= inner AND inner < before + n")
        at = {(x["i"], x["r"]): (at[x["i"], x["r"]][0] << RADIX | x["cell"], x["inner"] - x["before"], x["n"]) for x in found.collect()}
        done += RADIX
    rest = 64 - done
    if done < 64 and at:
        cells = sorted({(i, bits) for (i, _), (bits, _, _) in at.items()})
        inside = lambda i, bits: F.col(f"v{i}") if not done else F.when((F.col(f"v{i}") >= double_of(bits << rest)) & (F.col(f"v{i}") <= double_of((bits + 1 << rest) - 1)), F.col(f"v{i}"))
        lists = numbers.agg(*[F.sort_array(F.collect_list(inside(i, bits))).alias(f"c{k}") for k, (i, bits) in enumerate(cells)])
        picks = {key: f"p{k}" for k, key in enumerate(at)}
        got = lists.select(*[F.get(f"c{cells.index((key[0], at[key][0]))}", F.lit(at[key][1])).alias(p) for key, p in picks.items()]).first()
        exact = {key: got[p] for key, p in picks.items()}
    else:
        exact = {key: double_of(bits) for key, (bits, _, _) in at.items()}
    return {c: [exact[i, r] for r in ranks[c]] for i, c in enumerate(values)}


def quartiles(df: DataFrame, values: dict[str, Column], sizes: dict[str, int], few: int = FEW_LEFT) -> dict[str, tuple[float, float]]:
    """The order statistics nearest to the quartiles."""
    ranks = {c: [round((sizes[c] - 1) * q) for q in (0.25, 0.75)] for c in values}
    return {c: tuple(x) for c, x in order_statistics(df, values, sizes, ranks, few).items()}


def number_column(df: DataFrame, name: str) -> Column:
    return named(name).cast("double") if _numeric(df, name) else T.parse_number(F.when(~T.is_blank(named(name)), named(name)))


def numeric_stats(df: DataFrame, sizes: dict[str, int], interpolate: bool = False, few: int = FEW_LEFT) -> DataFrame:
    """One row of min, max, mean, median, std, p25 and p75 for each column of `sizes` (its number of values, at least one).

    Quartiles are the nearest order statistics, or with interpolate the linear ones; the median is always linear.
    """
    if not sizes:
        return df.sparkSession.range(1)
    values = {c: number_column(df, c) for c in sizes}
    at = {c: [(n - 1) * 0.5, *[(n - 1) * q if interpolate else float(round((n - 1) * q)) for q in (0.25, 0.75)]] for c, n in sizes.items()}
    found = order_statistics(df, values, sizes, {c: [r for x in at[c] for r in (int(x), min(int(x) + 1, sizes[c] - 1))] for c in sizes}, few)
    plain, ranked = [], {}
    df, values = df.select(*[x.alias(f"v{i}") for i, x in enumerate(values.values())]), {c: F.col(f"v{i}") for i, c in enumerate(values)}
    for i, (c, x) in enumerate(values.items()):
        plain += [F.min(x).alias(f"{i}_min"), F.max(x).alias(f"{i}_max"), F.avg(x).alias(f"{i}_mean"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias(f"{i}_std")]
        pairs = zip(at[c], found[c][::2], found[c][1::2], strict=True)
        ranked |= dict(zip((f"{i}_median", f"{i}_p25", f"{i}_p75"), (F.lit(lo + (hi - lo) * (p - int(p))) for p, lo, hi in pairs), strict=True))
    order = [f"{i}_{k}" for i in range(len(values)) for k in ("min", "max", "mean", "median", "std", "p25", "p75")]
    return df.agg(*plain).withColumns(ranked).select(*order)


def _numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (IntegralType, FractionalType))


def value_frequency(df: DataFrame, column: str, n: int = TOP_VALUES, order: str | None = None) -> DataFrame:
    """The n most frequent values; ties by first appearance where an order column is given, else by value."""
    c = named(column).cast("string")
    g = df.where(~T.is_blank(c)).groupBy(T.strip(c).alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min(named(order) if order else F.lit(0)).alias("first"))
    return g.orderBy(F.desc("n"), "first", "value").limit(n).select("value", "n")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """rows, distinct_rows and duplicates; rows are compared as a whole, null equal to null."""
    groups = df.groupBy(*map(named, df.columns)).agg(F.count(F.lit(1)).alias("__n"))
    return groups.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("distinct_rows")).withColumn("duplicates", F.col("rows") - F.col("distinct_rows"))


def profile(df: DataFrame, order: str | None = None) -> TableProfile:
    """The profile of a table; `order` names a column that numbers its rows, and is left out."""
    names = [c for c in df.columns if c != order]
    counted = value_counts(df, names, order).persist()
    base = counts(df, names, counted).first().asDict()
    cols = []
    for i, name in enumerate(names):
        got = {k.split("_", 1)[1]: v for k, v in base.items() if k.startswith(f"{i}_")} | {"rows": base["rows"]}
        kind, sure = infer_type(df.schema[name].dataType, got)
        p = ColumnProfile(name, i, kind, round(sure, 3), got["rows"], got["blank"], got["unique"], average_length=got["length"])
        if kind == "date" and got["first"]:
            p.first_date, p.last_date = str(got["first"]), str(got["last"])
            span = (got["last"].year - got["first"].year) * 365 + (got["last"].month - got["first"].month) * 30
            p.grain = "day" if span < 90 else "month" if span < 1100 else "year"
        cols.append((p, got))
    numeric = {p.name: got["number"] for p, got in cols if p.type in ("integer", "float") and got["number"]}
    numbers, path = stored(df.select(*[number_column(df, c).alias(c) for c in numeric]), "numbers") if numeric else (df, "")  # read as numbers once, for all passes
    if numeric:
        stats = numeric_stats(numbers, numeric).first().asDict()
        for i, name in enumerate(numeric):
            own = next(p for p, _ in cols if p.name == name)
            own.stats = {k.split("_", 1)[1]: v for k, v in stats.items() if k.startswith(f"{i}_")} | {"zeros": next(g for p, g in cols if p is own)["zero"], "negatives": next(g for p, g in cols if p is own)["negative"]}
    fences = {n: fence(p.stats["p25"], p.stats["p75"]) for p, _ in cols if (n := p.name) in numeric and p.stats["p75"] > p.stats["p25"]}
    beyond = numbers.agg(*[F.count_if(_outside(numbers, n, lo, hi)).alias(f"o{i}") for i, (n, (lo, hi)) in enumerate(fences.items())]).first() if fences else []
    if numeric:
        removed(df.sparkSession, path)
    tops: dict[int, list] = {}
    listed = [p.position for p, _ in cols if p.type in ("categorical", "text", "identifier", "boolean")]
    for at, value, n in top_values(counted.where(F.col("column").isin(listed))).collect() if listed else []:
        tops.setdefault(at, []).append((value, n))
    counted.unpersist()
    head = df.select(*[F.when(~T.is_blank(named(c)), named(c).cast("string")).alias(str(i)) for i, c in enumerate(names)]).limit(HEAD_ROWS).collect()
    for p, got in cols:
        p.top_values = tops.get(p.position, [])
        p.samples = [r[p.position] for r in head if r[p.position] is not None][:SAMPLES]
        if len(p.samples) < min(SAMPLES, p.total - p.nulls):  # a column that begins with blanks
            p.samples = [r[0] for r in df.where(~T.is_blank(named(p.name))).select(named(p.name).cast("string")).limit(SAMPLES).collect()]
        p.issues = issues(p, got, dict(zip(fences, beyond)).get(p.name, 0))
    # where each row has a value of its own in some column, no two rows are equal
    keyed = any(p.unique == base["rows"] for p, _ in cols)
    doubled = 0 if keyed else duplicate_rows(df.select(*map(named, names))).first()["duplicates"]
    whole = [Issue("duplicate_rows", "warning", None, doubled, round(doubled / base["rows"] * 100, 2))] if doubled else []
    return TableProfile(base["rows"], doubled, [p for p, _ in cols], whole)


def fence(p25: float, p75: float) -> tuple[float, float]:
    return p25 - FENCE * (p75 - p25), p75 + FENCE * (p75 - p25)


def _outside(df: DataFrame, name: str, lo: float, hi: float) -> Column:
    x = named(name).cast("double") if _numeric(df, name) else T.parse_number(named(name))
    return F.coalesce((x < lo) | (x > hi), F.lit(False))


def issues(p: ColumnProfile, got: dict, outliers: int) -> list[Issue]:
    """What is wrong with a column, in a fixed order."""
    total, full = max(p.total, 1), p.total - p.nulls
    pct = lambda n: round(n / total * 100, 2)
    rules = [
        (p.null_pct > SPARSE_PCT, "sparse_column", "warning", p.nulls),
        (SPARSE_PCT >= p.null_pct > MISSING_PCT, "missing_values", "warning", p.nulls),
        (p.unique == 1 and p.total > CONSTANT_ROWS, "constant_column", "info", p.total),
        (got["spaced"] > 0, "whitespace", "info", got["spaced"]),
        (got["indic"] > 0, "arabic_indic_digits", "warning", got["indic"]),
        (p.type == "date" and got["hijri"] > full * HIJRI_SHARE, "mixed_types", "warning", got["hijri"]),
        (p.type == "mixed", "mixed_types", "warning", p.total),
        (p.type in ("integer", "float") and got["negative"] > 0, "negative_values", "info", got["negative"]),
        (0 < outliers < total * OUTLIER_SHARE, "outliers", "info", outliers),
    ]
    return [Issue(kind, severity, p.name, n, pct(n)) for is_so, kind, severity, n in rules if is_so]
