"""One run: a user file becomes a clean table, with its profile, meaning, recipe, changes and findings."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators import clean, meaning, metrics, profile
from ..sources.readers import ROW, read
from ..sources.sinks import write_table
from ..sources.sniff import FileInfo
from . import insights

STAGES = ["read", "merge_columns", "profile", "meaning", "clean", "derive", "write", "insights"]


@dataclass
class Run:
    table: DataFrame
    info: FileInfo
    profile: profile.TableProfile
    schema: meaning.Schema
    recipe: list[clean.Operation]
    changes: list[clean.Change]
    insights: list[insights.Insight]

    def artifacts(self) -> dict:
        return json.loads(json.dumps({k: asdict(v) if not isinstance(v, list) else [asdict(x) for x in v] for k, v in vars(self).items() if k != "table"}, default=str, ensure_ascii=False))


def save_run(run: Run, out: str) -> None:
    """The run's artifacts beside its table, as one JSON text."""
    spark = run.table.sparkSession
    spark.createDataFrame([(json.dumps(run.artifacts(), ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}.run")


def load_run(spark: SparkSession, out: str) -> Run:
    """A saved run: its table, and its artifacts as they were."""
    got = json.loads(spark.read.option("wholetext", True).text(f"{out}.run").first()[0])
    columns = [profile.ColumnProfile(**c | {"top_values": [tuple(x) for x in c["top_values"]], "issues": [profile.Issue(**i) for i in c["issues"]]}) for c in got["profile"]["columns"]]
    found = profile.TableProfile(got["profile"]["rows"], got["profile"]["duplicates"], columns, [profile.Issue(**i) for i in got["profile"]["issues"]])
    schema = meaning.Schema([meaning.Meaning(**c) for c in got["schema"]["columns"]], got["schema"]["domain"], meaning.Currency(**got["schema"]["currency"]))
    return Run(spark.read.parquet(out), FileInfo(**got["info"]), found, schema, [clean.Operation(**x) for x in got["recipe"]], [clean.Change(**x) for x in got["changes"]], [insights.Insight(**x) for x in got["insights"]])


def merged_columns(df: DataFrame, info: FileInfo) -> DataFrame:
    """df with columns of one meaning, which never have a value in the same row, as one; info says so in a warning."""
    first: dict[str, str] = {}
    for c in [c for c in df.columns if c != ROW]:
        m = meaning.by_name(c, "mixed")
        if m is None or m.confidence < 0.9:
            continue
        if m.concept in first and clean.exclusive(df, first[m.concept], c):
            df = clean.coalesce_columns(df, first[m.concept], c)
            info.warnings.append(f"column {c} is merged into {first[m.concept]}: both are {m.concept}, never in the same row")
        else:
            first.setdefault(m.concept, c)
    return df


def process(spark: SparkSession, path: str, out: str, overrides: dict[str, dict] | None = None, disabled: list[str] | None = None, on_progress: Callable[[str], None] = lambda stage: None, sheet: str | None = None) -> Run:
    """Read, understand, clean and write a file; `out` is the folder of the processed table."""
    on_progress("read")
    df, info = read(spark, path, sheet)
    on_progress("merge_columns")
    # a small file is a few byte ranges only; all that follows works on its rows, so they are dealt to more tasks once,
    # and to more of them where the file is large, so that no task holds more than some 32 MB of it
    df = merged_columns(df, info).repartition(max(1, min(spark.sparkContext.defaultParallelism, info.size >> 19), info.size >> 25)).cache()
    on_progress("profile")
    found = profile.profile(df, ROW)
    on_progress("meaning")
    schema = meaning.resolve(df.drop(ROW), found)
    if overrides:
        schema = meaning.overridden(schema, overrides)
    on_progress("clean")
    recipe = clean.without(clean.plan(found, [m.column for m in schema.by_role("dimension")]), disabled or [])
    changes, table = clean.logged(df, recipe, ROW)
    on_progress("derive")
    quantity, price = schema.name_of("quantity") or schema.name_of("stock_qty"), schema.name_of("unit_price")
    if not schema.by_concept("total_amount") and quantity and price:
        table = clean.derive_total(table, quantity, price)
        schema = meaning.Schema([*schema.columns, meaning.Meaning(table.columns[-1], "total_amount", "measure", 0.9, "derived", "currency")], schema.domain, schema.currency)
    on_progress("write")
    write_table(table.drop(ROW), out)
    df.unpersist()
    table = spark.read.parquet(out)
    on_progress("insights")
    run = Run(table, info, found, schema, recipe, changes, insights.generate(table, schema, found))
    save_run(run, out)
    return run


def dashboard(run: Run) -> dict:
    """Headline numbers, charts and the five most important findings."""
    return {"kpis": insights.kpis(run.table, run.schema), "charts": insights.charts(run.table, run.schema), "insights": run.insights[:5]}


def totals_by_currency(run: Run, measure: str) -> DataFrame:
    """The measure's total for each currency of the table's currency column."""
    from ..functions.currency import with_currency

    return metrics.per_currency(with_currency(run.table, metrics.named(run.schema.currency.column)), measure, "currency_code")
