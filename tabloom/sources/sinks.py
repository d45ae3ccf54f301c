"""Writers of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.metrics import named

MARK = "﻿"


def write_table(df: DataFrame, path: str) -> None:
    """A processed table, as Parquet."""
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files with headers that begin with a byte-order mark, so that spreadsheets read them as UTF-8."""
    first, *rest = df.columns
    df.select(named(first).alias(MARK + first), *map(named, rest)).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
