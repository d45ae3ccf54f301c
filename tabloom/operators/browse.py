"""Browsing a table: search over all columns, sorting, pages, export."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import search_key
from .metrics import named

PAGE_SIZE, LARGEST_PAGE = 50, 200


@dataclass
class Page:
    rows: list
    total: int
    page: int
    pages: int


def matches(df: DataFrame, needle: Column, columns: list[str] | None = None) -> Column:
    """True where any column contains the needle; texts are compared by their search keys."""
    kinds = dict(df.dtypes)
    forms = [search_key(named(c)) if kinds[c] == "string" else F.lower(named(c).cast("string")) for c in columns or df.columns]
    return reduce(lambda a, b: a | b, [F.coalesce(F.contains(f, needle), F.lit(False)) for f in forms])


def search(df: DataFrame, text: str, columns: list[str] | None = None) -> DataFrame:
    """The rows in which some column contains text; all rows for a blank text. The needle's key is
    built by the same expression as the columns' and folded into the plan as a constant."""
    return df if not text.strip() else df.where(matches(df, search_key(F.lit(text)), columns))


def ordered(df: DataFrame, column: str | None, descending: bool = False, tie_break: list[str] | None = None) -> DataFrame:
    """df by a column, nulls last either way; ties by the other columns, so that pages never overlap."""
    rest = [F.asc_nulls_last(named(c)) for c in (tie_break if tie_break is not None else [c for c in df.columns if c != column])]
    if column is None:
        return df.orderBy(*rest)
    return df.orderBy(F.desc_nulls_last(named(column)) if descending else F.asc_nulls_last(named(column)), *rest)


def page_of(df: DataFrame, page: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """One page of an ordered table."""
    size = max(1, min(size, LARGEST_PAGE))
    return df.offset((max(page, 1) - 1) * size).limit(size)


def browse(df: DataFrame, text: str = "", sort: str | None = None, descending: bool = False, page: int = 1, size: int = PAGE_SIZE, tie_break: list[str] | None = None) -> Page:
    """A page of the rows that match, and how many there are."""
    found = search(df, text)
    total = found.count()
    size = max(1, min(size, LARGEST_PAGE))
    rows = page_of(ordered(found, sort, descending, tie_break), page, size).collect()
    return Page([r.asDict() for r in rows], total, page, max(1, math.ceil(total / size)))
