"""Formatting of single numbers for reports."""

from __future__ import annotations


def number_text(n: float | None, decimals: int | None = None) -> str:
    """Thousands separators; two decimals where there is a fraction."""
    if n is None:
        return "—"
    return f"{n:,.{(0 if float(n).is_integer() else 2) if decimals is None else decimals}f}"


def compact_text(n: float | None) -> str:
    """Thousands and millions by name."""
    if n is None:
        return "—"
    for size, word in ((1_000_000, "مليون"), (1_000, "ألف")):
        if abs(n) >= size:
            return f"{n / size:,.1f} {word}"
    return number_text(n)


def currency_text(n: float | None, symbol: str | None = None) -> str:
    """An amount with two decimals; no symbol unless one is known."""
    return "—" if n is None else f"{number_text(n, 2)} {symbol}" if symbol else number_text(n, 2)


def percent_text(n: float | None, decimals: int = 1) -> str:
    return "—" if n is None else f"{n:,.{decimals}f}%"


def counted(n: int, one: str, two: str, few: str) -> str:
    """A noun in the form that Arabic gives it after n."""
    if n in (1, 2):
        return one if n == 1 else two
    return f"{number_text(int(n))} {few if 3 <= n <= 10 else one}"


# Month names for labels.
MONTHS = ["كانون الثاني", "شباط", "آذار", "نيسان", "أيار", "حزيران", "تموز", "آب", "أيلول", "تشرين الأول", "تشرين الثاني", "كانون الأول"]


def period_text(period, grain: str = "month") -> str:
    """A period as an axis shows it: the day, the day that a week begins with, month and year, or the year."""
    day = str(period)[:10]
    return {"month": f"{MONTHS[int(day[5:7]) - 1]} {day[:4]}", "year": day[:4]}.get(grain, day)
