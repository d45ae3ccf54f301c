"""Text, number and date expressions for messy Arabic and English spreadsheets.

Everything here is a Column built from Spark's own functions, so it runs inside generated code;
only compatibility folding (NFKC), which Spark does not have, is a vectorised UDF, and is optional.
Results are null for null input unless a function says otherwise.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

# The digits, marks, tokens and month names that decide what is recognised.
INDIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"
EXTENDED_DIGITS = "۰۱۲۳۴۵۶۷۸۹"
DIGITS = "0123456789"
DECIMAL_MARK, THOUSANDS_MARK, ARABIC_COMMA = "٫", "٬", "،"
TATWEEL = "ـ"
DIACRITICS = "[ً-ْٰٓ-ٕ]"
INVISIBLE = "[​‌‍‎‏؜⁦⁧⁨⁩﻿]"
LETTER_FORMS = {"آ": "ا", "أ": "ا", "إ": "ا", "ٱ": "ا", "ى": "ي", "ی": "ي", "ؤ": "و", "ئ": "ي", "ة": "ه"}
RICH_LETTERS = "أإآةئؤ"
CURRENCY_TOKENS = ["ر.س", "ريال", "ر.ي", "د.إ", "درهم", "د.ك", "دينار", "ل.س", "ليرة", "ج.م", "جنيه", "SAR", "AED", "KWD", "USD", "EGP", "SYP", "$", "€", "£"]
NULL_TOKENS = ["", "-", "--", "—", "–", "...", "…", "/", "\\", "n/a", "na", "n.a.", "null", "none", "nil", "#n/a", "#null!", "nan", "لا يوجد", "غير متوفر", "غير محدد", "لايوجد", "بدون", "فارغ", "صفر "]
MONTH_NAMES = {"كانون الثاني": 1, "يناير": 1, "شباط": 2, "فبراير": 2, "اذار": 3, "مارس": 3, "نيسان": 4, "ابريل": 4, "ايار": 5, "مايو": 5, "حزيران": 6, "يونيو": 6, "تموز": 7, "يوليو": 7, "اب": 8, "اغسطس": 8, "ايلول": 9, "سبتمبر": 9, "تشرين الاول": 10, "اكتوبر": 10, "تشرين الثاني": 11, "نوفمبر": 11, "كانون الاول": 12, "ديسمبر": 12}
BOOLEAN_WORDS = ["true", "false", "نعم", "لا", "0", "1", "yes", "no", "صح", "خطأ"]

#: White space as Unicode has it; Spark's trim() knows the blank only.
SPACE = "[\\s\\u001c-\\u001f\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"


def strip(c: Column) -> Column:
    """c without white space of any kind at either end."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def squeeze(c: Column) -> Column:
    """strip(c) with each inner run of white space as one blank."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))  # only blanks are left to strip


def western_digits(c: Column) -> Column:
    """Arabic digits and separators as 0-9, point and comma."""
    return F.translate(c, INDIC_DIGITS + EXTENDED_DIGITS + DECIMAL_MARK + THOUSANDS_MARK + ARABIC_COMMA, DIGITS + DIGITS + ".,,")


def has_indic_digits(c: Column) -> Column:
    return c.rlike(f"[{INDIC_DIGITS}{EXTENDED_DIGITS}]")


def strip_diacritics(c: Column) -> Column:
    return F.regexp_replace(c, DIACRITICS, "")


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFKC")


def nfkc(c: Column) -> Column:
    """Unicode compatibility folding; ASCII texts, which it leaves as they are, do not go to Python."""
    s = c.cast("string")
    return F.coalesce(_nfkc(F.when(s.rlike("[^\\x00-\\x7f]"), s)), s)


def search_key(c: Column) -> Column:
    """The form in which texts are compared: marks dropped, letter forms unified, lower case.

    The whole key is a few passes of built-in functions; as in searches, nothing is NFKC-folded.
    """
    s = c.cast("string")
    bare = strip_diacritics(F.regexp_replace(s, INVISIBLE, ""))
    forms = "".join(LETTER_FORMS)
    full = F.translate(bare, forms + INDIC_DIGITS + EXTENDED_DIGITS + TATWEEL, "".join(LETTER_FORMS.values()) + DIGITS + DIGITS)
    # one cheap test spares ASCII texts the passes that only concern other letters, and most texts those over blanks
    whole = F.when(s.rlike("[^\\x00-\\x7f]"), squeeze(full)).when(s.rlike("[\\x00-\\x1f]|  |^ | $"), squeeze(s)).otherwise(s)
    return F.lower(whole)


def match_key(c: Column) -> Column:
    """search_key of the NFKC-folded text, with Arabic separators as point and comma: equal for names that a reader takes for the same."""
    return western_digits(search_key(nfkc(c)))


def display_form(c: Column) -> Column:
    """The text as shown: folded, without invisible characters, Western digits, single blanks."""
    return squeeze(western_digits(F.translate(F.regexp_replace(nfkc(c), INVISIBLE, ""), TATWEEL, "")))


def merge_key(c: Column, fold: bool = True) -> Column:
    """match_key without hyphens, underscores and blanks."""
    return F.regexp_replace(match_key(c) if fold else search_key(c), f"(?:[-_]|{SPACE})+", "")


def richness(c: Column) -> Column:
    """How many letters carry a mark that careless spelling drops."""
    return F.length(c) - F.length(F.translate(c, RICH_LETTERS, ""))


def is_blank(c: Column) -> Column:
    """True for null, for white space, and for the usual ways of writing that there is no value."""
    t = c.cast("string")
    return c.isNull() | F.when(F.length(t) <= 40, F.lower(strip(t)).isin(NULL_TOKENS)).otherwise(strip(t) == "")


def loses_leading_zero(c: Column) -> Column:
    """True for digits that a number would not keep, such as 007."""
    return strip(c.cast("string")).rlike("^0\\d+$")


def arabic_share(c: Column) -> Column:
    """The share of characters in the Arabic block; 0 for an empty text."""
    return F.when(F.length(c) > 0, F.length(F.regexp_replace(c, "[^؀-ۿ]", "")) / F.length(c)).otherwise(F.lit(0.0))


def parse_number(c: Column) -> Column:
    """A number as people write it: any digits, thousands separators, a currency, a percent sign,
    parentheses for a negative amount. Null for anything with other letters or inner hyphens."""
    t = c.cast("string")
    plain = t.rlike("^-?\\d{1,15}(?:[.]\\d{1,15})?$") & ~t.rlike(f"[{INDIC_DIGITS}{EXTENDED_DIGITS}]")
    # most cells are plain numbers or hold no digit at all; only the others take the long way
    return F.when(plain, t.try_cast("double")).when(t.rlike(f"[0-9{INDIC_DIGITS}{EXTENDED_DIGITS}]"), bound(western_digits(strip(t)), _marked_number))


def _marked_number(s: Column) -> Column:
    """A number from a text with marks: the amount is bare once percent signs, currencies and separators are gone."""
    negative = s.startswith("(") & s.endswith(")")
    tokens = "|".join(f"\\Q{t}\\E" for t in CURRENCY_TOKENS)
    bare = F.regexp_replace(F.when(negative, F.regexp_replace(s, "^\\(|\\)$", "")).otherwise(s), f"%|{tokens}", "")

    def read(x: Column) -> Column:
        kept = F.regexp_replace(x, "[^0-9.\\-]", "")
        return F.when(~x.rlike("\\p{L}") & kept.rlike("^-?[0-9.]+$"), kept).try_cast("double")

    n = bound(bare, read)
    return n * F.when(negative, -1).otherwise(1)


def bound(value: Column, use) -> Column:
    """use(value), with value computed once however often `use` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def parse_date(c: Column) -> Column:
    """A date written year first or day first (month first where only that is possible), or with an
    Arabic month name; years 1900 to 2200. Null where there is no such day."""
    t = c.cast("string")
    digit = f"[0-9{INDIC_DIGITS}{EXTENDED_DIGITS}]"
    likely = t.rlike(f"{digit}[-/.]{digit}{{1,2}}[-/.]{digit}") | t.rlike("[\u0621-\u064a]") & t.rlike(f"{digit}{{4}}")
    # the two usual forms are read at once; what they leave, and only that, goes the long way
    usual = F.coalesce(F.when(t.rlike("^(?:19|2[01])\\d{2}-\\d{2}-\\d{2}$"), F.try_to_date(t, "yyyy-MM-dd")), F.when(t.rlike("^\\d{2}/\\d{2}/(?:19|2[01])\\d{2}$"), F.try_to_date(t, "dd/MM/yyyy")))
    long = F.when(likely, bound(western_digits(strip(t)), lambda s: F.coalesce(_numeric_date(s), _named_date(s))))
    return F.coalesce(usual, long)


def _numeric_date(s: Column) -> Column:
    written = s.rlike("^(?:\\d{4}[-/.]\\d{1,2}[-/.]\\d{1,2}|\\d{1,2}[-/.]\\d{1,2}[-/.]\\d{4})$")
    parts = F.split(F.when(written, s), "[-/.]")

    def ordered(p: Column) -> Column:
        by_year = F.length(p[0]) == 4
        return F.struct(F.when(by_year, p[0]).otherwise(p[2]).cast("int").alias("y"), p[1].cast("int").alias("m"), F.when(by_year, p[2]).otherwise(p[0]).cast("int").alias("d"))

    def swapped(x: Column) -> Column:
        other = (x["m"] > 12) & (x["d"] <= 12)
        return F.struct(x["y"].alias("y"), F.when(other, x["d"]).otherwise(x["m"]).alias("m"), F.when(other, x["m"]).otherwise(x["d"]).alias("d"))

    return bound(bound(bound(parts, ordered), swapped), lambda x: _date(x["y"], x["m"], x["d"]))


def _named_date(s: Column) -> Column:
    months = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(v).alias("month")) for k, v in MONTH_NAMES.items()])

    def read(key: Column) -> Column:
        named = F.get(F.filter(months, lambda m: F.contains(key, m["name"])), F.lit(0))["month"]
        numbers = F.regexp_extract_all(key, F.lit("\\d+"), F.lit(0))
        enough = F.when(F.size(numbers) >= 2, numbers)
        return F.struct(F.element_at(enough, -1).try_cast("int").alias("y"), named.alias("m"), F.element_at(enough, 1).try_cast("int").alias("d"))

    key = F.when(s.rlike("[\u0621-\u064a]"), search_key(s))  # texts without Arabic letters name no month
    return bound(bound(key, read), lambda x: _date(x["y"], x["m"], x["d"]))


def _date(year: Column, month: Column, day: Column) -> Column:
    fit = year.between(1900, 2200) & month.between(1, 12) & day.between(1, 31)
    text = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
    return F.try_to_date(F.when(fit, text), "yyyy-MM-dd")


def is_hijri_like(c: Column) -> Column:
    """True when the text holds a year from 1300 to 1500."""
    years = F.regexp_extract_all(western_digits(c.cast("string")), F.lit("\\d{4}"), 0)
    return F.exists(years, lambda x: x.cast("int").between(1300, 1500))


def is_boolean_word(c: Column) -> Column:
    return F.lower(strip(c.cast("string"))).isin(BOOLEAN_WORDS)
