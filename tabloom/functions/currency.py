"""Currencies named in texts: found by evidence, never assumed.

Spellings are a table. A text gives its tokens and pairs of tokens, and the best spelling among
these, by rank, decides; a sign ranks above all. Columns are read as a join of the grams of their
distinct labels to that table, single names by looking them up.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame, functions as F

from .text import DIACRITICS, EXTENDED_DIGITS, INDIC_DIGITS, INVISIBLE, LETTER_FORMS, TATWEEL, match_key

# The currencies that are known, their symbols and the ways in which they are written.
CURRENCIES = [
    ("SYP", "ل.س", ["ل.س", "ليرة سورية", "ليرة سوري", "سورية", "سوري", "syp"]),
    ("USD", "$", ["$", "us$", "usd", "دولار", "دولار امريكي", "دولار أمريكي", "د.أمريكي"]),
    ("EUR", "€", ["€", "eur", "يورو", "اورو"]),
    ("TRY", "ل.ت", ["₺", "try", "ليرة تركية", "ليرة تركي", "تركية"]),
    ("LBP", "ل.ل", ["ل.ل", "lbp", "ليرة لبنانية", "لبنانية"]),
    ("SAR", "ر.س", ["ر.س", "sar", "ريال سعودي", "ريال"]),
    ("AED", "د.إ", ["د.إ", "aed", "درهم اماراتي", "درهم إماراتي", "درهم"]),
    ("JOD", "د.أ", ["د.ا", "jod", "دينار اردني", "دينار أردني"]),
    ("IQD", "د.ع", ["د.ع", "iqd", "دينار عراقي"]),
    ("KWD", "د.ك", ["د.ك", "kwd", "دينار كويتي"]),
    ("EGP", "ج.م", ["ج.م", "egp", "جنيه مصري", "جنيه"]),
    ("TND", "د.ت", ["د.ت", "tnd", "دينار تونسي"]),
]
SIGNS = {"$": "USD", "€": "EUR", "₺": "TRY"}
BARE_LIRA, HOME_CURRENCY = ["ليره", "ليرة", "لبره"], "SYP"
PREFIXES = ["وبال", "فبال", "وال", "بال", "كال", "فال", "لل", "ال", "و", "ب", "ل", "ك", "ف"]


def symbol_of(code: str | None) -> str | None:
    return next((s for c, s, _ in CURRENCIES if c == code), None)


def available_currencies() -> list[dict[str, str]]:
    return [{"code": c, "symbol": s} for c, s, _ in CURRENCIES]


def plain_key(text: str) -> str:
    """The match key of a single text; small metadata only (names and distinct labels)."""
    folded = re.sub(f"{DIACRITICS}|{INVISIBLE}|{TATWEEL}", "", unicodedata.normalize("NFKC", text))
    forms = str.maketrans(LETTER_FORMS | {d: str(i) for digits in (INDIC_DIGITS, EXTENDED_DIGITS) for i, d in enumerate(digits)} | {"٫": ".", "٬": ",", "،": ","})
    return " ".join(folded.translate(forms).split()).lower()


#: A token: letters, and dots between letters. What may stand before a word is cut where three letters stay.
TOKEN = "[^\\W\\d_]+(?:[.][^\\W\\d_]+)*"
BEFORE = f"^(?:{'|'.join(PREFIXES)})(?=.{{3}})"


@cache
def spellings() -> dict[str, tuple[int, str]]:
    """Rank and code of each spelling; the longer the better, then the one listed first. A bare lira ranks below all."""
    listed = [(plain_key(a), code) for code, _, aliases in CURRENCIES for a in aliases]
    out = {plain_key(x): (0, HOME_CURRENCY) for x in BARE_LIRA}
    for i, (key, code) in enumerate(listed):
        out[key] = max(out.get(key, (0, code)), (1000 * len(key) - i, code))
    return out


def grams(key: str) -> list[str]:
    """The tokens of a key and pairs of neighbours, each as written and without what may stand before."""
    forms = [re.findall(TOKEN, key)]
    forms.append([re.sub(BEFORE, "", w) for w in forms[0]])
    return [g for words in forms for g in (*words, *map(" ".join, zip(words, words[1:])))]


def code_in(text: str | None) -> str | None:
    """The currency that one text (a column's name) names, by the best spelling found; None without clear evidence."""
    signed = [code for sign, code in SIGNS.items() if sign in (text or "")]
    found = [spellings()[g] for g in grams(plain_key(text or "")) if g in spellings()]
    return signed[0] if signed else max(found)[1] if found else None


def codes_of(labels: DataFrame) -> DataFrame:
    """label and currency_code of those labels (distinct, in column label) that name a currency: their grams joined to the table of spellings."""
    spark = labels.sparkSession
    table = spark.createDataFrame([(g, r, c) for g, (r, c) in spellings().items()], "gram string, rank int, code string")
    words = F.regexp_extract_all(match_key(F.col("label")), F.lit(f"(?U){TOKEN}"), F.lit(0))
    both = lambda ws: F.concat(ws, F.zip_with(F.slice(ws, 1, F.greatest(F.size(ws) - 1, F.lit(0))), F.slice(ws, 2, F.greatest(F.size(ws) - 1, F.lit(0))), lambda x, y: F.concat_ws(" ", x, y)))
    bare = F.transform(words, lambda w: F.regexp_replace(w, BEFORE, ""))
    spelled = labels.select("label", F.explode(F.array_distinct(F.concat(both(words), both(bare)))).alias("gram")).join(F.broadcast(table), "gram").select("label", "rank", "code")
    signed = labels.select("label", F.explode(F.array(*[F.when(F.contains("label", F.lit(sign)), F.struct(F.lit(10**6 - i).alias("rank"), F.lit(code).alias("code"))) for i, (sign, code) in enumerate(SIGNS.items())])).alias("x")).where("x IS NOT NULL").select("label", "x.*")
    return spelled.unionByName(signed).groupBy("label").agg(F.max_by("code", "rank").alias("currency_code"))


def with_currency(df: DataFrame, label: Column, name: str = "currency_code") -> DataFrame:
    """df with the currency code of a text column. Each distinct label is looked at once."""
    keyed = df.withColumn("__label", label.cast("string"))
    codes = codes_of(keyed.select(F.col("__label").alias("label")).where("label IS NOT NULL").distinct()).toDF("__known", name)
    return keyed.join(codes, F.col("__label") == F.col("__known"), "left").drop("__label", "__known")


def currency_counts(df: DataFrame, column: str) -> DataFrame:
    """currency_code and rows of a column, most frequent first; rows without evidence are left out."""
    labels = df.groupBy(F.col(f"`{column}`").cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n")).where("label IS NOT NULL")
    labels = labels.where(F.col("label").rlike("[A-Za-z$]|[^\\x00-\\x7f]"))  # without a letter or a sign there is no evidence
    found = labels.join(codes_of(labels.select("label")), "label")
    return found.groupBy("currency_code").agg(F.sum("n").alias("rows")).orderBy(F.desc("rows"), "currency_code")
