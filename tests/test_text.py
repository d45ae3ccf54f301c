import pytest
from pyspark.sql import functions as F

from tabloom.functions import currency, labels, text as T


def values(spark, fn, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, s string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("s"))).collect()]


def test_parse_number(spark):
    given = ["1,250.00 ر.س", "١٢", "(500)", "12%", "INV-1151", "1-2-3", "—", "N/A", "", None, "٣٫٥", "-7", ".5", "1.2.3", "$ 10", "-"]
    assert values(spark, T.parse_number, given) == [1250.0, 12.0, -500.0, 12.0, None, None, None, None, None, None, 3.5, -7.0, 0.5, None, 10.0, None]


def test_parse_date(spark):
    given = ["2026-01-24", "24/01/2026", "01/24/2026", "٢٤/٠١/٢٠٢٦", "15 كانون الثاني 2026", "2026-08", "31-02-2026", "1.1.1800", "", None, "3 أيار 2025"]
    got = [str(x) if x else None for x in values(spark, T.parse_date, given)]
    assert got == ["2026-01-24"] * 4 + ["2026-01-15", None, None, None, None, None, "2025-05-03"]


def test_keys(spark):
    assert values(spark, T.search_key, ["شركةُ  النّور", "أحمد‏", "ى١٢", None, "A  B "]) == ["شركه النور", "احمد", "ي12", None, "a b"]
    assert values(spark, T.match_key, ["ﷺ"]) == ["صلي الله عليه وسلم"]
    assert values(spark, T.merge_key, ["Panadol Extra 500mg", "PANADOL-EXTRA_500 MG"]) == ["panadolextra500mg"] * 2
    assert values(spark, T.display_form, ["شركـــة​  ١٢"]) == ["شركة 12"]
    assert values(spark, T.richness, ["مؤسسة", "موسسه"]) == [2, 0]


def test_blank_and_zeros(spark):
    assert values(spark, T.is_blank, [None, " ", "n/A", "—", "غير محدد", "0", "x"]) == [True] * 5 + [False] * 2
    assert values(spark, T.loses_leading_zero, ["001", "0", "10", "0x"]) == [True, False, False, False]
    assert values(spark, T.is_hijri_like, ["1445-01-01", "2024-01-01"]) == [True, False]
    assert values(spark, T.strip, ["  a  "]) == ["a"]
    assert values(spark, T.arabic_share, ["اب", "ab", ""]) == [1.0, 0.0, 0.0]


@pytest.mark.parametrize(("text", "code"), [("السعر بالدولار", "USD"), ("دينار", None), ("ليرة تركية", "TRY"), ("100 ل.س", "SYP"), ("ليرة", "SYP"), ("€5", "EUR"), ("", None), ("try again", "TRY"), ("price", None)])
def test_currency(text, code):
    assert currency.code_in(text) == code


def test_labels():
    assert labels.number_text(1234.5) == "1,234.50" and labels.number_text(None) == "—"
    assert labels.currency_text(5.0) == "5.00" and labels.compact_text(2_500_000).startswith("2.5")
    assert [labels.counted(n, "a", "b", "c") for n in (1, 2, 3, 11)] == ["a", "b", "3 c", "11 a"]
