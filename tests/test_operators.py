from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tabloom.operators import browse, catalog, clean, meaning, metrics as M, profile as P


@pytest.fixture(scope="module")
def sales(spark):
    rows = [(f"INV-{i}", f"2026-{i % 8 + 1:02d}-{i % 28 + 1:02d}", ["A", "B", "C"][i % 3], i % 7 + 1, 10.0 * (i % 5 + 1)) for i in range(200)]
    df = spark.createDataFrame(rows, "invoice string, date string, product string, qty int, price double")
    return df.withColumn("total", F.col("qty") * F.col("price"))


def test_answer_has_evidence(sales):
    got = M.answer(sales, "total", "sum", [("product", "=", "A")])
    assert got.value == sum(r.total for r in sales.collect() if r["product"] == "A")
    assert got.evidence.rows_in_scope == 67 and got.evidence.rows_total == 200
    none = M.answer(sales, "total", "sum", [("product", "=", "zzz")])
    assert none.value == 0 and none.evidence.rows_in_scope == 0


def test_groups_and_ties(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0), (None, 3.0), ("c", None)], "k string, v double")
    assert [tuple(r) for r in M.top_n(df, "v", "k", 4).collect()] == [(None, 3.0), ("a", 1.0), ("b", 1.0), ("c", 0.0)]
    assert M.count_distinct(df, "k").first()[0] == 3


def test_concentration_edges(spark):
    one = spark.createDataFrame([("a", 5.0)], "k string, v double")
    assert M.concentration(one, "v", "k").first()["entities_for_share"] == 1
    zero = spark.createDataFrame([("a", 0.0), ("b", 0.0)], "k string, v double")
    assert M.concentration(zero, "v", "k").first()["top_share"] == 0.0
    many = spark.createDataFrame([(str(i), float(i)) for i in range(1, 101)], "k string, v double")
    got = M.concentration(many, "v", "k").first()
    run, k = 0, 0
    for v in range(100, 0, -1):
        run, k = run + v, k + 1
        if run / 5050 >= 0.8:
            break
    assert got["entities_for_share"] == k and got["top_label"] == "100"


def test_equal_groups_stay_equal_in_any_order(spark):
    """Sums of doubles depend on the order of rows; the same values in another order are the same sum."""
    rows = [("a", 0.3), ("a", 0.2), ("a", 0.1), ("b", 0.1), ("b", 0.2), ("b", 0.3), ("c", 0.1)]
    df = spark.createDataFrame(rows, "k string, v double").coalesce(1)
    assert M.concentration(df, "v", "k").first()["top_label"] == "a"
    assert [tuple(r) for r in M.top_n(df, "v", "k", 2).collect()] == [("a", 0.6), ("b", 0.6)]
    odd = spark.createDataFrame([("a", 1e300), ("a", 1e-300), ("b", float("inf")), ("c", 1e19), ("c", 9e19), ("d", None)], "k string, v double")
    assert {r["label"]: r["value"] for r in M.top_n(odd, "v", "k", 4).collect()} == {"a": 1e300, "b": float("inf"), "c": 1e20, "d": 0.0}


def test_histogram_of_equal_values(spark):
    df = spark.createDataFrame([(2.0,)] * 3 + [(None,)], "v double")
    assert [tuple(r)[::2] for r in M.histogram(df, "v").collect()] == [(0.0, 3)]


def test_compare_periods(sales):
    df = sales.withColumn("date", F.to_date("date"))
    got = M.compare_periods(df, "total", "date", ("1999-01-01", "1999-12-31"), ("2026-01-01", "2026-12-31")).first()
    assert got["value_1"] == 0 and got["change_pct"] is None and got["value_2"] > 0


def test_profile_types(spark):
    n = 40
    rows = [(str(i), f"{i % 5:03d}", "نعم" if i % 2 else "لا", f"{i}.5 ر.س", f"{i % 28 + 1}/02/2026", f"g{i % 3} ", None, f"id-{i}", "k") for i in range(n)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string, f string, g string, h string, k string")
    got = P.profile(df)
    assert [c.type for c in got.columns] == ["integer", "identifier", "boolean", "float", "date", "categorical", "empty", "identifier", "categorical"]
    assert [i.kind for i in got.column("f").issues] == ["whitespace"] and "constant_column" in [i.kind for i in got.column("k").issues]
    assert got.column("d").stats["p25"] == 10.5 and got.column("e").first_date == "2026-02-01" and got.duplicates == 0
    assert [i.kind for i in got.column("g").issues] == ["sparse_column"]


def test_clean_recipe(spark):
    rows = [(i, f" شركة النور{i % 2}" if i % 3 else f"شركه النور{i % 2}", "1,000" if i != 7 else "999999", "x" if i == 3 else "5") for i in range(60)]
    rows += [(60, *rows[0][1:])]
    df = spark.createDataFrame(rows, "n long, name string, amount string, q string")
    found = P.profile(df, "n")
    ops = clean.plan(found, ["name"])
    kinds = [o.kind for o in ops]
    assert kinds[:2] == ["trim_whitespace", "normalize_arabic"] and "parse_numbers" in kinds and "deduplicate_rows" in kinds and "fuzzy_entity_merge" in kinds
    out = clean.run(df, ops, "n")
    assert {r[0] for r in out.select("name").distinct().collect()} == {"شركة النور0", "شركة النور1"}
    assert dict(out.dtypes)["amount"] == "double"
    log = {c.kind: c for c in clean.log(df, ops, "n")}
    assert log["trim_whitespace"].cells > 0 and log["parse_numbers"].failed == 1 and log["parse_numbers"].examples
    off = clean.without(ops, ["fuzzy_entity_merge:name"])
    assert clean.run(df, off, "n").select("name").distinct().count() == 4


def test_flag_outliers(spark):
    df = spark.createDataFrame([(float(i % 10),) for i in range(50)] + [(1000.0,), (None,)], "v double")
    out = clean.flag_outliers(df, ["v", "missing"])
    assert out.where(M.named(clean.FLAG_PREFIX + "v")).collect()[0]["v"] == 1000.0 and out.count() == 52
    assert clean.flag_columns(out.columns) == {"v": clean.FLAG_PREFIX + "v"}
    assert clean.flag_outliers(df.limit(5), ["v"]).columns == ["v"]


def test_numbered_is_dense(spark):
    df = spark.range(1000).repartition(7)
    assert sorted(r[0] for r in clean.numbered(df, "n").select("n").collect()) == list(range(1, 1001))


def test_browse(spark):
    df = spark.createDataFrame([(i, "مؤسسة" if i % 2 else "x", float(i) if i % 5 else None) for i in range(30)], "i int, s string, v double")
    page = browse.browse(df, "موسسه", sort="v", descending=True, page=1, size=5)
    assert page.total == 15 and page.pages == 3 and [r["i"] for r in page.rows] == [29, 27, 23, 21, 19]
    last = browse.browse(df, "", sort="v", page=6, size=5)
    assert all(r["v"] is None for r in last.rows) and len(last.rows) == 5
    assert browse.browse(df, "nothing").pages == 1


def test_catalog(spark):
    t1, t2 = F.lit(datetime(2026, 1, 1)), F.lit(datetime(2026, 1, 2))
    first = catalog.accept(spark.createDataFrame([("a", 1.0, ["x", "y"]), ("b", 2.0, None)], "item_id string, price double, aliases array<string>"))
    state = catalog.merge(None, first, t1).state
    second = catalog.accept(spark.createDataFrame([("b", None), ("c", 3.0)], "item_id string, price double"))
    out = catalog.merge(state, second, t2)
    rows = {r["item_id"]: r for r in out.state.collect()}
    assert not rows["a"]["active"] and rows["a"]["aliases"] == "x | y" and rows["b"]["price"] is None and rows["b"]["price_changed_at"] == datetime(2026, 1, 2)
    assert out.stats.first().asDict() == {"received": 2, "added": 1, "price_changed": 1, "reactivated": 0, "removed": 1, "active_total": 2}
    delta = catalog.merge(state, second, t2, "delta")
    assert delta.stats.first()["active_total"] == 3 and delta.price_changes.count() == 1
    back = catalog.merge(out.state, first, t2)
    assert back.stats.first()["reactivated"] == 1


@pytest.mark.parametrize("rows", [[("a", "1"), ("a", "2")], [("", "1")], [("a", "1,000")], [("a", "nan")]])
def test_catalog_refuses(spark, rows):
    with pytest.raises(catalog.CatalogError):
        catalog.accept(spark.createDataFrame(rows, "item_id string, price string"))
    with pytest.raises(catalog.CatalogError):
        catalog.accept(spark.createDataFrame([("a", "1")], "item_id string, price string"), declared=2)


def test_meaning(spark, sales):
    found = P.profile(sales)
    schema = meaning.resolve(sales, found)
    got = {c.column: c.concept for c in schema.columns}
    assert got == {"invoice": "invoice_no", "date": "date", "product": "product_name", "qty": "quantity", "price": "unit_price", "total": "total_amount"}
    assert schema.measure() == "total" and schema.domain == "generic"
    said = meaning.overridden(schema, {"qty": {"concept": "stock_qty"}})
    assert said.by_concept("stock_qty").method == "user"
    with pytest.raises(meaning.UnknownConcept):
        meaning.overridden(schema, {"qty": {"concept": "nope"}})


def test_ambiguous_sales_is_no_money(spark):
    df = spark.createDataFrame([(f"s{i}", 10 + i, 5 + i % 9) for i in range(30)], "SKU string, OpeningStock int, Sales int")
    assert meaning.resolve(df, P.profile(df)).by_concept("total_amount") is None


def test_mixed_currencies(spark):
    df = spark.createDataFrame([("دولار", 5.0), ("ليرة سورية", 7.0), ("دولار", 1.0)] * 5, "`العملة` string, `المبلغ` double")
    schema = meaning.resolve(df, P.profile(df))
    assert schema.currency.mixed and schema.currency.codes == ["USD", "SYP"]


def test_radix_selection(spark):
    """Any number of passes gives what sorting gives: ties, both zeros, infinities, tiny and huge numbers, and nulls."""
    n = 20_001
    odd = F.when(F.col("id") < 9, F.get(F.array(*[F.lit(x) for x in (0.0, -0.0, float("inf"), float("-inf"), 5e-324, -5e-324, 1e308, -1e-300, 0.5)]), F.col("id").cast("int")))
    df = spark.range(n).select((F.pmod(F.xxhash64("id"), F.lit(1000)) * F.pmod(F.hash("id"), F.lit(7))).cast("double").alias("v"), F.lit(3.0).alias("same"), F.coalesce(odd, F.randn(3)).alias("odd"), F.when(F.col("id") % 3 == 0, -F.col("id")).alias("few"))
    rows = df.collect()
    values, ranks = {c: F.col(c) for c in df.columns}, {}
    ordered = {c: sorted(r[c] for r in rows if r[c] is not None) for c in df.columns}
    for c, x in ordered.items():
        ranks[c] = [0, 1, len(x) // 4, len(x) // 2, len(x) - 2, len(x) - 1]
    for few in (0, 500, 10**9):
        got = P.order_statistics(df, values, {c: len(x) for c, x in ordered.items()}, ranks, few)
        assert got == {c: [ordered[c][i] for i in ranks[c]] for c in ordered}


def test_radix_selection_of_many_ties(spark):
    """Ten million values, of which nine in ten are one number: no task ever holds a list of them."""
    n = 10_000_000
    df = spark.range(n).select(F.when(F.col("id") % 10 != 0, 7.25).otherwise(F.col("id").cast("double")).alias("v"))
    got = P.order_statistics(df, {"v": F.col("v")}, {"v": n}, {"v": [0, 1, n // 2, n - n // 10, n - n // 10 + 1, n - 1]}, few=1000)
    assert got["v"] == [0.0, 7.25, 7.25, 7.25, 10.0, float(n - 10)]


def test_similarity_of_names():
    """The ratio of common letters, on keys."""
    from difflib import SequenceMatcher

    pairs = [("total", "total amount"), ("abcd", "abxy"), ("price", "prices"), ("Qty", "qty"), ("السعر", "سعر"), ("إجمالي", "اجمالي"), ("", ""), ("a", "")]
    pairs += [(a, b) for a in ("unit price", "Invoice No", "stock", "customer name") for b in ("price unit", "invoice_no", "stocks", "name")]
    for a, b in pairs:
        assert meaning.similarity(a, b) == SequenceMatcher(None, meaning.plain_key(a), meaning.plain_key(b)).ratio()
    assert meaning.by_name("prices", "float").confidence == meaning.CONTAINED and meaning.by_name("qty", "text").confidence == meaning.WRONG_TYPE


def columns_of(df):
    schema = meaning.resolve(df, P.profile(df))
    return schema, {c.column: (c.concept, c.role) for c in schema.columns}


def test_constant_columns(spark):
    n = 40
    df = spark.createDataFrame([("store", "SYP", n, 7, float(i % 9 + 1), f"p{i % 5}") for i in range(n)], "branch string, currency string, records int, level int, price double, product string")
    schema, got = columns_of(df)
    assert got["branch"] == (None, "constant") and got["records"] == (None, "constant") and schema.currency.codes == ["SYP"]
    assert next(c for c in schema.columns if c.column == "level").confidence <= meaning.CONSTANT_CONFIDENCE
    assert got["price"][0] == "unit_price" and got["product"][0] == "product_name"


def test_inventory_domain(spark):
    """A quantity beside barcodes and warehouses, without dates or customers, is a stock; a sale's is not."""
    rows = [(f"62{i:08d}", f"drug {i % 30}", f"w{i % 3}", i % 7 + 1, 10.0 + i % 11) for i in range(120)]
    df = spark.createDataFrame(rows, "barcode string, item string, warehouse string, qty int, price double")
    schema, got = columns_of(df)
    assert schema.domain == "inventory" and got["qty"] == ("stock_qty", "measure")
    dated = df.selectExpr("*", "date_add(DATE'2026-01-01', qty) AS date")
    schema, got = columns_of(dated)
    assert schema.domain == "generic" and got["qty"][0] == "quantity"
    schema, _ = columns_of(df.selectExpr("*", "date_add(DATE'2027-01-01', qty) AS expiry", "warehouse AS maker"))
    assert schema.domain == "pharmacy"


def test_vetoes_between_columns(spark):
    """Sales beside a price is money; a price in dollars is no exchange rate; one date by shape, beside others."""
    df = spark.createDataFrame([(5 + i % 9, 2.0 + i % 4, 100.0 + i % 13, f"2026-01-{i % 28 + 1:02d}", f"2026-02-{i % 28 + 1:02d}") for i in range(60)], "Sales int, price double, `السعر بالدولار` double, firstmoment string, othermoment string")
    schema, got = columns_of(df)
    assert got["Sales"][0] == "total_amount" and got["السعر بالدولار"] == ("unit_price", "measure")
    assert got["firstmoment"] == ("date", "time") and got["othermoment"] == (None, "time")


def test_products_among_many_columns(spark):
    """Fifty numeric columns make a plan of bounded size, and the one true product is found."""
    rnd = [F.round(F.rand(i) * 900 + 100, 2).alias(f"m{i}") for i in range(47)]
    df = spark.range(400).select((F.col("id") % 9 + 1).cast("int").alias("a"), F.round(F.rand(99) * 50 + 1, 2).alias("b"), *rnd).withColumn("c", F.col("a") * F.col("b"))
    numeric = df.columns
    found = P.TableProfile(400, 0, [P.ColumnProfile(c, i, "integer" if c == "a" else "float", 1.0, 400, 0, 300, {"mean": 5.0 if c == "a" else 25.0}) for i, c in enumerate(numeric)], [])
    assert len(meaning.likely_products(df, numeric)) <= 5
    assert meaning.cross_validated(df, found, numeric) == {"a": "quantity", "b": "unit_price", "c": "total_amount"}


@pytest.mark.parametrize("together", [60, 0])
def test_products_that_few_rows_show(spark, monkeypatch, together):
    """A total in one row of 1,600 is found, and equal rows count each: all rows are looked at, by one aggregation or by tasks."""
    monkeypatch.setattr(meaning, "TOGETHER", together)
    monkeypatch.setattr(meaning, "COUNTED", 6)  # two pairs of three columns in a pass
    rows = spark.range(0, 40000, 1, 5).select("id", (F.col("id") % 9 + 2).cast("int").alias("q"), (F.col("id") % 97 + 0.5).alias("p")).withColumn("t", F.col("q") * F.col("p"))
    sparse = rows.withColumn("t", F.when(F.col("id") % 1600 == 0, F.col("t")))
    assert meaning.likely_products(sparse, ["q", "p", "t"]) == [(0, 1, 2)]
    right = rows.where("id < 6000").drop("id")
    wrong = spark.range(0, 1200, 1, 2).select(F.lit(3).alias("q"), F.lit(7.5).alias("p"), F.lit(100.0).alias("t"))
    assert meaning.likely_products(right.union(wrong), ["q", "p", "t"]) == [(0, 1, 2)]
    assert meaning.likely_products(right.limit(2000).union(wrong), ["q", "p", "t"]) == []


def test_counts_of_products_by_tasks(spark):
    """Tasks count as the aggregation does: blanks, zeros, numbers that are none or endless, and text."""
    odd = [None, 0.0, -0.0, float("nan"), float("inf"), -3.0, 2.0, 2.01, 6.0, 6.1, 1e300]
    rows = [(odd[i % 11], odd[i // 11 % 11], None if i % 5 == 0 else 2 * (i % 4), f"{i % 7}.50" if i % 3 else " ", odd[(i * 7) % 11]) for i in range(1331)]
    df = spark.createDataFrame(rows, "a double, b double, c int, d string, e double").repartition(4)
    want = meaning.product_ratio(df, df.columns).first().asDict()
    got = {tuple(r)[:3]: tuple(r)[3:] for r in meaning.product_counts(df, df.columns, [(a, b) for a in range(5) for b in range(a + 1, 5)]).collect()}
    asked = {tuple(map(int, k.split("_")[:3])) for k in want}
    assert got == {t: (n, want["{}_{}_{}_equal".format(*t)]) for t in asked if (n := want["{}_{}_{}_tested".format(*t)])}
    assert any(equal for _, equal in got.values())


def looked_at(spark, df, name):
    """df with a column more in which each reading of a row is counted, and the counter."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(x):
        seen.add(1)
        return x

    return df.withColumn(name, read.asNondeterministic()(F.col(name))), seen


def test_profile_reads_text_as_numbers_once(spark):
    df, seen = looked_at(spark, spark.range(0, 400, 1, 2).select((F.col("id") % 130).cast("string").alias("v"), F.lit(" x ").alias("t")), "v")
    found = P.profile(df)
    assert seen.value <= 4 * 400  # cells, numbers, head, whole rows; not each pass over the numbers
    v, t = found.columns
    assert (v.type, v.unique, v.stats["min"], v.stats["max"], v.stats["median"]) == ("integer", 130, 0, 129, 63)
    assert [(i.kind, i.count) for i in t.issues if i.kind == "whitespace"] == [("whitespace", 400)] and t.average_length == 3


def test_meaning_reads_its_input_once(spark, monkeypatch):
    from tabloom import more_queries

    rows = spark.range(0, 200, 1, 2).select((F.col("id") % 7 + 1).alias("qty"), (F.col("id") % 11 + 2.5).alias("x1")).withColumn("x2", F.col("qty") * F.col("x1"))
    df, seen = looked_at(spark, rows.withColumn("product", F.concat(F.lit("p"), (F.col("x1") * 10).cast("string"))), "product")
    found = more_queries.meaning_of(df)
    assert seen.value == 200
    assert {c.column: c.concept for c in found.columns} == {"qty": "quantity", "x1": "unit_price", "x2": "total_amount", "product": "product_name"}


def test_cells_that_differ_in_white_space_are_one_value(spark):
    df = spark.createDataFrame([(" a", 5), ("a", 3), ("a ", 4), (" a", 2), ("n/a", 1), (None, 0)], "v string, at long")
    got = P.value_counts(df, ["v"], "at").collect()
    assert [tuple(r) for r in got] == [(0, "a", 4, 2, 3, 7)]
