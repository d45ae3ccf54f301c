"""More operators as queries: file readers and writers, profiles, meaning, findings and charts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions import text as T
from .functions.currency import with_currency
from .operators import catalog, clean, indexed, meaning, metrics as M, profile as P
from .plans import guard, insights
from .plans.process import process
from .queries import FENCES, KEY, QUERIES, SQL, query, rounded, table
from .session import removed, scratch, stored
from .sources import readers, sinks
from .sources.xlsx import write_xlsx


def only_file(spark: SparkSession, folder: str) -> str:
    """The one data file that Spark wrote to a folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/part-*")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return found[0].getPath().toString()


def written(df: DataFrame, kind: str, **options) -> str:
    """df as one file of a format."""
    out = scratch(df.sparkSession, f"file-{kind}")
    df.coalesce(1).write.format(kind).options(**options).save(out)
    return only_file(df.sparkSession, out)


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer")


CUSTOMER = "SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_mktsegment FROM customer"


@query(CUSTOMER)
def csv_scan(spark, sf_dir):
    path = written(customers(spark, sf_dir).select("c_custkey", "c_name", "c_mktsegment"), "csv", header=True)
    return readers.read(spark, path)[0].drop(readers.ROW)


@query("SELECT c_custkey::VARCHAR AS \"الرقم\", 'زبون ' || c_custkey::VARCHAR AS \"الاسم\", c_mktsegment AS \"القسم\" FROM customer")
def csv_scan_arabic(spark, sf_dir):
    """Another encoding, another delimiter, and Arabic names: all of it found out from the file."""
    df = customers(spark, sf_dir).select(F.col("c_custkey").alias("الرقم"), F.concat(F.lit("زبون "), F.col("c_custkey").cast("string")).alias("الاسم"), F.col("c_mktsegment").alias("القسم"))
    return readers.read(spark, _in_windows_1256(spark, df))[0].drop(readers.ROW)


def _in_windows_1256(spark: SparkSession, df: DataFrame) -> str:
    """A file in an encoding that Spark writes only when told to, for as long as it is written."""
    name = "spark.sql.legacy.javaCharsets"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        return written(df, "csv", header=True, sep=";", encoding="windows-1256")
    finally:
        spark.conf.set(name, before)


@query("SELECT c_custkey::VARCHAR AS a, c_name AS a_1, c_mktsegment AS b FROM customer")
def csv_repeated_names(spark, sf_dir):
    """Repeated header names get numbers; columns without values go."""
    df = customers(spark, sf_dir).select(F.concat_ws(",", "c_custkey", "c_name", F.lit(" "), "c_mktsegment").alias("value"))
    lines = spark.createDataFrame([("a,a,empty,b",)], "value string").unionByName(df)
    return readers.read(spark, written(lines, "text"))[0].drop(readers.ROW)


@query("SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_mktsegment, 'W1' AS warehouse FROM customer")
def json_scan(spark, sf_dir):
    item = F.to_json(F.struct("c_custkey", "c_name", "c_mktsegment"))
    items = clean.numbered(customers(spark, sf_dir), "n").select(F.when(F.col("n") > 1, F.concat(F.lit(","), item)).otherwise(item).alias("value"))
    line = lambda x: spark.createDataFrame([(x,)], "value string").coalesce(1)
    lines = line('{"warehouse":"W1","items":[').unionByName(items).unionByName(line("]}"))
    return readers.read(spark, written(lines, "text"))[0].drop(readers.ROW)


@query("SELECT c_custkey::VARCHAR AS id, c_name AS name FROM customer")
def xml_scan(spark, sf_dir):
    df = customers(spark, sf_dir).select(F.col("c_custkey").alias("_id"), F.col("c_name").alias("name"))
    return readers.read(spark, written(df, "xml", rootTag="customers", rowTag="customer"))[0].drop(readers.ROW)


@query("SELECT s_suppkey::VARCHAR AS s_suppkey, s_name FROM supplier")
def xlsx_round_trip(spark, sf_dir):
    path = f"{scratch(spark, 'file')}.xlsx"
    write_xlsx(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), path)
    return readers.read(spark, path)[0].drop(readers.ROW)


@query("SELECT page_id AS key, 0 AS table_no, 0 AS row_no, 'k|v' AS cells FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT page_id, 0, 1, page_id::VARCHAR || '|a b' FROM pages WHERE page_id % 2 = 0")
def html_tables(spark, sf_dir):
    """Pages of which every other one has a table with a row that is empty and a script inside a cell."""
    page = F.concat(F.lit("<table><tr><th>k</th><th> v</th></tr><tr><td></td></tr><tr><td>"), F.col("page_id").cast("string"), F.lit("</td><td>a <b>b</b><script>no()</script></td></tr></table>"))
    pages = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 2 == 0, page).otherwise(F.lit("<p>no table</p>")).alias("html"))
    return readers.html_rows(pages, "html", "page_id").withColumn("cells", F.array_join("cells", "|"))


@query("SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderstatus FROM orders")
def csv_export(spark, sf_dir):
    out = scratch(spark, "export")
    sinks.write_csv(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").coalesce(1), out)
    return readers.read(spark, only_file(spark, out))[0].drop(readers.ROW)


@query("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders")
def parquet_sink(spark, sf_dir):
    out = scratch(spark, "processed")
    sinks.write_table(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice"), out)
    return spark.read.parquet(out)


@query("SELECT count(*) AS rows, round(sum(round(o_totalprice, 2)), 2) AS total, count(DISTINCT o_orderdate::DATE) AS days FROM orders")
def process_csv(spark, sf_dir):
    """A whole run over a CSV file of orders: text becomes dates and numbers."""
    df = table(spark, sf_dir, "orders").select(F.concat(F.lit("INV-"), F.col("o_orderkey").cast("string")).alias("invoice no"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("date"), F.format_string("%.2f", "o_totalprice").alias("total"), F.col("o_orderpriority").alias("category"))
    run = process(spark, written(df, "csv", header=True), scratch(spark, "run"))
    return run.table.agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("total"), 2).alias("total"), F.count_distinct("date").alias("days"))


FULL = "".join(chr(ord(c) + 0xFEE0) for c in "#0123456789CEMORSTU")
PLAIN = "#0123456789CEMORSTU"


def wide(c):
    """A text in full-width characters, which compatibility folding turns back."""
    return F.translate(F.upper(c), PLAIN, FULL)


@query("SELECT c_custkey, lower(c_name) AS key, upper(c_name) AS shown FROM customer")
def folded_forms(spark, sf_dir):
    name = F.concat(F.lit(" ‏"), wide(F.col("c_name")), F.lit("ـ"))
    return customers(spark, sf_dir).select("c_custkey", T.match_key(name).alias("key"), T.display_form(name).alias("shown"))


@query("SELECT p_partkey, p_name AS bare, 2 AS rich, 2.0 / (length(p_name) + 2) AS arabic, p_partkey % 2 = 0 AS hijri FROM part")
def arabic_marks(spark, sf_dir):
    """Diacritics go, rich letters and Arabic ones are counted, years of the Hijri calendar are seen."""
    p = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", T.strip_diacritics(F.concat(F.lit("َ"), p, F.lit("ّ"))).alias("bare"), T.richness(F.concat(p, F.lit("أة"))).cast("int").alias("rich"), T.arabic_share(F.concat(p, F.lit("اب"))).alias("arabic"), T.is_hijri_like(F.when(F.col("p_partkey") % 2 == 0, F.lit("1445-02-01")).otherwise(F.lit("2024-02-01"))).alias("hijri"))


@query("SELECT o_orderkey, o_orderdate::DATE AS day FROM orders")
def parse_named_date(spark, sf_dir):
    names = F.array(*[F.lit(m) for m in ("كانون الثاني", "شباط", "آذار", "نيسان", "أيار", "حزيران", "تموز", "آب", "أيلول", "تشرين الأول", "تشرين الثاني", "كانون الأول")])
    d = F.col("o_orderdate")
    s = F.concat_ws(" ", F.dayofmonth(d).cast("string"), F.element_at(names, F.month(d)), F.year(d).cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.parse_date(s).alias("day"))


@query("SELECT p_partkey, p_name AS name, p_size::VARCHAR AS size FROM part")
def normalized_cells(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("  "), F.replace("p_name", F.lit(" "), F.lit("  ")), F.lit("﻿")).alias("name"), F.translate(F.col("p_size").cast("string"), T.DIGITS, T.INDIC_DIGITS).alias("size"))
    return clean.run(part, [clean.Operation("normalize_arabic", ["name"], ""), clean.Operation("normalize_digits", ["size"], "")])


CHANGES = "SELECT 'trim_whitespace' AS kind, count(*) FILTER (WHERE p_partkey % 3 = 0) AS cells, 0::BIGINT AS failed FROM part UNION ALL SELECT 'parse_numbers', count(*) FILTER (WHERE p_partkey % 5 <> 0 AND p_partkey % 7 = 0), count(*) FILTER (WHERE p_partkey % 5 = 0) FROM part"


@query(CHANGES)
def change_log(spark, sf_dir):
    k = F.col("p_partkey")
    part = table(spark, sf_dir, "part").select("p_partkey", F.when(k % 3 == 0, F.concat(F.lit(" "), "p_name")).otherwise(F.col("p_name")).alias("name"), F.when(k % 5 == 0, F.lit("x1")).when(k % 7 == 0, F.lit("1,200.5")).otherwise(F.lit("1200.5")).alias("price"))
    got = clean.log(part, [clean.Operation("trim_whitespace", ["name"], ""), clean.Operation("parse_numbers", ["price"], "")], "p_partkey")
    return spark.createDataFrame([(c.kind, c.cells, c.failed) for c in got], "kind string, cells long, failed long")


SKEWED = FENCES.replace("o_totalprice", "v").replace("FROM orders", "FROM skewed").replace("WITH ", "WITH skewed AS (SELECT o_orderkey, (p * p * p) * (p * p * p) AS v FROM (SELECT o_orderkey, o_totalprice / 1000 AS p FROM orders)), ")


def skewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices to the sixth power, by products: the last digit of a power is up to the library."""
    p = F.col("o_totalprice") / 1000
    return table(spark, sf_dir, "orders").select("o_orderkey", ((p * p * p) * (p * p * p)).alias("v"))


@query(SKEWED + "SELECT o_orderkey FROM skewed, q WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)")
def outlier_flags(spark, sf_dir):
    flags = clean.flag_outliers(skewed(spark, sf_dir), ["v"])
    return flags.where(M.named(clean.flag_columns(flags.columns)["v"])).select("o_orderkey")


@query(SKEWED + "SELECT o_orderkey FROM skewed, q WHERE v > q3 + 1.5 * (q3 - q1) ORDER BY v DESC, o_orderkey LIMIT 10")
def largest_outliers(spark, sf_dir):
    return M.flagged(clean.flag_outliers(skewed(spark, sf_dir), ["v"]), "v", clean.FLAG_PREFIX + "v", 10).select("o_orderkey")


@query(SKEWED + "SELECT q1 AS p25, q3 AS p75 FROM q")
def nearest_quartiles(spark, sf_dir):
    df = skewed(spark, sf_dir)
    return P.numeric_stats(df, {"v": df.count()}).select(F.col("0_p25").alias("p25"), F.col("0_p75").alias("p75"))


@query("""WITH c AS (SELECT 'o_orderkey' AS name, 0 AS place, o_orderkey::VARCHAR AS v FROM orders UNION ALL SELECT 'day', 1, o_orderdate::DATE::VARCHAR FROM orders
  UNION ALL SELECT 'o_orderpriority', 2, o_orderpriority FROM orders UNION ALL SELECT 'price', 3, CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice::VARCHAR END FROM orders)
SELECT name, CASE place WHEN 0 THEN 'integer' WHEN 1 THEN 'date' WHEN 2 THEN 'categorical' ELSE 'float' END AS type, count(*) AS total, count(*) FILTER (WHERE v IS NULL) AS nulls, count(DISTINCT v) AS uniques FROM c GROUP BY name, place""")
def profile_table(spark, sf_dir):
    """Types, blanks and distinct values of all columns of a table of text."""
    df = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string"), F.to_date("o_orderdate").cast("string").alias("day"), "o_orderpriority", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice").cast("string")).alias("price"))
    return spark.createDataFrame([(c.name, c.type, c.total, c.nulls, c.unique) for c in P.profile(df).columns], "name string, type string, total long, nulls long, uniques long")


@query("SELECT 'missing_values' AS kind, 'price' AS name, count(*) FILTER (WHERE o_orderkey % 4 = 0) AS n FROM orders UNION ALL SELECT 'whitespace', 'o_orderpriority', count(*) FILTER (WHERE o_orderkey % 3 = 0) FROM orders UNION ALL SELECT 'negative_values', 'price', count(*) FILTER (WHERE o_orderkey % 4 = 1) FROM orders")
def profile_issues(spark, sf_dir):
    k = F.col("o_orderkey")
    price = F.when(k % 4 == 1, -F.least("o_totalprice", F.lit(1000))).when(k % 4 != 0, F.least("o_totalprice", F.lit(1000)))
    df = table(spark, sf_dir, "orders").select(F.when(k % 3 == 0, F.concat("o_orderpriority", F.lit(" "))).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"), price.cast("string").alias("price"))
    wanted = ("missing_values", "whitespace", "negative_values")
    return spark.createDataFrame([(i.kind, i.column, i.count) for c in P.profile(df).columns for i in c.issues if i.kind in wanted], "kind string, name string, n long")


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with prices of parts, under names that people use."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("product"), F.col("p_retailprice").alias("a"))
    return table(spark, sf_dir, "lineitem").join(part, "l_partkey").select("product", F.to_date("l_shipdate").alias("date"), F.col("l_quantity").cast("int").alias("qty"), F.col("a").alias("x1"), (F.col("l_quantity") * F.col("a")).alias("x2"), F.lit("2026").alias("source"))


def meaning_of(df: DataFrame) -> meaning.Schema:
    df, path = stored(df, "meaning")  # some ten passes read it, and what it is joined from is read once
    found = meaning.resolve(df, P.profile(df))
    removed(df.sparkSession, path)
    return found


@query("SELECT * FROM (VALUES ('product', 'product_name', 'dimension', 'dictionary'), ('date', 'date', 'time', 'dictionary'), ('qty', 'quantity', 'measure', 'dictionary'), ('x1', 'unit_price', 'measure', 'cross_validation'), ('x2', 'total_amount', 'measure', 'cross_validation')) AS t(name, concept, role, method)")
def resolve_schema(spark, sf_dir):
    """Names by the dictionary, prices and totals by arithmetic; a column with one value only is none of these."""
    found = meaning_of(sales(spark, sf_dir))
    return spark.createDataFrame([(c.column, c.concept, c.role, c.method) for c in found.columns if c.column != "source"], "name string, concept string, role string, method string")


LABELLED = "CASE l_returnflag WHEN 'A' THEN 'SYP' WHEN 'N' THEN 'USD' WHEN 'R' THEN 'SAR' END"


@query(f"SELECT {LABELLED} AS currency_code, round(sum(l_extendedprice), 2) AS value FROM lineitem GROUP BY 1")
def totals_by_currency(spark, sf_dir):
    """Labels are folded to codes first: several spellings of one currency are one group."""
    odd = F.col("l_linenumber") % 2 == 1
    label = F.when(F.col("l_returnflag") == "A", F.when(odd, F.lit("ل.س")).otherwise(F.lit("بالليرة السورية"))).when(F.col("l_returnflag") == "N", F.when(odd, F.lit("$")).otherwise(F.lit("السعر بالدولار"))).otherwise(F.lit("ريال سعودي"))
    coded = with_currency(table(spark, sf_dir, "lineitem").select("l_extendedprice", label.alias("label")), F.col("label"))
    return rounded(M.per_currency(coded, "l_extendedprice", "currency_code"))


@query("SELECT count(*) AS rows, round(sum(o_totalprice), 2) AS total_amount, round(sum(o_orderkey % 7), 2) AS quantity, count(DISTINCT o_custkey) AS product_name_count FROM orders")
def kpi_row(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_totalprice", (F.col("o_orderkey") % 7).alias("qty"), "o_custkey")
    schema = meaning.Schema([meaning.Meaning("o_totalprice", "total_amount", "measure", 1.0, "user"), meaning.Meaning("qty", "quantity", "measure", 1.0, "user"), meaning.Meaning("o_custkey", "product_name", "dimension", 1.0, "user")])
    got = insights.kpis(df, schema)
    return rounded(spark.createDataFrame([tuple(got.values())], "rows long, total_amount double, quantity double, product_name_count long").select(*[F.col(c) for c in got]))


def priced(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, meaning.Schema]:
    df = table(spark, sf_dir, "orders").select("o_totalprice", "o_orderdate", "o_orderpriority")
    names = {"o_totalprice": ("total_amount", "measure"), "o_orderdate": ("date", "time"), "o_orderpriority": ("category", "dimension")}
    return df, meaning.Schema([meaning.Meaning(c, concept, role, 1.0, "user") for c, (concept, role) in names.items()])


@query("SELECT 'donut' AS kind, o_orderpriority AS x, round(sum(o_totalprice), 2) AS y FROM orders GROUP BY 2 UNION ALL SELECT CASE WHEN (SELECT count(DISTINCT date_trunc('month', o_orderdate)) FROM orders) > 12 THEN 'line' ELSE 'bar' END, date_trunc('month', o_orderdate)::TIMESTAMP::VARCHAR, round(sum(o_totalprice), 2) FROM orders GROUP BY 2")
def chart_data(spark, sf_dir):
    """The points of the charts over time and over a dimension, with the form that the rules choose."""
    got = insights.charts(*priced(spark, sf_dir))
    return rounded(spark.createDataFrame([(c.kind, p["x"], p["y"]) for c in got if c.kind != "histogram" for p in c.data], "kind string, x string, y double"))


@query("""WITH o AS (SELECT o_orderdate::DATE AS day, o_totalprice * (year(o_orderdate) - 1991) AS v FROM orders), b AS (SELECT min(day) AS lo, max(day) AS hi FROM o), m AS (SELECT lo + CAST((hi - lo) // 2 AS INTEGER) AS mid FROM b),
s AS (SELECT sum(CASE WHEN day <= mid THEN v ELSE 0 END) AS a, sum(CASE WHEN day > mid THEN v ELSE 0 END) AS z FROM o, m)
SELECT CASE WHEN z > a THEN 'growth' ELSE 'decline' END AS kind, round((z - a) / a * 100, 2) AS change_pct FROM s WHERE abs((z - a) / a * 100) >= 10""")
def growth_finding(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"), (F.col("o_totalprice") * (F.year("o_orderdate") - 1991)).alias("v"))
    got = insights.growth(df, "v", "day")
    return rounded(spark.createDataFrame([(i.kind, i.values["change_pct"]) for i in got], "kind string, change_pct double"))


SELF = "SELECT count(*) AS n FROM {0} a JOIN {0} b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber"


@query(SELF.format("lineitem"))
def guarded_self_join(spark, sf_dir):
    return guard.guarded(table(spark, sf_dir, "lineitem"), SELF.format("dataset"))


@query("SELECT 'l_orderkey,l_returnflag,l_quantity' AS columns, count(*) FILTER (WHERE l_quantity > 25) AS rows_in_scope, count(*) AS rows_total FROM lineitem")
def guarded_evidence(spark, sf_dir):
    """Columns that the plan reads, in the table's order, and rows that the condition lets through."""
    rows, e = guard.answered(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_tax", "l_quantity"), "SELECT l_returnflag, max(l_orderkey), 'l_tax' AS said FROM dataset WHERE l_quantity > 25 GROUP BY l_returnflag")
    return spark.createDataFrame([(",".join(e.columns), e.rows_in_scope, e.rows_total)], "columns string, rows_in_scope long, rows_total long")


@query(f"SELECT doc_id, source FROM documents WHERE contains({KEY.replace('@', 'text')}, 'tion the') OR contains({KEY.replace('@', 'source')}, 'tion the')")
def search_by_index(spark, sf_dir):
    """All rows in which a text is found, from the ranges of rows that hold all of its trigrams."""
    path = scratch(spark, "indexed")
    indexed.write_indexed(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), path, ["text", "source"])
    return indexed.search_indexed(spark, path, "  TION the").select("doc_id", "source")


@query("SELECT * FROM part ORDER BY p_retailprice DESC NULLS LAST, p_partkey LIMIT 50 OFFSET 950")
def deep_page(spark, sf_dir):
    """The twentieth page of a table, from the one range of its order index that holds it."""
    path = scratch(spark, "order")
    indexed.write_order_index(table(spark, sf_dir, "part"), path, "p_retailprice", True, ["p_partkey"])
    return indexed.page_rows(spark, path, 20, 50)[0]


@query("SELECT c_custkey::VARCHAR AS id, c_name || chr(10) || 'said \"' || c_mktsegment || '\", once' AS remark, c_mktsegment AS segment FROM customer")
def csv_records(spark, sf_dir):
    """Values over two lines with quotes and delimiters inside, as spreadsheets export remarks."""
    remark = F.concat("c_name", F.lit('\nsaid "'), "c_mktsegment", F.lit('", once'))
    df = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), remark.alias("remark"), F.col("c_mktsegment").alias("segment"))
    return readers.read(spark, written(df, "csv", header=True, escape='"'))[0].drop(readers.ROW)


MONTHS = "SELECT strftime(o_orderdate, '%Y-%m') AS m, sum(o_totalprice) AS v FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1"
MONTH_PAIR = "SELECT a.m AS month_1, b.m AS month_2, round(a.v, 2) AS value_1, round(b.v, 2) AS value_2, round((b.v - a.v) / a.v * 100, 2) AS change_pct FROM {0} a, {0} b"


@query(f"WITH g AS ({MONTHS}), l AS (SELECT *, row_number() OVER (ORDER BY m DESC) AS k FROM g) {MONTH_PAIR.format('l')} WHERE a.k = 2 AND b.k = 1")
def last_two_months(spark, sf_dir):
    return rounded(M.compare_months(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderdate", filters=[("o_orderpriority", "=", "1-URGENT")]))


@query(f"WITH g AS ({MONTHS}) {MONTH_PAIR.format('g')} WHERE a.m = '1996-03' AND b.m = '1995-03'")
def two_months(spark, sf_dir):
    return rounded(M.compare_months(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderdate", ("1996-03", "1995-03"), filters=[("o_orderpriority", "=", "1-URGENT")]))


@query("SELECT l_shipmode AS label, round(sum(l_extendedprice), 2) AS value FROM (SELECT *, l_linestatus AS l_shipmode FROM lineitem) WHERE l_returnflag = 'R' AND l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY 1 ORDER BY 2 DESC LIMIT 10")
def top_n_filtered(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("l_shipmode", F.col("l_linestatus"))
    return rounded(M.top_n(li, "l_extendedprice", "l_shipmode", 10, filters=[("l_returnflag", "=", "R"), ("l_shipdate", ">=", "1995-01-01")]))


@query("SELECT date_trunc('month', l_shipdate)::TIMESTAMP AS period, round(sum(l_extendedprice), 2) AS value FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1")
def ts_month_filtered(spark, sf_dir):
    return rounded(M.timeseries(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_shipdate", "month", filters=[("l_returnflag", "=", "R")]))


@query("SELECT p_partkey::VARCHAR AS item_id, p_name AS name_raw, round(p_retailprice, 2) AS price, 'delta' AS mode, (SELECT count(*) FROM part) AS declared, TIMESTAMP '2026-01-02 03:00:00' AS synced_at FROM part")
def catalog_payload(spark, sf_dir):
    """A snapshot as a sender writes it, read and accepted."""
    items = table(spark, sf_dir, "part").agg(F.collect_list(F.struct(F.concat(F.col("p_partkey").cast("string"), F.lit(" ")).alias("item_id"), F.col("p_name").alias("name_raw"), F.round("p_retailprice", 2).cast("string").alias("price"))).alias("items"), F.count(F.lit(1)).alias("count"))
    got = catalog.payload(spark, written(items.select("items", "count", F.lit("DELTA").alias("mode"), F.lit("2026-01-02T03:00:00").alias("generated_at")), "json"))
    accepted = catalog.accept(got.items, got.mode, got.declared)
    return accepted.select("item_id", "name_raw", "price", F.lit(got.mode).alias("mode"), F.lit(got.declared).cast("long").alias("declared"), F.lit(got.synced_at).alias("synced_at"))


@query("SELECT count(*) AS rows, count(*) FILTER (WHERE p_partkey % 10 = 0) AS without_key, count(*) FILTER (WHERE p_partkey % 10 = 1) AS repeated, count(*) FILTER (WHERE p_partkey % 10 = 2) AS bad_price FROM part")
def catalog_problems(spark, sf_dir):
    k = F.col("p_partkey")
    key = F.when(k % 10 == 0, F.lit(" ")).when(k % 10 == 1, (k + 1).cast("string")).otherwise(k.cast("string"))
    return catalog.problems(table(spark, sf_dir, "part").select(key.alias("item_id"), F.when(k % 10 == 2, F.lit("abc")).otherwise(F.col("p_retailprice").cast("string")).alias("price")))


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
