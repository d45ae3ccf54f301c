"""Operators as queries over the test tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions import text as T
from .functions.currency import currency_counts
from .operators import browse, catalog, clean, meaning, metrics as M, profile as P
from .plans import guard
from .sources.readers import flattened, narrative_words
from .streaming import jobs, silence

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function as a query, under its own name."""

    def add(f: Callable) -> Callable:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 2) -> DataFrame:
    """Doubles rounded, so that the order of additions does not show."""
    return df.select(*[F.round(M.named(c), digits).alias(c) if k == "double" else M.named(c) for c, k in df.dtypes])


for _agg in ("sum", "avg", "min", "max"):

    @query(f"SELECT round({_agg}(l_extendedprice), 2) AS value, count(*) AS rows_in_scope FROM lineitem", f"agg_{_agg}_total")
    def _(spark, sf_dir, agg=_agg):
        return rounded(M.aggregate(table(spark, sf_dir, "lineitem"), "l_extendedprice", agg))


@query("SELECT round(sum(l_extendedprice), 2) AS value, count(*) AS rows_in_scope FROM lineitem WHERE l_returnflag = 'R'")
def agg_filtered(spark, sf_dir):
    return rounded(M.aggregate(table(spark, sf_dir, "lineitem"), "l_extendedprice", "sum", [("l_returnflag", "=", "R")]))


@query("SELECT round(sum(l_extendedprice), 2) AS sum, round(avg(l_extendedprice), 2) AS avg, min(l_extendedprice) AS min, max(l_extendedprice) AS max, count(*) AS rows_in_scope FROM lineitem WHERE l_quantity >= 10 AND l_discount < 0.05")
def agg_all(spark, sf_dir):
    return rounded(M.aggregates(table(spark, sf_dir, "lineitem"), "l_extendedprice", [("l_quantity", ">=", 10), ("l_discount", "<", 0.05)]))


@query("SELECT count(*) AS value FROM orders WHERE o_orderstatus <> 'F'")
def count_rows(spark, sf_dir):
    return M.count_rows(table(spark, sf_dir, "orders"), [("o_orderstatus", "<>", "F")])


@query("SELECT count(DISTINCT l_suppkey) AS value FROM lineitem")
def count_distinct_supplier(spark, sf_dir):
    return M.count_distinct(table(spark, sf_dir, "lineitem"), "l_suppkey")


@query("SELECT l_linestatus AS currency_code, round(sum(l_extendedprice), 2) AS value FROM lineitem GROUP BY 1")
def per_group_totals(spark, sf_dir):
    return rounded(M.per_currency(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_linestatus"))


TOP = "SELECT l_suppkey AS label, round(coalesce(sum(l_extendedprice), 0), 2) AS value FROM lineitem GROUP BY 1 ORDER BY sum(l_extendedprice) {0}, 1 LIMIT {1}"


@query(TOP.format("DESC", 10))
def top_n_supplier(spark, sf_dir):
    return rounded(M.top_n(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_suppkey", 10))


@query(TOP.format("ASC", 5))
def bottom_n_supplier(spark, sf_dir):
    return rounded(M.top_n(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_suppkey", 5, ascending=True))


@query("WITH g AS (SELECT o_orderpriority AS label, sum(o_totalprice) AS value FROM orders GROUP BY 1) SELECT label, round(value, 2) AS value, round(value * 100 / (SELECT sum(o_totalprice) FROM orders), 4) AS share_pct FROM g ORDER BY g.value DESC LIMIT 3")
def top_n_share(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    total = orders.agg(F.sum("o_totalprice")).first()[0] or 0.0
    out = M.with_share(M.top_n(orders, "o_totalprice", "o_orderpriority", 3), total)
    return out.select("label", F.round("value", 2).alias("value"), F.round("share_pct", 4).alias("share_pct"))


for _grain in M.GRAINS:

    @query(f"SELECT date_trunc('{_grain}', l_shipdate)::TIMESTAMP AS period, round(sum(l_extendedprice), 2) AS value FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 1", f"ts_{_grain}")
    def _(spark, sf_dir, grain=_grain):
        return rounded(M.timeseries(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_shipdate", grain))


PERIODS = """WITH p AS (SELECT coalesce(sum(CASE WHEN o_orderdate BETWEEN DATE '1995-01-01' AND DATE '1995-06-30' THEN o_totalprice END), 0) AS a,
  coalesce(sum(CASE WHEN o_orderdate BETWEEN DATE '1995-07-01' AND DATE '1995-12-31' THEN o_totalprice END), 0) AS b FROM orders {0})
SELECT round(a, 2) AS value_1, round(b, 2) AS value_2, round(CASE WHEN a <> 0 THEN (b - a) / a * 100 END, 2) AS change_pct FROM p"""


@query(PERIODS.format(""))
def compare_periods(spark, sf_dir):
    return rounded(M.compare_periods(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderdate", ("1995-01-01", "1995-06-30"), ("1995-07-01", "1995-12-31")))


@query(PERIODS.format("WHERE o_orderpriority = '1-URGENT'"))
def compare_periods_filtered(spark, sf_dir):
    return rounded(M.compare_periods(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderdate", ("1995-01-01", "1995-06-30"), ("1995-07-01", "1995-12-31"), filters=[("o_orderpriority", "=", "1-URGENT")]))


@query("SELECT min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders")
def date_bounds(spark, sf_dir):
    return M.date_bounds(table(spark, sf_dir, "orders"), "o_orderdate")


PARETO = """WITH g AS (SELECT {1} AS label, coalesce(sum({2}), 0) AS value FROM {0} GROUP BY 1),
r AS (SELECT *, sum(value) OVER (ORDER BY value DESC, label ROWS UNBOUNDED PRECEDING) / (SELECT sum(value) FROM g) AS cum, row_number() OVER (ORDER BY value DESC, label) AS k FROM g)
SELECT count(*) AS entities, min(CASE WHEN cum >= 0.8 THEN k END) AS entities_for_share, min(CASE WHEN k = 1 THEN label END) AS top_label, round(max(value), 2) AS top_value, round(max(value) / sum(value), 4) AS top_share, round(sum(value), 2) AS total FROM r"""


def _pareto(df: DataFrame, measure: str, dimension: str) -> DataFrame:
    out = M.concentration(df, measure, dimension)
    return out.select("entities", "entities_for_share", "top_label", F.round("top_value", 2).alias("top_value"), F.round("top_share", 4).alias("top_share"), F.round("total", 2).alias("total"))


@query(PARETO.format("lineitem", "l_suppkey", "l_extendedprice"))
def pareto_supplier(spark, sf_dir):
    return _pareto(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_suppkey")


@query(PARETO.format("orders", "o_custkey", "o_totalprice"))
def pareto_customer(spark, sf_dir):
    return _pareto(table(spark, sf_dir, "orders"), "o_totalprice", "o_custkey")


@query("WITH b AS (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 12 AS w FROM lineitem) SELECT floor((l_extendedprice - lo) / w)::DOUBLE AS bucket, round(min(lo) + floor((l_extendedprice - lo) / w) * min(w), 4) AS from_value, count(*) AS n FROM lineitem, b GROUP BY floor((l_extendedprice - lo) / w)")
def histogram_price(spark, sf_dir):
    return rounded(M.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice"), 4)


@query("SELECT min(o_totalprice) AS min, max(o_totalprice) AS max, round(avg(o_totalprice), 2) AS mean, round(median(o_totalprice), 2) AS median, round(stddev_samp(o_totalprice), 2) AS std, round(quantile_cont(o_totalprice, 0.25), 2) AS p25, round(quantile_cont(o_totalprice, 0.75), 2) AS p75 FROM orders")
def profile_numeric(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return rounded(P.numeric_stats(orders, {"o_totalprice": orders.count()}, interpolate=True).toDF("min", "max", "mean", "median", "std", "p25", "p75"))


@query("SELECT count(*) AS rows, count(*) FILTER (WHERE value IS NULL OR trim(value::VARCHAR) = '') AS blanks, count(DISTINCT trim(event_type)) AS types, count(*) FILTER (WHERE try_cast(value AS DOUBLE) IS NOT NULL) AS numbers FROM events")
def profile_nulls_uniques(spark, sf_dir):
    got = P.counts(table(spark, sf_dir, "events").select("value", "event_type"))
    return got.select("rows", F.col("0_blank").alias("blanks"), F.col("1_unique").alias("types"), F.col("0_number").alias("numbers"))


@query("SELECT trim(o_orderpriority) AS value, count(*) AS n FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def value_frequency(spark, sf_dir):
    return P.value_frequency(table(spark, sf_dir, "orders"), "o_orderpriority")


@query("SELECT count(*) AS rows, count(DISTINCT text) AS distinct_rows, count(*) - count(DISTINCT text) AS duplicates FROM documents")
def duplicate_rows(spark, sf_dir):
    return P.duplicate_rows(table(spark, sf_dir, "documents").select("text"))


@query("SELECT p_partkey, p_size - 10 AS gap FROM part WHERE p_size <= 10")
def low_stock(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("level", F.lit(10))
    return M.at_or_below(part, "p_size", "level", ["p_partkey"])


FENCES = """WITH o AS (SELECT *, (SELECT count(*) FROM orders) AS n FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice) - 1 AS i FROM orders)),
q AS (SELECT max(o_totalprice) FILTER (WHERE i = round((n - 1) * 0.25)) AS q1, max(o_totalprice) FILTER (WHERE i = round((n - 1) * 0.75)) AS q3 FROM o) """


@query("SELECT l_orderkey, l_linenumber, round(l_quantity * p_retailprice, 2) AS total FROM lineitem JOIN part ON l_partkey = p_partkey")
def derive_total(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    joined = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey").join(part, "l_partkey")
    return clean.derive_total(joined, "l_quantity", "p_retailprice").select("l_orderkey", "l_linenumber", F.round("total", 2).alias("total"))


@query("SELECT event_id, value AS even FROM events")
def coalesce_columns(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    split = e.select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("even"), F.when(F.col("event_id") % 2 != 0, F.col("value")).alias("odd"))
    return clean.coalesce_columns(split, "even", "odd")


SPACES = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
KEY = rf"""lower(regexp_replace(regexp_replace(translate(regexp_replace(regexp_replace(@, '{T.INVISIBLE}', '', 'g'), '{T.DIACRITICS}', '', 'g'),
  '{"".join(T.LETTER_FORMS)}{T.INDIC_DIGITS}{T.EXTENDED_DIGITS}{T.TATWEEL}', '{"".join(T.LETTER_FORMS.values())}{T.DIGITS}{T.DIGITS}'), '{SPACES}+', ' ', 'g'), '^{SPACES}+|{SPACES}+$', '', 'g'))"""


@query(f"SELECT doc_id, source FROM documents WHERE contains({KEY.replace('@', 'text')}, 'tion the') ORDER BY doc_id LIMIT 20 OFFSET 20")
def search_page(spark, sf_dir):
    found = browse.search(table(spark, sf_dir, "documents"), "  TION the", ["text"])
    return browse.page_of(browse.ordered(found.select("doc_id", "source"), "doc_id", tie_break=[]), 2, 20)


@query("SELECT * FROM part ORDER BY p_retailprice DESC NULLS LAST, p_partkey LIMIT 50 OFFSET 100")
def sort_page(spark, sf_dir):
    return browse.page_of(browse.ordered(table(spark, sf_dir, "part"), "p_retailprice", True, ["p_partkey"]), 3, 50)


@query(f"SELECT doc_id, md5({KEY.replace('@', 'text')}) AS key_md5 FROM documents")
def norm_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.search_key(F.col("text")).cast("binary")).alias("key_md5"))


INDIC = f"translate(o_orderkey::VARCHAR, '{T.DIGITS}', '{T.INDIC_DIGITS}')"


@query(f"SELECT o_orderkey, translate({INDIC} || '٫٥', '{T.INDIC_DIGITS}{T.DECIMAL_MARK}', '{T.DIGITS}.') AS digits, true AS indic FROM orders")
def western_digits(spark, sf_dir):
    s = F.concat(F.translate(F.col("o_orderkey").cast("string"), T.DIGITS, T.INDIC_DIGITS), F.lit("٫٥"))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.western_digits(s).alias("digits"), T.has_indic_digits(s).alias("indic"))


@query("SELECT c_custkey, regexp_replace(lower(c_name), '[-_\\s]+', '', 'g') AS key FROM customer")
def merge_key(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", T.merge_key(F.concat(F.lit(" "), F.upper("c_name")), fold=False).alias("key"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL WHEN o_orderkey % 4 = 2 THEN -round(o_totalprice, 2) ELSE round(o_totalprice, 2) END AS number FROM orders")
def parse_number(spark, sf_dir):
    n = F.format_number("o_totalprice", 2)
    kind = F.col("o_orderkey") % 4
    s = F.when(kind == 0, F.concat(n, F.lit(" ر.س"))).when(kind == 1, F.translate(n, T.DIGITS + ",", T.INDIC_DIGITS + T.THOUSANDS_MARK)).when(kind == 2, F.concat(F.lit("("), n, F.lit(")"))).otherwise(F.concat(F.lit("INV-"), n))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.parse_number(s).alias("number"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE o_orderdate::DATE END AS day FROM orders")
def parse_date(spark, sf_dir):
    d, kind = F.col("o_orderdate"), F.col("o_orderkey") % 4
    s = F.when(kind == 0, F.date_format(d, "yyyy-MM-dd")).when(kind == 1, F.date_format(d, "d/M/yyyy")).when(kind == 2, F.translate(F.date_format(d, "dd.MM.yyyy"), T.DIGITS, T.INDIC_DIGITS)).otherwise(F.date_format(d, "yyyy-MM"))
    day = F.when((kind == 1) & (F.dayofmonth(d) <= 12) & (F.month(d) > 12), F.to_date(d)).otherwise(T.parse_date(s))
    return table(spark, sf_dir, "orders").select("o_orderkey", day.alias("day"))


@query("SELECT c_custkey, c_custkey % 5 < 3 OR c_custkey % 5 = 4 AS blank, c_custkey % 5 = 3 AS zero_led FROM customer")
def is_blank(spark, sf_dir):
    kind = F.col("c_custkey") % 5
    s = F.when(kind == 0, F.lit(" N/A ")).when(kind == 1, F.lit("—")).when(kind == 2, F.lit(" ")).when(kind == 3, F.concat(F.lit("0"), F.col("c_custkey").cast("string")))
    return table(spark, sf_dir, "customer").select("c_custkey", T.is_blank(s).alias("blank"), F.coalesce(T.loses_leading_zero(s), F.lit(False)).alias("zero_led"))


@query("SELECT DISTINCT p_type, p_brand FROM part")
def trim_dedupe(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.concat(F.lit("  "), "p_type", F.lit("\t")).alias("p_type"), F.concat("p_brand", F.lit(" ")).alias("p_brand"))
    ops = [clean.Operation("trim_whitespace", ["p_type", "p_brand"], ""), clean.Operation("deduplicate_rows", [], "")]
    return clean.run(part, ops)


@query("SELECT p_type AS name, count(*) AS n FROM part GROUP BY 1")
def fuzzy_merge(spark, sf_dir):
    kind = F.col("p_partkey") % 11
    odd = F.when(kind == 0, F.lower("p_type")).when(kind == 1, F.replace("p_type", F.lit(" "), F.lit("-"))).otherwise(F.col("p_type"))
    part = table(spark, sf_dir, "part").select(odd.alias("name"), "p_type")
    known = part.groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))
    merged = clean.merge_entities(part.select("name"), ["name"], fold=False).groupBy(T.merge_key(F.col("name"), False).alias("key")).agg(F.count_distinct("name").alias("forms"), F.count(F.lit(1)).alias("n"))
    return merged.join(known.select(T.merge_key(F.col("p_type"), False).alias("key"), "p_type"), "key").where("forms = 1").select(F.col("p_type").alias("name"), "n")


@query("SELECT count(*) AS rows, count(*) AS numbers, count(*) AS dates, count(*) FILTER (WHERE o_totalprice = floor(o_totalprice)) AS whole, count(DISTINCT o_orderpriority) AS priorities FROM orders")
def infer_counts(spark, sf_dir):
    got = P.counts(table(spark, sf_dir, "orders").select(F.col("o_totalprice").cast("string").alias("a"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("b"), "o_orderpriority"))
    return got.select("rows", F.col("0_number").alias("numbers"), F.col("1_date").alias("dates"), F.col("0_whole").alias("whole"), F.col("2_unique").alias("priorities"))


@query("SELECT count(*) FILTER (WHERE l_extendedprice * p_retailprice <> 0 AND l_quantity IS NOT NULL) AS tested, count(*) FILTER (WHERE l_extendedprice <> 0 AND abs(l_quantity * p_retailprice - l_extendedprice) / abs(l_extendedprice) <= 0.02) AS equal FROM lineitem JOIN part ON l_partkey = p_partkey")
def cross_validate(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    df = table(spark, sf_dir, "lineitem").join(part, "l_partkey").select("l_quantity", "p_retailprice", "l_extendedprice")
    return meaning.product_ratio(df, df.columns).select(F.col("0_1_2_tested").alias("tested"), F.col("0_1_2_equal").alias("equal"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS \"p.k\" FROM events")
def json_flatten(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k STRING").alias("p"))
    return flattened(e).select(F.col("event_id").cast("long").alias("event_id"), "`p.k`")


SYNC = """WITH prev AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 10 = 4 THEN NULL ELSE p_retailprice END AS price, p_partkey % 10 <> 7 AS active FROM part WHERE p_partkey % 3 <> 0),
new AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN p_retailprice + 1 ELSE p_retailprice END AS price FROM part WHERE p_partkey % 4 <> 0),
j AS (SELECT n.k, n.price, p.k AS pk, p.price AS pprice, p.active AS pactive, p.k IS NOT NULL AND n.price IS DISTINCT FROM p.price AS changed FROM new n LEFT JOIN prev p ON n.k = p.k),
gone AS (SELECT * FROM prev WHERE k NOT IN (SELECT k FROM new)) """


def _sync(spark, sf_dir) -> catalog.Merge:
    part = table(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("string").alias("item_id")
    then, now = F.lit("2026-01-01 00:00:00").cast("timestamp"), F.lit("2026-01-02 00:00:00").cast("timestamp")
    prev = part.where("p_partkey % 3 <> 0").select(key, F.when(F.col("p_partkey") % 10 != 4, F.col("p_retailprice")).alias("price"), (F.col("p_partkey") % 10 != 7).alias("active"), then.alias("first_seen_at"), then.alias("last_seen_at"), F.lit(None).cast("timestamp").alias("price_changed_at"))
    items = part.where("p_partkey % 4 <> 0").select(key, F.when(F.col("p_partkey") % 5 == 0, F.col("p_retailprice") + 1).otherwise(F.col("p_retailprice")).alias("price"))
    return catalog.merge(prev, catalog.accept(items, "full"), now, "full")


@query(SYNC + "SELECT k::VARCHAR AS item_id, price, true AS active, CASE WHEN pk IS NULL THEN TIMESTAMP '2026-01-02' ELSE TIMESTAMP '2026-01-01' END AS first_seen_at, CASE WHEN changed THEN TIMESTAMP '2026-01-02' END AS price_changed_at FROM j UNION ALL SELECT k::VARCHAR, price, false, TIMESTAMP '2026-01-01', NULL FROM gone")
def catalog_merge_state(spark, sf_dir):
    return _sync(spark, sf_dir).state.select("item_id", "price", "active", "first_seen_at", "price_changed_at")


@query(SYNC + "SELECT k::VARCHAR AS item_id, pprice AS old_price, price AS new_price FROM j WHERE changed")
def catalog_price_changes(spark, sf_dir):
    return _sync(spark, sf_dir).price_changes.select("item_id", "old_price", "new_price")


@query(SYNC + "SELECT count(*) AS received, count(*) FILTER (WHERE pk IS NULL) AS added, count(*) FILTER (WHERE changed) AS price_changed, count(*) FILTER (WHERE pk IS NOT NULL AND NOT pactive) AS reactivated, (SELECT count(*) FROM gone WHERE active) AS removed, count(*) AS active_total FROM j")
def catalog_stats(spark, sf_dir):
    return _sync(spark, sf_dir).stats


@query("WITH l AS (SELECT user_id, max(ts) AS last_seen FROM events GROUP BY 1) SELECT user_id AS source, last_seen FROM l WHERE last_seen < (SELECT max(ts) FROM events) - INTERVAL 26 HOUR")
def stale_sources(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    now = e.agg(F.max("ts")).first()[0]
    return catalog.stale_sources(e, "user_id", "ts", F.lit(now))


@query("WITH l AS (SELECT user_id::VARCHAR AS source, ts AS since, coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY ts), (SELECT max(ts) FROM events)) AS upto, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS heard FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL), p AS (SELECT * FROM l WHERE upto > since + INTERVAL 26 HOUR) SELECT source, 'silent' AS kind, since, since + INTERVAL 26 HOUR AS at FROM p UNION ALL SELECT source, 'recovered', since, heard FROM p WHERE heard IS NOT NULL")
def silent_sources(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return silence.silences(e, "user_id", "ts", F.lit(e.agg(F.max("ts")).first()[0]))


CTE = "WITH t AS (SELECT l_returnflag, l_quantity, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS k FROM {0}) SELECT l_returnflag, sum(l_quantity) AS q FROM t WHERE k <= (SELECT max(l_linenumber) FROM {0}) GROUP BY l_returnflag"


@query(CTE.format("lineitem"))
def guarded_sql_cte(spark, sf_dir):
    return guard.guarded(table(spark, sf_dir, "lineitem"), CTE.format("dataset"))


@query("SELECT least(count(*), 10000) AS n FROM lineitem")
def guarded_limit(spark, sf_dir):
    return guard.guarded(table(spark, sf_dir, "lineitem"), "SELECT l_orderkey FROM dataset LIMIT ALL").agg(F.count(F.lit(1)).alias("n"))


ROLLUP = "SELECT l_returnflag AS flag, CAST(grouping(l_linestatus) AS BIGINT) AS g, count(*) AS n FROM {0} GROUP BY ROLLUP (l_returnflag, l_linestatus)"


@query(ROLLUP.format("lineitem"))
def guarded_rollup(spark, sf_dir):
    return guard.guarded(table(spark, sf_dir, "lineitem"), ROLLUP.format("dataset"))


@query("SELECT count(*) AS rows, count(*) FILTER (WHERE p_size % 7 = 0) AS no_stock, count(*) FILTER (WHERE p_retailprice = 0) AS no_price FROM part")
def inventory_zero_counts(spark, sf_dir):
    return M.conditions(table(spark, sf_dir, "part"), no_stock=F.col("p_size") % 7 == 0, no_price=F.col("p_retailprice") == 0)


@query(r"SELECT page_id, len(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<table\b.*?</table\s*>', ' ', 'gis'), '<script\b.*?</script\s*>', ' ', 'gis'), '<style\b.*?</style\s*>', ' ', 'gis'), '<[^>]*>', ' ', 'g'), '[^\s]+'))::INT AS words FROM pages")
def html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", narrative_words(F.col("html")).alias("words"))


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS window_start, date_trunc('hour', ts)::TIMESTAMP + INTERVAL 1 HOUR AS window_end, event_type, round(sum(value), 4) AS total, count(*) AS n, round(avg(value), 4) AS mean FROM events GROUP BY ALL")
def windowed_events(spark, sf_dir):
    return rounded(jobs.windowed(table(spark, sf_dir, "events"), "ts", "value", ["event_type"], "1 hour"), 4)


@query("WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, user_id, count(*) AS n FROM s GROUP BY user_id, k")
def session_events(spark, sf_dir):
    return jobs.sessions(table(spark, sf_dir, "events"), "ts", "user_id", "30 minutes")


@query("SELECT CASE l_returnflag WHEN 'A' THEN 'SYP' WHEN 'N' THEN 'USD' END AS currency_code, count(*) AS rows FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY 1")
def currency_labels(spark, sf_dir):
    label = F.when(F.col("l_returnflag") == "A", F.lit("ليرة سورية")).when(F.col("l_returnflag") == "N", F.lit("السعر بالدولار")).otherwise(F.lit("دينار"))
    out = currency_counts(table(spark, sf_dir, "lineitem").withColumn("label", label), "label")
    return out


@query("SELECT p_partkey AS label, round(sum(l_extendedprice), 2) AS value FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 25 GROUP BY 1 ORDER BY sum(l_extendedprice) DESC, 1 LIMIT 5")
def top_n_joined(spark, sf_dir):
    part = table(spark, sf_dir, "part").where("p_size > 25").select("p_partkey")
    return rounded(M.top_n(table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")), "l_extendedprice", "p_partkey", 5))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
