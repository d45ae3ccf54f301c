import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabloom.operators import browse, indexed


@pytest.fixture(scope="module")
def table(spark):
    word = F.element_at(F.array(*[F.lit(x) for x in ("مؤسسة النور", "Blue Pen", "paper A4", "قلم رصاص", "ruler")]), (F.pmod(F.xxhash64("id"), F.lit(5)) + 1).cast("int"))
    # rare words cluster in one part of the table, as batches of arrivals do
    text = F.when(F.col("id").between(7000, 7009), F.concat(F.lit("Zebra  Crossing "), F.col("id").cast("string"))).otherwise(F.concat(word, F.lit(" "), F.col("id").cast("string")))
    return spark.range(20_000).select(F.col("id"), text.alias("name"), F.when(F.col("id") % 7 != 0, (F.col("id") % 100).cast("double")).alias("v"), F.lit(None).cast("string").alias("none")).repartition(3, "id")


def test_search_reads_candidate_ranges_only(spark, table, tmp_path):
    path = str(tmp_path / "t")
    indexed.write_indexed(table.orderBy("id"), path, rows=500)
    key = lambda df: sorted(r["id"] for r in df.collect())
    for text in ("zebra crossing", "ZEBRA   cross", "موسسه النور 19", "pen 1234", "a4 777", "nothing like it", "ze", "", "ruler", "13.0", "ruler 4"):
        assert key(indexed.search_indexed(spark, path, text)) == key(browse.search(table, text)), text
    assert indexed.candidate_ranges(spark, path, "zebra crossing") == [14]
    assert indexed.candidate_ranges(spark, path, "nothing like it") == [] and indexed.candidate_ranges(spark, path, "ze") is None
    plan = indexed.search_indexed(spark, path, "zebra crossing")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(__range, [14])]" in plan or "EqualTo(__range,14)" in plan


def test_deep_pages_read_one_range(spark, table, tmp_path):
    for descending in (False, True):
        path = str(tmp_path / f"o{descending}")
        indexed.write_order_index(table, path, "v", descending, ["id"], ranges=40)
        want = [r.asDict() for r in browse.ordered(table, "v", descending, ["id"]).collect()]
        for page, size in ((1, 20), (2, 200), (500, 20), (1000, 20), (1001, 20), (77, 13)):
            rows, total, read = indexed.page_rows(spark, path, page, size)
            assert [r.asDict() for r in rows.collect()] == want[(page - 1) * size : page * size] and total == 20_000
            assert len(read) <= 2 and (page < 1001 or not read)
        got = indexed.browse_order(spark, path, 1000, 20)
        assert got.pages == 1000 and got.rows == want[-20:] and all(r["v"] is None for r in got.rows)


def test_empty_tables(spark, table, tmp_path):
    empty = table.limit(0)
    indexed.write_indexed(empty, str(tmp_path / "a"))
    assert indexed.search_indexed(spark, str(tmp_path / "a"), "zebra").count() == 0
    indexed.write_order_index(empty, str(tmp_path / "b"), "v")
    assert indexed.browse_order(spark, str(tmp_path / "b")).pages == 1


def test_trigrams_of_ranges():
    """Trigrams are of code points, each once in a range, none over the end of a text or a column."""
    batch = pa.RecordBatch.from_pydict({"part": [0, 0, 1], "a": ["abca", "b", "\U0001d54f\u0645z\0"], "b": ["cab", "", "xy"]})
    got = [(p, g) for b in indexed.grams_of_ranges(iter([batch])) for p, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
    assert sorted(got) == sorted([(0, "abc"), (0, "bca"), (0, "cab"), (1, "\U0001d54f\u0645z"), (1, "\u0645z\0")])
