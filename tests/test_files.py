import csv
import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tabloom.plans.process import dashboard, load_run, process
from tabloom.sources import readers, records, sinks, sniff
from tabloom.sources.sniff import FileError
from tabloom.sources.xlsx import write_xlsx


def rows_of(df):
    return [tuple(r) for r in df.orderBy(readers.ROW).drop(readers.ROW).collect()]


def test_csv_with_title_rows_and_encoding(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_bytes("تقرير\n\nالصنف;الكمية;السعر\nقلم;3;1,5\nدفتر;4;2\n;;\n".encode("cp1256"))
    df, info = readers.read(spark, str(p))
    assert info.encoding == "cp1256" and info.delimiter == ";" and df.columns[:3] == ["الصنف", "الكمية", "السعر"]
    assert rows_of(df) == [("قلم", "3", "1,5"), ("دفتر", "4", "2")]


def test_csv_values_over_lines(spark, tmp_path):
    """Quoted line breaks, blank lines inside of values and between records, quotes inside of values, and too many fields."""
    p = tmp_path / "a.csv"
    p.write_text('a,b,c\n1,"x\ny",3\n4,z,6\n\n7,"say ""hi"",\n\nthen go",8\n9,5" pipe,10\n11,"p,\nq",12,13\n')
    df, info = readers.read(spark, str(p))
    assert rows_of(df) == [("1", "x\ny", "3"), ("4", "z", "6"), ("7", 'say "hi",\n\nthen go', "8"), ("9", '5" pipe', "10"), ("11", "p,\nq", "12")]
    assert len(info.warnings) == 1 and "[6]" in info.warnings[0]
    assert process(spark, str(p), str(tmp_path / "out")).table.count() == 5


def test_csv_open_quote(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('a,b\n1,"x\n2,y\n3,z\n')
    df, info = readers.read(spark, str(p))
    assert [r["a"] for r in df.orderBy(readers.ROW).collect()] == ["1", "2", "3"] and "never closed" in info.warnings[0]


@pytest.mark.parametrize("size", ["16", "70", "1000000"])
def test_records_over_byte_ranges(spark, tmp_path, size):
    """Wherever a file is cut, its records are those of a plain reader, and each is numbered by its place."""
    rng, p = random.Random(int(size)), tmp_path / "a.csv"
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        for trial in range(6):
            out = io.StringIO()
            csv.writer(out, lineterminator="\r\n" if trial % 2 else "\n").writerows([["".join(rng.choices('ab,"\n س', k=rng.randint(0, 12))) for _ in range(3)] for _ in range(rng.randint(1, 60))])
            p.write_bytes(out.getvalue().encode("cp1256" if trial == 2 else "utf-8"))
            got, closed = records.records(spark, str(p), ",", "cp1256" if trial == 2 else "utf-8")
            got = sorted(map(tuple, got.collect()))
            want = [r for r in csv.reader(io.StringIO(out.getvalue().replace("\r\n", "\n"))) if r]
            assert closed and [n for n, _ in got] == list(range(1, len(want) + 1))
            assert [next(csv.reader(io.StringIO(t))) for _, t in got] == want
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_html_keys_beside_nulls(spark):
    """Long keys stay what they are beside a null one."""
    page = "<table><tr><td>x</td></tr></table>"
    df = spark.createDataFrame([(9007199254740993, page), (None, page), (9007199254740995, page)], "k long, html string").coalesce(1)
    assert {r["key"] for r in readers.html_rows(df, "html", "k").collect()} == {9007199254740993, None, 9007199254740995}


def test_csv_ragged_and_repeated_headers(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('a,a,,d\n1,2,3,4\n5,"6,x",7,8\n1,2,3,4,9\n1,2\n')
    df, info = readers.read(spark, str(p))
    assert df.columns[:4] == ["a", "a_1", "عمود_3", "d"] and df.count() == 4
    assert len(info.warnings) == 1 and "[4]" in info.warnings[0]


def test_refused_files(spark, tmp_path):
    for name, data in {"e.csv": b"", "p.pdf": b"%PDF-1.4 x", "x.xls": b"\xd0\xcf\x11\xe0" + b"0" * 50, "t.txt": b"This is a long piece of prose that nobody should take for a table at all.\nAnd another such line of prose follows here, longer than the first.\n"}.items():
        (tmp_path / name).write_bytes(data)
        with pytest.raises(sniff.FileError):
            readers.read(spark, str(tmp_path / name))
    with pytest.raises(sniff.FileError):
        readers.read(spark, str(tmp_path / "none.csv"))


def test_size_bounds_only_what_one_task_holds(spark, tmp_path, monkeypatch):
    """Files that are read by byte ranges have no largest size; the others do."""
    monkeypatch.setattr(sniff, "MOST_BYTES", 20)
    (tmp_path / "a.csv").write_text("a,b\n" + "1,2\n" * 30)
    assert readers.read(spark, str(tmp_path / "a.csv"))[0].count() == 30
    (tmp_path / "b.csv").write_bytes(("الصنف,ب\n" + "قلم,2\n" * 30).encode("cp1256"))
    assert readers.read(spark, str(tmp_path / "b.csv"))[0].count() == 30
    (tmp_path / "c.csv").write_text("a,b\n" + "1,2\n" * 30, encoding="utf-16")
    (tmp_path / "d.html").write_text("<table><tr><td>a</td></tr><tr><td>1</td></tr></table>")
    for name in ("c.csv", "d.html"):
        with pytest.raises(FileError, match="over"):
            readers.read(spark, str(tmp_path / name))


def test_html_tables_of_many_pages_together():
    """What is open at the end of a page ends there; pages without rows have none."""
    pages = ["<table><tr><td>a<td>b", "text <table><script><tr><td>c</td></tr>", "<p>d</p>", "<table></table><table><tr><td></td></tr><tr><td>e</td><td> </td></tr><tr><td>f g"]
    got = readers.table_rows(pages)
    assert got[["page", "table_no", "row_no", "text"]].values.tolist() == [[0, 0, 0, ["a", "b"]], [3, 1, 0, ["e", ""]], [3, 1, 1, ["f g"]]]
    assert len(readers.table_rows([])) == 0


def test_json_envelope(spark, tmp_path):
    p = tmp_path / "a.json"
    p.write_text(json.dumps({"warehouse": "W1", "sales": [{"sku": "1", "qty": 2, "tags": ["a", None, "b"], "o": {"x": 1}}, {"sku": "2", "price": "N/A"}]}))
    df, _ = readers.read(spark, str(p))
    got = {r["sku"]: r for r in df.collect()}
    assert got["1"]["warehouse"] == "W1" and got["1"]["tags"] == "a, , b" and got["1"]["o.x"] == "1" and got["2"]["qty"] is None
    p.write_text(json.dumps([{"a": {"b": {"c": 1}}}]))
    with pytest.raises(sniff.FileError):
        readers.read(spark, str(p))


@pytest.mark.parametrize("size", ["16", "70", "1000000"])
def test_json_over_byte_ranges(spark, tmp_path, size):
    """Wherever a file is cut, its records are those of a plain parser, in order; brackets in strings are letters."""
    rng, p = random.Random(int(size)), tmp_path / "a.json"
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        for trial in range(2):
            items = [{"a": str(i), "b": "".join(rng.choices('x{}[]"\\, س', k=rng.randint(1, 9))) + "."} for i in range(rng.randint(2, 12))]
            p.write_text(json.dumps(items if trial else {"w": 1.50, "few": [{"z": 1}], "s": "]}", "items": items}, indent=trial or None, ensure_ascii=False))
            df, info = readers.read(spark, str(p))
            got = df.orderBy(readers.ROW).collect()
            assert [(r["a"], r["b"]) for r in got] == [(x["a"], x["b"]) for x in items]
            assert trial or got[0]["w"] == "1.5" and got[0]["s"] == "]}" and info.warnings == ["list few is left out"]
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    for broken in ('[{"a":1},]', '[{"a":1} {"a":2}]', '[{"a":1},{"a":2'):
        p.write_text(broken)
        with pytest.raises(FileError):
            readers.read(spark, str(p))


def test_xml_and_html(spark, tmp_path):
    x = tmp_path / "a.xml"
    x.write_text('<r><meta>1</meta><sale id="1"><qty>2</qty></sale><sale id="2"><qty>-3</qty></sale></r>')
    df, info = readers.read(spark, str(x))
    assert info.row_tag == "sale" and sorted((r["id"], r["qty"]) for r in df.collect()) == [("1", "2"), ("2", "-3")]
    h = tmp_path / "a.html"
    h.write_text("<html><table><tr><td>x</td></tr></table><table><tr><th>a</th><th>b</th></tr><tr><td>1 <b>2</b></td><td><script>no</script>3</td></tr><tr><td></td><td></td></tr></table></html>")
    df, _ = readers.read(spark, str(h))
    assert rows_of(df) == [("1 2", "3")] and df.columns[:2] == ["a", "b"]


def test_xlsx_round_trip(spark, tmp_path):
    p = tmp_path / "a.xlsx"
    df = spark.createDataFrame([("قلم <x>", 1.5, 7), (None, 2.0, 8)], "name string, price double, n int").coalesce(1)
    write_xlsx(df, p)
    back, _ = readers.read(spark, str(p))
    assert rows_of(back) == [("قلم <x>", "1.5", "7"), (None, "2", "8")]
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x", b"0" * 5_000_000)
    with pytest.raises(Exception, match="unpacks"):
        readers.read(spark, str(tmp_path / "b.xlsx"))


def test_csv_export_has_mark(spark, tmp_path):
    sinks.write_csv(spark.createDataFrame([("أ", 1)], "a string, b int").coalesce(1), str(tmp_path / "out"))
    part = next((tmp_path / "out").glob("part-*"))
    assert part.read_bytes().startswith(b"\xef\xbb\xbfa,b")


def test_process(spark, tmp_path):
    p = tmp_path / "sales.csv"
    lines = ["رقم الفاتورة,التاريخ,المنتج,الكمية,سعر الوحدة,الإجمالي"]
    names = ["قلم رصاص", "دفتر", "ممحاة", "مسطرة"]
    for i in range(120):
        q, price = i % 9 + 1, [1250.0, 380.0, 90.0, 2200.0][i % 4]
        lines.append(f'INV-{i},{i % 28 + 1:02d}/{i % 8 + 1:02d}/2026,{names[i % 4]},{q},"{price:,.2f} ر.س","{q * price:,.2f}"')
    lines += lines[1:4]
    p.write_text("\n".join(lines), encoding="utf-8")
    stages = []
    run = process(spark, str(p), str(tmp_path / "out"), on_progress=stages.append)
    assert run.table.count() == 120 and run.profile.duplicates == 3 and len(stages) == 8
    assert run.schema.name_of("total_amount") == "الإجمالي" and run.schema.currency.codes == ["SAR"]
    want = sum((i % 9 + 1) * [1250.0, 380.0, 90.0, 2200.0][i % 4] for i in range(120))
    assert run.table.agg(F.sum("`الإجمالي`")).first()[0] == want
    board = dashboard(run)
    assert board["kpis"]["total_amount"] == want and [c.kind for c in board["charts"]] == ["bar", "donut", "histogram"]
    assert json.loads(json.dumps(run.artifacts()))["recipe"]
    again = load_run(spark, str(tmp_path / "out"))
    assert again.artifacts() == run.artifacts() and again.table.count() == 120 and dashboard(again)["kpis"] == board["kpis"]


def test_gzip(spark, tmp_path):
    import gzip

    p = tmp_path / "a.csv.gz"
    p.write_bytes(gzip.compress(b"name,n\nx,1\ny,2\n"))
    df, _ = readers.read(spark, str(p))
    assert rows_of(df) == [("x", "1"), ("y", "2")]


def test_declared_encodings(spark, tmp_path):
    """What a page declares is taken before guessing, if the page can be read in it."""
    page = '<html><meta charset="windows-1256"><table><tr><td>اسم</td><td>n</td></tr><tr><td>قلم</td><td>1</td></tr></table></html>'
    p = tmp_path / "a.html"
    p.write_bytes(page.encode("cp1256"))
    df, info = readers.read(spark, str(p))
    assert info.encoding == "cp1256" and rows_of(df) == [("قلم", "1")]
    assert sniff.encoding_of(b"<meta charset='latin-1'>caf\xe9") == "iso8859-1"
    assert sniff.encoding_of("<meta charset=ascii>é".encode()) == "utf-8" and sniff.encoding_of(b"charset=nonsense") == "utf-8"
    assert sniff.encoding_of("charset=utf-8 é".encode()[:-1]) == "utf-8"


def test_merged_columns_are_told(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("الإجمالي,المبلغ,name\n" + "\n".join(f"{i},,a{i}" if i % 2 else f",{i},b{i}" for i in range(30)))
    run = process(spark, str(p), str(tmp_path / "out"))
    assert len([w for w in run.info.warnings if "merged" in w]) == 1 and "المبلغ" not in run.table.columns


ODD_XML = """<?xml version="1.0"?>
<!DOCTYPE r>
<r note='a > b "'><!-- <sale> > --><head>%s</head>
<sales><?x <sale> > ?>
%s</sales><more><x/></more></r>
"""


def test_xml_records_over_byte_ranges(spark, tmp_path):
    """Records that begin after the first 64 KB, in ranges that begin in comments, CDATA, quotes, tags and records."""
    one = lambda i: f"<sale id='{i}' k=\"a&gt;>{i}'\"><!-- > </sale> --><qty>{i % 7}</qty>\n<t><![CDATA[<b> > {i}]]> &amp; é</t><none/></sale>"
    p = tmp_path / "odd.xml"
    p.write_text(ODD_XML % ("x" * 70_000, "\n".join(map(one, range(300)))))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    want = [(i + 1, str(i), f"a>>{i}'", str(i % 7), f"<b> > {i} & é") for i in range(300)]
    try:
        for size in (77, 1000, 1 << 27):
            if size == 77:  # many ranges: fewer records
                q = tmp_path / "small.xml"
                q.write_text(ODD_XML % ("x", "\n".join(map(one, range(12)))))
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", 0)
            df, info = readers.read(spark, str(q if size == 77 else p))
            got = sorted(map(tuple, df.select(readers.ROW, "id", "k", "qty", "t").collect()))
            assert info.row_tag == "sale" and got == (want[:12] if size == 77 else want), size
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_xml_shapes(spark, tmp_path):
    def read(text):
        p = tmp_path / "s.xml"
        p.write_text(text)
        df, info = readers.read(spark, str(p))
        return info.row_tag, [tuple(r) for r in df.drop(readers.ROW).orderBy(df[readers.ROW]).collect()]

    assert read('<r><a><s>1</s></a><b><s x="2"/><s x="3"/><t/></b><c><u v="4"/><u v="5"/><u v="6"/></c></r>') == ("s", [("2",), ("3",)])
    assert read("<r><s><q>1</q><q>2</q></s><s><q>3</q></s></r>") == ("s", [("2",), ("3",)])
    for text, why in (
        ("<r><s><q>1</q></s><s><p>1</p></s></r>", "different fields"),
        ("<r><s><q><w>1</w></q></s><s><q>1</q></s></r>", "nested"),
        ("<r><s><q>1</q></s><s><q>1</q></s>", "not closed"),
        ("<r><s a='1'><q>1</q></s><s a='2><q>1</q></s></r>", "broken"),
        ("<r><s><q>1</p></s><s><q>1</q></s></r>", "can't be read"),
        ("<r><s>1</s><t>2</t></r>", "no element repeats"),
        ("<r><s/><s/></r>", "no fields"),
    ):
        with pytest.raises(FileError, match=why):
            read(text)
