"""Workbooks as a Spark data source, and a writer of small ones, with the standard library alone."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from pathlib import Path
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
MOST_RATIO, MOST_ROWS = 100, 100_000


def opened(path: str) -> zipfile.ZipFile:
    """The archive, refused when broken or when it unpacks to over MOST_RATIO times its size."""
    path = re.sub("^file:(//)?", "", path)
    try:
        archive = zipfile.ZipFile(path)
    except zipfile.BadZipFile as error:
        raise ValueError("the workbook is broken") from error
    packed, unpacked = (sum(getattr(i, k) for i in archive.infolist()) for k in ("compress_size", "file_size"))
    if unpacked > MOST_RATIO * max(packed, 1):
        raise ValueError("the workbook unpacks to far more than its size")
    return archive


def sheets(archive: zipfile.ZipFile) -> dict[str, str]:
    """The file of each sheet, in order."""
    links = {r.get("Id"): r.get("Target") for r in ET.fromstring(archive.read("xl/_rels/workbook.xml.rels"))}
    book = ET.fromstring(archive.read("xl/workbook.xml"))
    path = lambda t: t.lstrip("/") if t.startswith("/") else f"xl/{t}"
    return {s.get("name"): path(links[s.get(f"{REL}id")]) for s in book.iter(f"{MAIN}sheet")}


def column_of(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_rows(archive: zipfile.ZipFile, name: str) -> Iterator[list[str | None]]:
    """The rows of a sheet as text, read as a stream."""
    shared: list[str] = []
    if "xl/sharedStrings.xml" in archive.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in ET.fromstring(archive.read("xl/sharedStrings.xml"))]
    with archive.open(name) as f:
        for _, row in ET.iterparse(f):
            if row.tag != f"{MAIN}row":
                continue
            cells: list[str | None] = []
            for at, c in enumerate(row.iter(f"{MAIN}c")):
                at = column_of(c.get("r")) if c.get("r") else at
                cells += [None] * (at + 1 - len(cells))
                v = c.find(f"{MAIN}v")
                if c.get("t") == "s" and v is not None:
                    cells[at] = shared[int(v.text)]
                elif c.get("t") == "inlineStr":
                    cells[at] = "".join(t.text or "" for t in c.iter(f"{MAIN}t"))
                elif v is not None and v.text is not None:
                    cells[at] = re.sub(r"^(-?\d+)\.0$", r"\1", v.text)
            yield cells
            row.clear()


class XlsxReader(DataSourceReader):
    def __init__(self, path: str, sheet: str):
        self.path, self.sheet = path, sheet

    def partitions(self) -> list[InputPartition]:
        with opened(self.path) as archive:
            known = sheets(archive)
            if self.sheet:
                return [InputPartition(known[self.sheet])]

            def size(name: str) -> int:
                rows = [len(r) for r in sheet_rows(archive, name)]
                return len(rows) * max(rows, default=0)

            return [InputPartition(max(known.values(), key=size))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with opened(self.path) as archive:
            for i, cells in enumerate(sheet_rows(archive, partition.value)):
                yield i, cells


class XlsxSource(DataSource):
    """Rows of one sheet (option sheet; by default the largest): row_no and cells."""

    @classmethod
    def name(cls) -> str:
        return "tabloom_xlsx"

    def schema(self) -> str:
        return "row_no int, cells array<string>"

    def reader(self, schema) -> DataSourceReader:
        return XlsxReader(self.options["path"], self.options.get("sheet", ""))


def column_name(i: int) -> str:
    return (column_name(i // 26 - 1) if i >= 26 else "") + chr(65 + i % 26)


def write_xlsx(df: DataFrame, path: str | Path) -> None:
    """df as a workbook of one sheet; refused above MOST_ROWS rows. Rows pass through the driver one partition at a time."""
    if df.limit(MOST_ROWS + 1).count() > MOST_ROWS:
        raise ValueError(f"a workbook takes at most {MOST_ROWS} rows; write CSV instead")

    def cell(ref: str, v) -> str:
        if v is None:
            return ""
        if isinstance(v, bool) or not isinstance(v, (int, float)):
            return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'
        return f'<c r="{ref}"><v>{v!r}</v></c>'

    def row(n: int, values) -> str:
        return f'<row r="{n}">' + "".join(cell(f"{column_name(i)}{n}", v) for i, v in enumerate(values)) + "</row>"

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rels = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rels}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rels}"><sheets><sheet name="data" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rels}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        with z.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(f"<worksheet {ns}><sheetData>".encode() + row(1, df.columns).encode())
            for n, r in enumerate(df.toLocalIterator(), 2):
                f.write(row(n, r).encode())
            f.write(b"</sheetData></worksheet>")
