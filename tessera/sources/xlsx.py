"""Workbooks, by the standard library: sheets read on the executors, reports written row by row."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
MAX_ROWS = 1_048_576  # of a sheet, by the format


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref).group():
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_rows(data: bytes) -> Iterable[list[str | None]]:
    """Cells of the first sheet's rows as text, empty ones null."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in item.iter(f"{MAIN}t")) for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")]
        first = sorted((n for n in book.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n).group()))[0]
        for _, row in ElementTree.iterparse(book.open(first)):
            if row.tag != f"{MAIN}row":
                continue
            cells = {}
            for k, cell in enumerate(row.iter(f"{MAIN}c")):
                kind, value = cell.get("t"), cell.find(f"{MAIN}v")
                text = "".join(t.text or "" for t in cell.iter(f"{MAIN}t")) if kind == "inlineStr" else None if value is None else value.text
                cells[_column(cell.get("r")) if cell.get("r") else k] = shared[int(text)] if kind == "s" else text
            yield [cells.get(i) for i in range(max(cells, default=-1) + 1)]
            row.clear()


def read_sheet(spark: SparkSession, path) -> DataFrame:
    """First sheets under their header row; all workbooks have the first one's columns. A workbook is
    read by one task: the format allows no more than 1,048,576 rows."""
    files = spark.read.format("binaryFile").load(path)
    header = next(iter(sheet_rows(bytes(files.orderBy("path").select("content").first()[0]))), [])
    names = [h for h in header if h]

    @F.udf("array<array<string>>")
    def body(data):
        rows = sheet_rows(bytes(data))
        head = next(iter(rows), [])
        at = [head.index(n) if n in head else None for n in names]
        return [[r[i] if i is not None and i < len(r) else None for i in at] for r in rows]

    return files.select(F.explode(body("content")).alias("row")).select(*(F.col("row")[i].alias(n) for i, n in enumerate(names)))


def _cell(value, style: int) -> str:
    if value is None:
        return f'<c s="{style}"/>'
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return f'<c s="{style}"><v>{value}</v></c>'
    text = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(value))  # XML has no way to write these
    return f'<c s="{style}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def write_report(rows: DataFrame, target, widths: list[int], summary: Iterable[tuple] = ()) -> None:
    """One workbook for a reader: a bold centred header, wrapped cells, and the summary rows after two
    blank ones. ``target``: a path or file of the caller's. Rows stream through the driver one partition
    at a time; more than a sheet holds raise ValueError."""
    parts = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/></Types>',
        "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="report" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": '<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf applyAlignment="1"><alignment wrapText="1" vertical="top"/></xf><xf fontId="1" applyFont="1" applyAlignment="1"><alignment horizontal="center"/></xf></cellXfs></styleSheet>',
    }
    summary = list(summary)
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in parts.items():
            book.writestr(name, text)
        with book.open("xl/worksheets/sheet1.xml", "w") as sheet:
            put = lambda text: sheet.write(text.encode())
            row = lambda cells, style=0: put("<row>" + "".join(_cell(c, style) for c in cells) + "</row>")
            cols = "".join(f'<col min="{i}" max="{i}" width="{w}" customWidth="1"/>' for i, w in enumerate(widths, 1))
            put(f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><cols>{cols}</cols><sheetData>')
            row(rows.columns, 1)
            for n, record in enumerate(rows.toLocalIterator(), 2):
                if n + 2 + len(summary) > MAX_ROWS:
                    raise ValueError("more rows than a sheet holds")
                row(record)
            if summary:
                row([]), row([])
                for line in summary:
                    row(line)
            put("</sheetData></worksheet>")
