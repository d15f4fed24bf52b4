"""Spreadsheets by the open packaging format: a zip of XML, read and written without other libraries."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _reference(row: int, col: int) -> str:
    letters, n = "", col + 1
    while n:
        n, r = divmod(n - 1, 26)
        letters = chr(65 + r) + letters
    return f"{letters}{row + 1}"


def sheet_rows(content: bytes) -> list[list[str | None]]:
    """Cells of the first sheet as strings; what is not there is None."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        strings = []
        if "xl/sharedStrings.xml" in names:
            strings = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_NS}si")]
        first = min((n for n in names if re.fullmatch(r"xl/worksheets/sheet[0-9]+\.xml", n)), key=lambda n: int(re.search("[0-9]+", n)[0]))
        out: list[list[str | None]] = []
        for row in ElementTree.fromstring(z.read(first)).iter(f"{_NS}row"):
            cells: list[str | None] = []
            for k, c in enumerate(row.iter(f"{_NS}c")):
                at = _column(c.get("r")) if c.get("r") else k
                cells += [None] * (at + 1 - len(cells))
                kind, v = c.get("t"), c.find(f"{_NS}v")
                if kind == "inlineStr":
                    cells[at] = "".join(t.text or "" for t in c.iter(f"{_NS}t"))
                elif v is not None and v.text is not None:
                    cells[at] = strings[int(v.text)] if kind == "s" else v.text
            out.append(cells)
        return out


def sheet_bytes(header: Sequence[str], rows: Sequence[Sequence[object]]) -> bytes:
    """A workbook of one sheet; strings inline, numbers as numbers, None empty."""

    def cell(r: int, c: int, v: object) -> str:
        if v is None or v != v:
            return ""
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f'<c r="{_reference(r, c)}"><v>{v}</v></c>'
        return f'<c r="{_reference(r, c)}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    body = "".join(f'<row r="{r + 1}">{"".join(cell(r, c, v) for c, v in enumerate(x))}</row>' for r, x in enumerate([header, *rows]))
    main = _NS[1:-1]
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{_OFFICE}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, xml in parts.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + xml)
    return out.getvalue()


def read_sheets(spark: SparkSession, folder: str, columns: Sequence[str], pattern: str = "*.xlsx") -> DataFrame:
    """First sheets of a folder's workbooks, with file name and row number; one task a file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")
    schema = "file string, row_index long, " + ", ".join(f"`{c}` string" for c in columns)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, content in zip(f.path, f.content):
                header, *rows = sheet_rows(bytes(content)) or [[]]
                at = {n: i for i, n in enumerate(header)}
                pick = lambda r, c: r[at[c]] if c in at and at[c] < len(r) else None
                yield pd.DataFrame({"file": path.rsplit("/", 1)[-1], "row_index": range(1, len(rows) + 1), **{c: [pick(r, c) for r in rows] for c in columns}})

    return files.mapInPandas(run, schema)


#: Rows of one workbook; a file of this kind holds a million at most.
SHEET_ROWS = 50_000


def write_sheets(df: DataFrame, path: str, order: Sequence[str], rows: int = SHEET_ROWS) -> None:
    """A table for annotators as workbooks of bounded size, each an executor's own file: ``name`` and ``content`` as parquet.

    ``order`` gives the rows' order inside a workbook.
    """
    columns = df.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        number = 0
        for f in frames:
            for at in range(0, len(f), rows):
                held.append(f.iloc[at : at + rows])
                if sum(map(len, held)) >= rows:
                    whole = pd.concat(held)
                    yield pd.DataFrame({"name": [f"{number:05d}.xlsx"], "content": [sheet_bytes(columns, whole.iloc[:rows].astype(object).where(whole.iloc[:rows].notna(), None).values.tolist())]})
                    number += 1
                    held = [whole.iloc[rows:]]
        last = pd.concat(held) if held else None
        if last is not None and len(last):
            yield pd.DataFrame({"name": [f"{number:05d}.xlsx"], "content": [sheet_bytes(columns, last.astype(object).where(last.notna(), None).values.tolist())]})

    df.sortWithinPartitions(*order).mapInPandas(run, "name string, content binary").write.mode("overwrite").parquet(path)
