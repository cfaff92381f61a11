"""Spreadsheet archives made from a table, so that reading them can be checked."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence
from xml.sax.saxutils import escape

import pandas as pd
from pyspark import TaskContext

_MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def workbook(headers: Sequence, rows: Sequence[Sequence]) -> bytes:
    """An XLSX with an empty first sheet and the rows on the second, which is active.

    Text of the first column goes through shared strings, other text is inline. A value
    given as (number, style) gets that cell style; style 1 is a date.
    """
    shared: dict[str, int] = {}

    def cell(column: int, row: int, value) -> str:
        name = f"{chr(65 + column)}{row}"
        if value is None:
            return ""
        if isinstance(value, tuple):
            return f'<c r="{name}" s="{value[1]}"><v>{value[0]}</v></c>'
        if isinstance(value, bool):
            return f'<c r="{name}" t="b"><v>{int(value)}</v></c>'
        if isinstance(value, str) and column == 0:
            return f'<c r="{name}" t="s"><v>{shared.setdefault(value, len(shared))}</v></c>'
        if isinstance(value, str):
            return f'<c r="{name}" t="inlineStr"><is><t>{escape(value)}</t></is></c>'
        return f'<c r="{name}"><v>{value!r}</v></c>'

    lines = []
    for number, row in enumerate([headers, *rows], start=1):
        if row is not None:
            cells = "".join(cell(i, number, value) for i, value in enumerate(row))
            lines.append(f'<row r="{number}">{cells}</row>')
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr(
            "xl/workbook.xml",
            f'<workbook {_MAIN} xmlns:r="{_REL}"><bookViews><workbookView activeTab="1"/></bookViews>'
            '<sheets><sheet name="a" sheetId="1" r:id="rId1"/><sheet name="b" sheetId="2" r:id="rId2"/>'
            "</sheets></workbook>",
        )
        book.writestr(
            "xl/_rels/workbook.xml.rels",
            '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
            '<Relationship Id="rId1" Target="worksheets/sheet1.xml"/>'
            '<Relationship Id="rId2" Target="/xl/worksheets/sheet2.xml"/></Relationships>',
        )
        book.writestr(
            "xl/styles.xml",
            f'<styleSheet {_MAIN}><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
        )
        book.writestr("xl/worksheets/sheet1.xml", f"<worksheet {_MAIN}><sheetData/></worksheet>")
        book.writestr(
            "xl/worksheets/sheet2.xml",
            f"<worksheet {_MAIN}><sheetData>{''.join(lines)}</sheetData></worksheet>",
        )
        strings = "".join(f"<si><r><t>{escape(s)}</t></r></si>" for s in shared)
        book.writestr("xl/sharedStrings.xml", f"<sst {_MAIN}>{strings}</sst>")
    return out.getvalue()


def archive(members: dict[str, bytes]) -> bytes:
    """A ZIP of the given members."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as packed:
        for name, content in members.items():
            packed.writestr(name, content)
    return out.getvalue()


ARCHIVE = "path STRING, content BINARY"


def customer_archives(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One archive per Arrow batch of customers, in two workbooks and a note."""
    headers = ["FULLADRESS", "DEALAMOUNT", "GUSH", None, "GUSH"]
    task = TaskContext.get()
    for number, batch in enumerate(batches):
        rows = [
            (name, key, "old", "no header", segment)
            for key, name, segment in batch.itertuples(index=False)
        ]
        middle = len(rows) // 2
        content = archive(
            {
                "first.xlsx": workbook(headers, rows[:middle]),
                "notes.txt": b"not a workbook",
                "SECOND.XLSX": workbook(headers, rows[middle:]),
            }
        )
        name = f"customers-{task.partitionId() if task else 0}-{number}.zip"
        yield pd.DataFrame([(name, content)], columns=["path", "content"])
