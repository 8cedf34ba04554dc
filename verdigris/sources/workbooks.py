"""Excel workbooks, read and written with the standard library: a workbook is a zip of XML parts."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Mapping
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
CELL_LIMIT, NAME_LIMIT, ROW_LIMIT = 32_767, 31, 1_048_575
#: Widths of columns, in characters.
NARROWEST, WIDEST = 8, 60


def _column(k: int) -> str:
    """Letters of a column from 0: A to Z, AA and on."""
    name = ""
    while k >= 0:
        k, letter = divmod(k, 26)
        name, k = chr(65 + letter) + name, k - 1
    return name


def _index(reference: str) -> int:
    letters = re.match("[A-Z]+", reference)[0]
    out = 0
    for c in letters:
        out = out * 26 + ord(c) - 64
    return out - 1


def sheet_rows(content: bytes) -> list[list[str | None]]:
    """The cells of a workbook's first sheet as text; rows are as long as their last cell."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        text = lambda node: "".join(t.text or "" for t in node.iter(f"{{{MAIN}}}t"))
        shared = [text(s) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
        first = ElementTree.fromstring(z.read("xl/workbook.xml")).find(f"{{{MAIN}}}sheets")[0].get(f"{{{REL}}}id")
        target = next(r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")) if r.get("Id") == first)
        sheet = ElementTree.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    rows = []
    for row in sheet.iter(f"{{{MAIN}}}row"):
        cells: dict[int, str | None] = {}
        for cell in row:
            value, kind = cell.find(f"{{{MAIN}}}v"), cell.get("t")
            told = text(cell) if kind == "inlineStr" else None if value is None else shared[int(value.text)] if kind == "s" else value.text
            cells[_index(cell.get("r")) if cell.get("r") else len(cells)] = told
        rows.append([cells.get(k) for k in range(max(cells, default=-1) + 1)])
    return rows


def read_workbooks(spark: SparkSession, path: str, columns: list[str], needed: str | None = None) -> DataFrame:
    """path, row_no and the named columns of the first sheet of each workbook, as strings.

    The first row is the header; names are met without blanks at their ends and
    case aside.  A workbook that cannot be read gives no rows.  With `needed`,
    rows where that column is null or blank are left out.  One task reads one
    workbook, which fits in its memory by the format's own limit.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for where, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    head, *body = sheet_rows(bytes(content)) or [[]]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, IndexError, StopIteration, TypeError, ValueError):
                    continue
                at = {(h or "").strip().lower(): k for k, h in reversed(list(enumerate(head)))}
                places = [at.get(c.lower()) for c in columns]
                yield pd.DataFrame([(where, n, *[r[k] if k is not None and k < len(r) else None for k in places]) for n, r in enumerate(body)], columns=["path", "row_no", *columns])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    out = files.mapInPandas(read, f"path string, row_no int, {', '.join(f'`{c}` string' for c in columns)}")
    return out.where(F.trim(F.col(f"`{needed}`")) != "") if needed else out


def _cell(reference: str, value: object, style: int) -> str:
    if value is None or isinstance(value, float) and value != value:
        return ""
    if isinstance(value, bool):
        return f'<c r="{reference}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, int | float):
        return f'<c r="{reference}"><v>{value}</v></c>'
    told = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(value))[:CELL_LIMIT]
    return f'<c r="{reference}" t="inlineStr" s="{style}"><is><t xml:space="preserve">{escape(told)}</t></is></c>'


def _sheet(names: list[str], rows: list[tuple]) -> str:
    shown = [max([len(n), *[len(str(r[k])) for r in rows if r[k] is not None]]) + 2 for k, n in enumerate(names)]
    widths = "".join(f'<col min="{k + 1}" max="{k + 1}" width="{min(max(w, NARROWEST), WIDEST)}" customWidth="1"/>' for k, w in enumerate(shown))
    lines = [f'<row r="{n}">{"".join(_cell(f"{_column(k)}{n}", v, int(n == 1)) for k, v in enumerate(r))}</row>' for n, r in enumerate([tuple(names), *rows], 1)]
    frozen = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>'
    return f'<worksheet xmlns="{MAIN}">{frozen}<cols>{widths}</cols><sheetData>{"".join(lines)}</sheetData></worksheet>'


def _sheet_names(wanted: list[str]) -> list[str]:
    """Names that the format takes: without its signs, cut, and each once."""
    out: list[str] = []
    for name in wanted:
        base = re.sub(r"[\[\]:*?/\\]", "_", name)[:NAME_LIMIT] or "sheet"
        k, free = 2, base
        while free.lower() in [o.lower() for o in out]:
            free = f"{base[: NAME_LIMIT - len(str(k)) - 1]}~{k}"
            k += 1
        out.append(free)
    return out


def workbook(sheets: Mapping[str, DataFrame], most: int = ROW_LIMIT) -> bytes:
    """Small aggregated reports as one workbook: a sheet each, a bold header that stays in view, columns as wide as what they hold.

    `most` is the number of rows that a sheet can have; a report beyond it
    fails, and nothing is cut.
    """
    parts: dict[str, str] = {}
    for n, df in enumerate(sheets.values(), 1):
        rows = [tuple(r) for r in df.limit(most + 1).collect()]
        if len(rows) > most:
            raise ValueError(f"a report of more than {most} rows does not fit a sheet")
        parts[f"xl/worksheets/sheet{n}.xml"] = _sheet(df.columns, rows) if df.columns else _sheet([], [])
    count = range(1, len(sheets) + 1)
    listed = "".join(f'<sheet name="{escape(name, {chr(34): "&quot;"})}" sheetId="{n}" r:id="rId{n}"/>' for n, name in zip(count, _sheet_names(list(sheets)), strict=True))
    links = "".join(f'<Relationship Id="rId{n}" Type="{REL}/worksheet" Target="worksheets/sheet{n}.xml"/>' for n in count)
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    types = "".join(f'<Override PartName="/xl/worksheets/sheet{n}.xml" ContentType="{kind}.worksheet+xml"/>' for n in count)
    parts |= {
        "[Content_Types].xml": f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
        f'<Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/>{types}</Types>',
        "_rels/.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets>{listed}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{PACKAGE}/relationships">{links}<Relationship Id="rId0" Type="{REL}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet xmlns="{MAIN}"><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs>'
        '<cellXfs count="2"><xf/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(name, f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>{body}')
    return out.getvalue()
