"""Workbooks (.xlsx) read and written with the standard library, as rows (path, sheet, row_idx, cells)."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Larger files aren't read.
MOST_BYTES = 50_000_000
SCHEMA = "path string, sheet string, row_idx int, cells array<string>"
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def column_index(reference: str) -> int:
    """0 for A1, 26 for AA7."""
    n = 0
    for c in re.match(r"[A-Z]*", reference).group():
        n = n * 26 + ord(c) - 64
    return n - 1


def read_workbook(content: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """sheet, row index from 0, cells: shared and inline strings, truth values, numbers as written; missing cells are None."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_NS}si")]
        rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for s in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_NS}sheet"):
            target = rels[s.get(f"{_REL}id")].lstrip("/")
            at_row = -1
            for row in ET.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{_NS}row"):
                at_row = int(row.get("r")) - 1 if row.get("r") else at_row + 1
                cells: list[str | None] = []
                for c in row.iter(f"{_NS}c"):
                    at = column_index(c.get("r") or "") if c.get("r") else len(cells)
                    cells.extend([None] * (at + 1 - len(cells)))
                    kind, v = c.get("t"), c.find(f"{_NS}v")
                    if kind == "inlineStr":
                        cells[at] = "".join(t.text or "" for t in c.iter(f"{_NS}t"))
                    elif v is not None and v.text is not None:
                        cells[at] = shared[int(v.text)] if kind == "s" else ("true" if v.text == "1" else "false") if kind == "b" else v.text
                yield s.get("name"), at_row, cells


def workbooks(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all workbooks of a path; each file is read by one task."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, content in zip(b["path"], b["content"], strict=True):
                yield pd.DataFrame([(p, *r) for r in read_workbook(content)], columns=["path", "sheet", "row_idx", "cells"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)
    return files.filter(f"length <= {MOST_BYTES}").select("path", "content").mapInPandas(read, SCHEMA)


def sheet_names(names: list[str]) -> list[str]:
    """Names fit for sheets: no special signs, 31 characters at most, none twice."""
    out: list[str] = []
    for n in names:
        base = re.sub(r"[\[\]:*?/\\]", " ", n).strip()[:31] or "Sheet"
        name, k = base, 2
        while name.lower() in {o.lower() for o in out}:
            name, k = f"{base[: 31 - len(str(k)) - 1]}_{k}", k + 1
        out.append(name)
    return out


def write_workbook(path: str, sheets: dict[str, DataFrame], most_rows: int = 1_048_576) -> None:
    """Sheets of bounded reports (a sheet holds no more than most_rows; a larger DataFrame is refused), rows fetched one by one."""
    from xml.sax.saxutils import escape

    names = sheet_names(list(sheets))
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        types = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1))
        z.writestr("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{types}</Types>')
        z.writestr("_rels/.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{_NS[1:-1]}" xmlns:r="{_REL[1:-1]}"><sheets>' + "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + "</Relationships>")
        for i, df in enumerate(sheets.values(), 1):
            if df.limit(most_rows).count() >= most_rows:
                raise ValueError(f"{names[i - 1]}: a sheet holds fewer than {most_rows} rows")
            with z.open(f"xl/worksheets/sheet{i}.xml", "w") as f:
                f.write(f'<?xml version="1.0"?><worksheet xmlns="{_NS[1:-1]}"><sheetData>'.encode())
                for values in ([*df.columns], *(tuple(r) for r in df.toLocalIterator())):
                    cells = "".join("<c/>" if v is None else f"<c><v>{v}</v></c>" if isinstance(v, (int, float)) and not isinstance(v, bool) else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>' for v in values)
                    f.write(f"<row>{cells}</row>".encode())
                f.write(b"</sheetData></worksheet>")


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV parts for spreadsheets in Portuguese: ';' between cells, all quoted, decimal comma, byte order mark of UTF-8 in
    each part's first heading."""
    from pyspark.sql import functions as F

    decimal = [F.replace(F.format_string("%.4f", c), F.lit("."), F.lit(",")).alias(c) if t == "double" else F.col(c).cast("string").alias(c) for c, t in df.dtypes]
    out = df.select(*decimal)
    out.withColumnRenamed(out.columns[0], "﻿" + out.columns[0]).write.mode("overwrite").option("sep", ";").option("quoteAll", True).option("header", True).csv(path)
