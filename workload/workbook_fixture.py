"""Workbooks made from a table, for reading back: a batch of rows becomes one small .xlsx."""

from __future__ import annotations

import io
import os
import re
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

_XMLNS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def _cell(value, shared: dict[str, int], at: str = "") -> str:
    if value is None or value != value:
        return "" if at else "<c/>"
    if isinstance(value, str):
        return f'<c{at} t="s"><v>{shared.setdefault(value, len(shared))}</v></c>'
    return f"<c{at}><v>{value}</v></c>"


def workbook(rows: list[list], header: list[str], references: bool = False) -> bytes:
    """An .xlsx with one sheet; texts go to the shared string table.

    With `references` (26 columns at most) cells say where they stand, and empty ones are left out.
    """
    shared: dict[str, int] = {}
    lines = "".join(
        "<row>"
        + "".join(_cell(v, shared, f' r="{chr(65 + i)}{n + 1}"' if references else "") for i, v in enumerate(row))
        + "</row>"
        for n, row in enumerate([header, *rows])
    )
    texts = "".join(f"<si><t>{escape(text)}</t></si>" for text in shared)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr(
            "xl/worksheets/sheet1.xml",
            f'<worksheet xmlns="{_XMLNS}"><sheetData>{lines}</sheetData></worksheet>',
        )
        archive.writestr("xl/sharedStrings.xml", f'<sst xmlns="{_XMLNS}">{texts}</sst>')
    return out.getvalue()


def workbooks(df: DataFrame) -> DataFrame:
    """(content): the table as workbooks, one per batch."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = batch.astype(object).where(batch.notna(), None).values.tolist()
            yield pd.DataFrame({"content": [workbook(rows, list(batch.columns))]})

    return df.mapInPandas(made, "content binary")


def write_workbooks(df: DataFrame, folder: str) -> int:
    """Write the table as workbooks to a folder that all executors see; returns their number.

    Every other one has its columns turned round and cell references. A task that runs again writes
    the same files.
    """
    target = re.sub("^file:/+", "/", folder)

    def written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(target, exist_ok=True)
        part = TaskContext.get().partitionId()
        for number, batch in enumerate(batches):
            turned = part % 2 == 1
            if turned:
                batch = batch[batch.columns[::-1]]
            rows = batch.astype(object).where(batch.notna(), None).values.tolist()
            with open(f"{target}/part-{part:05d}-{number:05d}.xlsx", "wb") as file:
                file.write(workbook(rows, list(batch.columns), turned))
            yield pd.DataFrame({"rows": [len(batch)]})

    return df.mapInPandas(written, "rows long").count()
