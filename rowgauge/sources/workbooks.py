"""Excel workbooks (.xlsx) as a table.

`read_xlsx` lets Spark list and read the files, so any file system it knows will do, and hands each
workbook to a task. `spark.read.format("xlsx")`, after `register_xlsx`, plans partitions by workbook
and sheet and opens the files where they are read. Either way a task streams a sheet's cells out of
the archive in batches.
"""

from __future__ import annotations

import fnmatch
import io
import os
import posixpath
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, islice
from typing import BinaryIO
from xml.etree import ElementTree
from xml.parsers import expat

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from rowgauge.functions.cells import quoted

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_ROW, _CELL, _VALUE, _TEXT = (f"{_NS[1:]}{tag}" for tag in ("row", "c", "v", "t"))
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
BATCH_ROWS = 10_000
#: A partition takes sheets up to so many bytes of workbooks; opening one counts as so many.
PARTITION_BYTES, OPEN_BYTES = 64 << 20, 4 << 20


@lru_cache(maxsize=1 << 14)
def _column_number(letters: str) -> int:
    """0 for A, 25 for Z, 26 for AA."""
    number = 0
    for letter in re.match("[A-Z]+", letters).group():
        number = number * 26 + ord(letter) - 64
    return number - 1


def _text(element: ElementTree.Element) -> str:
    return "".join(part.text or "" for part in element.iter(f"{_NS}t"))


class _SharedStrings:
    """A workbook's shared strings by number, read as far as they are asked for."""

    def __init__(self, archive: zipfile.ZipFile) -> None:
        self.found: list[str] = []
        self.rest = self._read(archive) if "xl/sharedStrings.xml" in archive.namelist() else iter(())

    def _read(self, archive: zipfile.ZipFile) -> Iterator[str]:
        with archive.open("xl/sharedStrings.xml") as stream:
            for _, element in ElementTree.iterparse(stream):
                if element.tag == f"{_NS}si":
                    yield _text(element)
                    element.clear()

    def __getitem__(self, number: int) -> str:
        if number >= len(self.found):
            # As many again as there are: few for a header, and soon all.
            self.found += islice(self.rest, max(number + 1 - len(self.found), len(self.found)))
        return self.found[number]


def _sheets(archive: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Name and archive file of every sheet, in the workbook's order."""
    names = archive.namelist()
    if "xl/workbook.xml" not in names or "xl/_rels/workbook.xml.rels" not in names:
        # Without a list of sheets, their numbers are their order.
        found = [n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)]
        found.sort(key=lambda n: int(re.search(r"\d+", n.rpartition("/")[2]).group()))
        return [(f"Sheet{i + 1}", n) for i, n in enumerate(found)]
    relations = ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))
    files = {r.get("Id"): r.get("Target").lstrip("/").removeprefix("xl/") for r in relations}
    book = ElementTree.fromstring(archive.read("xl/workbook.xml"))
    return [(s.get("name"), f"xl/{files[s.get(_RELATION)]}") for s in book.iter(f"{_NS}sheet")]


def _sheet_file(archive: zipfile.ZipFile, sheet: int | str) -> str:
    """The archive's name for a sheet, given by its name or its place in the workbook's order."""
    listed = _sheets(archive)
    if isinstance(sheet, str):
        listed = [found for found in listed if found[0] == sheet]
        sheet = 0
    if not 0 <= sheet < len(listed):
        raise ValueError("workbook without the sheet asked for")
    return listed[sheet][1]


def header_names(row: list[str | None]) -> list[str]:
    """Column names of a header row: empty cells by their place, repeated names by a number."""
    names: list[str] = []
    for place, cell in enumerate(row):
        name = wanted = cell or f"_c{place}"
        number = 1
        while name in names:
            number += 1
            name = f"{wanted}_{number}"
        names.append(name)
    return names


def _rows_of_cells(stream: BinaryIO) -> Iterator[list[tuple[str | None, str | None, str | None]]]:
    """(reference, kind, value) of the cells of each row, without a tree; the value of inline text is the text."""
    parser = expat.ParserCreate(namespace_separator="}")
    parser.buffer_text = True
    done: list[list[tuple[str | None, str | None, str | None]]] = []
    cells: list[tuple[str | None, str | None, str | None]] = []
    parts: list[str] = []
    own: dict[str, str] = {}
    value, inline = None, ""

    def started(tag: str, attributes: dict[str, str]) -> None:
        nonlocal own, value, inline
        if tag == _CELL:
            own, value, inline = attributes, None, ""
        elif tag == _VALUE or tag == _TEXT:
            parts.clear()

    def ended(tag: str) -> None:
        nonlocal cells, value, inline
        if tag == _VALUE:
            value = "".join(parts)
        elif tag == _CELL:
            kind = own.get("t")
            cells.append((own.get("r"), kind, inline if kind == "inlineStr" else value))
        elif tag == _TEXT:
            inline += "".join(parts)
        elif tag == _ROW:
            done.append(cells)
            cells = []

    parser.StartElementHandler, parser.EndElementHandler = started, ended
    parser.CharacterDataHandler = parts.append
    size = 1 << 12  # a header is within few bytes
    try:
        while block := stream.read(size):
            parser.Parse(block, False)
            yield from done
            done.clear()
            size = 1 << 16
        parser.Parse(b"", True)
        yield from done
    except expat.ExpatError as error:
        raise ElementTree.ParseError(str(error)) from error


def sheet_rows(content: bytes | BinaryIO, sheet: int | str = 0) -> Iterator[list[str | None]]:
    """Rows of a sheet as text; empty cells are None. An open file is read as far as needed."""
    with zipfile.ZipFile(io.BytesIO(content) if isinstance(content, bytes) else content) as archive:
        shared = _SharedStrings(archive)
        with archive.open(_sheet_file(archive, sheet)) as stream:
            for cells in _rows_of_cells(stream):
                row: list[str | None] = []
                for position, (reference, kind, value) in enumerate(cells):
                    at = _column_number(reference.rstrip("0123456789")) if reference else position
                    if at >= len(row):
                        row.extend([None] * (at + 1 - len(row)))
                    if kind == "s" and value is not None:
                        value = shared[int(value)]
                    elif kind == "b" and value is not None:
                        value = "true" if value == "1" else "false"
                    row[at] = value or None
                yield row


def _named_rows(
    content: bytes | BinaryIO, sheet: int | str, header: bool
) -> tuple[list[str], Iterator[list[str | None]]]:
    """The names of a sheet's columns, and its rows below the header."""
    rows = sheet_rows(content, sheet)
    first = next(rows, [])
    if header:
        return header_names(first), rows
    return [f"_c{i}" for i in range(len(first))], chain([first], rows)


def _tables(
    names: list[str], sheet: int | str, header: bool, batches: Iterator[pd.DataFrame]
) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for content in batch["content"]:
            own, rows = _named_rows(content, sheet, header)
            place_of = {name: i for i, name in enumerate(own)}
            places = [place_of.get(n) for n in names]
            block = []
            for row in rows:
                block.append([row[p] if p is not None and p < len(row) else None for p in places])
                if len(block) == BATCH_ROWS:
                    yield pd.DataFrame(block, columns=names, dtype=object)
                    block = []
            if block:
                yield pd.DataFrame(block, columns=names, dtype=object)


def workbook_rows(
    files: DataFrame, names: list[str], sheet: int | str = 0, header: bool = True
) -> DataFrame:
    """The rows of workbooks given as a binary `content` column; absent columns are null."""
    layout = ", ".join(f"{quoted(n)} string" for n in names)
    return files.select("content").mapInPandas(
        lambda batches: _tables(names, sheet, header, batches), layout
    )


def read_xlsx(
    spark: SparkSession,
    path: str,
    schema: list[str] | None = None,
    sheet: int | str = 0,
    header: bool | str = True,
    **_options,
) -> DataFrame:
    """Workbooks at a path as one table of text columns, one task per workbook or more.

    `sheet` is a name or a place in the workbook's order. The first row names the columns unless
    `header` is off; empty names become `_c` and their place, repeated ones get a number. The table
    has the columns of all workbooks, in order of path and place, unless `schema`, a list of names,
    says which; a workbook without a column has nulls there. Numbers and dates are given as the
    sheet stores them. Without `schema`, one job reads the headers.
    """
    named = str(header).lower() != "false"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[xX][lL][sS][xX]").load(path)
    if schema is None:

        def headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for at, content in zip(batch["path"], batch["content"]):
                    names, _ = _named_rows(content, sheet, named)
                    yield pd.DataFrame({"path": at, "place": range(len(names)), "name": names})

        found = (
            files.select("path", "content").mapInPandas(headers, "path string, place int, name string")
            .groupBy("name").agg(F.min(F.struct("path", "place")).alias("first")).orderBy("first")
        )
        schema = [row["name"] for row in found.select("name").collect()]  # one row per column
        if not schema and files.select("path").isEmpty():
            raise ValueError(f"no workbook at {path}")
    return workbook_rows(files, list(schema), sheet, named)


@dataclass
class SheetsPartition(InputPartition):
    """(path, sheet) of the sheets that one task reads, one after another."""

    sheets: list[tuple[str, int | str]]


class WorkbookSource(DataSource):
    """The format "xlsx": one sheet, or all, of the workbooks at a path as a table of text columns.

    Options: `path`, a workbook, a directory of them, or a pattern in its last part; `sheet`, a name, a
    place in the workbook's order (0) or `*` for all sheets; `header` (true); `mergeSchema` (true): the
    columns of all sheets in order of path and place, or else those of the first. A given schema must
    be of text columns and spares the reading of headers; columns that a sheet lacks are null. Names
    as for `read_xlsx`; an empty sheet has no rows. Files are opened by the file systems of pyarrow.

    Planning lists the files; only headers without a schema, and `*`, open them. Small workbooks
    share a partition, and the sheets of a large one are read by several tasks.
    """

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def _option(self, name: str, default: str) -> str:
        return str(self.options.get(name, default))

    def _header(self) -> bool:
        return self._option("header", "true").lower() != "false"

    def _listed(self) -> list[tuple[str, int]]:
        """Sorted paths of the workbooks, and their sizes."""
        found, path = _file_system(self._option("path", ""))
        folder, _, last = path.rpartition("/")
        glob = last if any(c in last for c in "*?[") else None
        if glob is None and found.get_file_info(path).type == fs.FileType.File:
            infos = [found.get_file_info(path)]
        else:
            infos = found.get_file_info(fs.FileSelector(folder if glob else path, allow_not_found=True))
        root = self._option("path", "")
        root = root.rstrip("/") if glob is None else root.rpartition("/")[0]
        listed = []
        for info in infos:
            name = posixpath.basename(info.path)
            if info.type != fs.FileType.File or name.startswith((".", "_")) or not name.lower().endswith(".xlsx"):
                continue
            if glob is None or fnmatch.fnmatchcase(name, glob):
                own = root if len(infos) == 1 and info.path == path else f"{root}/{name}"
                listed.append((own, info.size or 0))
        if not listed:
            raise ValueError(f"no workbook at {root}")
        return sorted(listed)

    def sheets(self) -> list[tuple[str, int | str, int]]:
        """(path, sheet, bytes) of every sheet to read."""
        wanted = self._option("sheet", "0")
        if wanted != "*":
            sheet = int(wanted) if wanted.isdigit() else wanted
            return [(path, sheet, size) for path, size in self._listed()]
        found = []
        for path, size in self._listed():
            with _opened(path) as file, zipfile.ZipFile(file) as archive:
                count = len(_sheets(archive))
            found += [(path, place, size // max(1, count)) for place in range(count)]
        return found

    def schema(self) -> T.StructType:
        names: list[str] = []
        merged = self._option("mergeSchema", "true").lower() != "false"
        for path, sheet, _ in self.sheets() if merged else self.sheets()[:1]:
            with _opened(path) as file:
                own, _rows = _named_rows(file, sheet, self._header())
                names += [n for n in own if n not in names]
        return T.StructType([T.StructField(n, T.StringType()) for n in names])

    def reader(self, schema: T.StructType) -> SheetsReader:
        if any(f.dataType != T.StringType() for f in schema.fields):
            raise ValueError("columns of workbooks are read as text; apply a schema to the table")
        return SheetsReader(self.sheets(), schema.fieldNames(), self._header())


class SheetsReader(DataSourceReader):
    def __init__(self, sheets: list[tuple[str, int | str, int]], names: list[str], header: bool) -> None:
        self.sheets, self.names, self.header = sheets, names, header

    def partitions(self) -> list[InputPartition]:
        packs: list[InputPartition] = []
        room = 0
        for path, sheet, size in self.sheets:
            if not packs or room < size + OPEN_BYTES:
                packs.append(SheetsPartition([]))
                room = PARTITION_BYTES
            packs[-1].sheets.append((path, sheet))
            room -= size + OPEN_BYTES
        return packs

    def read(self, partition: SheetsPartition) -> Iterator[pa.RecordBatch]:
        layout = pa.schema([(n, pa.string()) for n in self.names])
        for path, sheet in partition.sheets:
            with _opened(path) as file:
                own, rows = _named_rows(file, sheet, self.header)
                place_of = {name: i for i, name in enumerate(own)}
                places = [place_of.get(n, len(own)) for n in self.names]
                block: list[list[str | None]] = []
                for row in chain(rows, [None]):
                    if row is not None:
                        block.append(row)
                    if block and (row is None or len(block) == BATCH_ROWS):
                        columns = [pa.array([r[p] if p < min(len(r), len(own)) else None for r in block], pa.string()) for p in places]
                        yield pa.RecordBatch.from_arrays(columns, schema=layout)
                        block = []


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, local unless the path names another, and the path in it."""
    if not path:
        raise ValueError("the format xlsx needs a path")
    path = re.sub("^file:/+", "/", path).rstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def _opened(path: str) -> pa.NativeFile:
    found, own = _file_system(path)
    return found.open_input_file(own)


def register_xlsx(spark: SparkSession) -> None:
    """Make the format "xlsx" known to a session."""
    spark.dataSource.register(WorkbookSource)
