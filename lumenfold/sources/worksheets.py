"""Workbooks as a Spark data source: a partition a worksheet, read from its XML as a stream.

``spark.dataSource.register(Worksheets)``, then ``spark.read.format("worksheets").load(folder)`` has a row
for each row of each worksheet, and with ``option("what", "sheets")`` one for each worksheet, with what
the cells don't show: formulas, links, merged ranges, hidden rows and columns.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ROWS = "path string, sheet string, row_no int, cells array<string>, hidden boolean, formulas int"
SHEETS = "path string, sheet string, state string, n_rows int, n_columns int, formulas int, links int, merged int, merged_ranges string, hidden_rows string, hidden_columns string"
#: Ranges and rows that a summary names; the counts have no bound.
SHOWN = {"merged_ranges": 20, "hidden_rows": 50, "hidden_columns": 50}


def _name(tag: str) -> str:
    return tag.rpartition("}")[2]


def _attribute(element: ElementTree.Element, name: str) -> str | None:
    """An attribute whatever its namespace."""
    return next((v for k, v in element.attrib.items() if _name(k) == name), None)


def column_number(letters: str) -> int:
    """A is 0, Z 25, AA 26."""
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n - 1


def column_letters(n: int) -> str:
    out = ""
    n += 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


@dataclass
class Sheet(InputPartition):
    path: str
    sheet: str
    part: str
    state: str


def _files(path: str) -> list[tuple[fs.FileSystem, str, str]]:
    """(store, place, name) of a workbook, or of the workbooks in a folder."""
    store, at = fs.FileSystem.from_uri(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.File:
        return [(store, at, path)]
    found = store.get_file_info(fs.FileSelector(at))
    return sorted(((store, x.path, f"{path.rstrip('/')}/{x.base_name}") for x in found if x.type == fs.FileType.File and x.extension.lower() in ("xlsx", "xlsm")), key=lambda x: x[2])


def sheets_of(book: zipfile.ZipFile) -> list[tuple[str, str, str]]:
    """(name, part, state) of the worksheets, in their order; the workbook's relations say which part a sheet is."""
    names = set(book.namelist())
    parts = {}
    if "xl/_rels/workbook.xml.rels" in names:
        for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")):
            target = r.get("Target", "")
            parts[r.get("Id")] = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    out = []
    sheets = [e for e in ElementTree.fromstring(book.read("xl/workbook.xml")).iter() if _name(e.tag) == "sheet"]
    for i, e in enumerate(sheets, 1):
        part = parts.get(_attribute(e, "id"), f"xl/worksheets/sheet{i}.xml")
        if part in names and "chartsheets/" not in part:
            out.append((e.get("name", ""), part, e.get("state", "visible")))
    return out


def _text(element: ElementTree.Element) -> str:
    """The text of a string item, without its phonetic marks."""
    if _name(element.tag) == "rPh":
        return ""
    return (element.text or "" if _name(element.tag) == "t" else "") + "".join(_text(x) for x in element)


def shared_strings(book: zipfile.ZipFile) -> list[str]:
    """The texts that cells name by number."""
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    with book.open("xl/sharedStrings.xml") as file:
        for _, e in ElementTree.iterparse(file):
            if _name(e.tag) == "si":
                out.append(_text(e))
                e.clear()
    return out


def _cell(e: ElementTree.Element, shared: list[str]) -> tuple[str, bool]:
    """The value of a cell, and whether it has a formula."""
    value, formula, kind = "", False, e.get("t", "n")
    for x in e:
        name = _name(x.tag)
        if name == "f":
            formula = True
        elif name == "is":
            value = _text(x)
        elif name == "v" and x.text is not None:
            value = shared[int(x.text)] if kind == "s" else {"0": "FALSE", "1": "TRUE"}.get(x.text, x.text) if kind == "b" else x.text
    return value, formula


def read_sheet(book: zipfile.ZipFile, part: str, summary: dict | None = None) -> Iterator[tuple[int, list[str], bool, int]]:
    """(row number, cells, hidden, formulas) of each row, from a stream of its XML; counts go to ``summary``.

    Empty cells at the end of a row are left out. Rows and cells without a reference follow the last.
    """
    shared = shared_strings(book)
    counts = {"n_rows": 0, "n_columns": 0, "formulas": 0, "links": 0, "merged": 0, "merged_ranges": [], "hidden_rows": [], "hidden_columns": []}
    number = 0
    with book.open(part) as file:
        cells: dict[int, str] = {}
        at, formulas, stack = -1, 0, []
        for event, e in ElementTree.iterparse(file, ("start", "end")):
            name = _name(e.tag)
            if event == "start":
                stack.append(e)
                if name == "row":
                    cells, at, formulas = {}, -1, 0
                    number = int(e.get("r") or number + 1)
                continue
            stack.pop()
            if name == "c":
                letters = re.match("[A-Z]+", e.get("r") or "")
                at = column_number(letters[0]) if letters else at + 1
                cells[at], formula = _cell(e, shared)
                formulas += formula
            elif name == "row":
                hidden = e.get("hidden") in ("1", "true")
                width = max((k for k, v in cells.items() if v != ""), default=-1) + 1
                counts["n_rows"] += 1
                counts["n_columns"] = max(counts["n_columns"], width)
                counts["formulas"] += formulas
                if hidden:
                    counts["hidden_rows"].append(str(number))
                yield number, [cells.get(k, "") for k in range(width)], hidden, formulas
                e.clear()
                if stack:
                    stack[-1].clear()  # the rows that are done
            elif name == "hyperlink":
                counts["links"] += 1
            elif name == "mergeCell":
                counts["merged"] += 1
                counts["merged_ranges"].append(e.get("ref", ""))
            elif name == "col" and e.get("hidden") in ("1", "true"):
                counts["hidden_columns"] += [column_letters(i - 1) for i in range(int(e.get("min", 1)), int(e.get("max", 1)) + 1)]
    if summary is not None:
        summary.update(counts | {c: ";".join(counts[c][:n]) for c, n in SHOWN.items()})


class _Reader(DataSourceReader):
    def __init__(self, path: str, what: str) -> None:
        self.path, self.what = path, what

    def partitions(self) -> list[Sheet]:
        found = []
        for store, at, name in _files(self.path):
            with store.open_input_file(at) as file, zipfile.ZipFile(file) as book:  # the directory at the end of the file alone
                found += [Sheet(name, *x) for x in sheets_of(book)]
        return found or [Sheet("", "", "", "")]

    def read(self, partition: Sheet) -> Iterator[tuple]:
        if not partition.part:
            return
        store, at = fs.FileSystem.from_uri(partition.path)
        with store.open_input_file(at) as file, zipfile.ZipFile(file) as book:
            summary: dict = {}
            rows = read_sheet(book, partition.part, summary)
            if self.what == "rows":
                for number, cells, hidden, formulas in rows:
                    yield partition.path, partition.sheet, number, cells, hidden, formulas
                return
            for _ in rows:
                pass
            yield (partition.path, partition.sheet, partition.state, *(summary[c.split()[0]] for c in SHEETS.split(", ")[3:]))


class Worksheets(DataSource):
    """Options: path, a workbook or a folder of workbooks; what, ``rows`` or ``sheets``."""

    @classmethod
    def name(cls) -> str:
        return "worksheets"

    def schema(self) -> str:
        return SHEETS if self._what() == "sheets" else ROWS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self._what())

    def _what(self) -> str:
        what = self.options.get("what", "rows")
        if what not in ("rows", "sheets"):
            raise ValueError(f"what is rows or sheets, not {what!r}")
        return what
