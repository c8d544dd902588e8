"""Spreadsheet workbooks (``.xlsx``, ``.xlsm``) as a Spark data source.

``spark.read.format("workbook").load(path)`` gives a row for each sheet row that has a
value: ``file, sheet_row, cells``. A workbook is a zip archive of XML parts; the sheet is
parsed as a stream, so a task holds the shared strings and one row. Each file is one
task: the format itself ends at 1,048,576 rows a sheet.

Cells are strings, as in a CSV export: whole numbers without a point, dates as
``2001-12-31`` (with a time of day if they have one), truth values as ``TRUE`` and
``FALSE``. Blank cells, empty strings and error values are null. Of rich text the
characters count, phonetic hints do not.
"""

from __future__ import annotations

import posixpath
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree.ElementTree import Element, ParseError, iterparse

from pyarrow import ArrowInvalid, fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SUFFIXES = (".xlsx", ".xlsm")
SCHEMA = "file string, sheet_row bigint, cells array<string>"

# --- fixed values of the format ----------------------------------------------
DATE_FORMATS = frozenset((*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)))  # built-in number formats
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


class WorkbookError(ValueError):
    """Not a workbook, or no such sheet."""


def _open(path: str) -> tuple[fs.FileSystem, str]:
    scheme = re.match(r"^([a-z][a-z0-9+.-]*):(?!//)", path)  # file:/folder, as Hadoop spells it
    if scheme and scheme.group(1) == "file":
        path = path[len("file:") :]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def workbook_files(path: str) -> list[str]:
    """The workbook itself, or the workbooks of a folder, sorted by path."""
    system, place = _open(path)
    info = system.get_file_info(place)
    if info.type != fs.FileType.Directory:
        return [path]
    prefix = path[: len(path) - len(place)] if path.endswith(place) else ""
    found = system.get_file_info(fs.FileSelector(place))
    return sorted(prefix + f.path for f in found if f.path.lower().endswith(SUFFIXES) and not f.base_name.startswith(("~", ".")))


def _name(element: Element) -> str:
    """Tag without its namespace: strict and transitional files differ in it alone."""
    return element.tag.rpartition("}")[2]


def _elements(part, *names: str) -> Iterator[Element]:
    """Whole elements of the names; what has been seen is let go, so a part of any size is a stream."""
    parents: list[Element] = []
    for event, element in iterparse(part, ("start", "end")):
        if event == "start":
            parents.append(element)
            continue
        parents.pop()
        if _name(element) in names:
            yield element
            element.clear()
            if parents:
                parents[-1].remove(element)


def _text(element: Element) -> str:
    """The characters of plain or rich text."""
    return "".join(_text(e) if _name(e) == "r" else e.text or "" for e in element if _name(e) in ("r", "t"))


def _column(reference: str) -> int:
    """Zero-based column of a reference such as ``AB12``."""
    number = 0
    for c in reference:
        if not c.isalpha():
            break
        number = number * 26 + ord(c.upper()) - ord("A") + 1
    return number - 1


def number_text(value: str) -> str:
    """A number as it is read in a sheet: ``1994.0`` is ``1994``, ``7.0999999999999996`` is ``7.1``."""
    number = float(value)
    return str(int(number)) if number.is_integer() and abs(number) < 1e15 else repr(number)


def date_text(value: str, from_1904: bool = False) -> str:
    """A day number as a date, with the time if it has one; a fraction alone is a time of day."""
    days = float(value)
    seconds = round((days % 1) * 86400)
    if days < 1 and not from_1904:
        return str(timedelta(seconds=seconds)).rjust(8, "0")
    # day 60 of the 1900 system is a 29th of February that was none
    first = datetime(1904, 1, 1) if from_1904 else datetime(1899, 12, 31 if days < 60 else 30)
    moment = first + timedelta(days=int(days), seconds=seconds)
    return moment.strftime("%Y-%m-%d %H:%M:%S" if moment.hour or moment.minute or moment.second else "%Y-%m-%d")


def is_date_format(code: str) -> bool:
    """Whether a custom number format shows days or times: its letters outside quotes and brackets tell."""
    bare = re.sub(r'"[^"]*"|\\.|_.|\*.|\[(?!h|m|s)[^\]]*\]', "", code, flags=re.IGNORECASE)
    return bool(re.search("[dmyhs]", bare, re.IGNORECASE)) and "general" not in bare.lower()


class Workbook:
    """One archive: its sheets, shared strings and date styles."""

    def __init__(self, source):
        try:
            self.archive = zipfile.ZipFile(source)
            self.sheets, self.from_1904 = self._sheets()
        except (zipfile.BadZipFile, KeyError, ParseError) as err:
            raise WorkbookError(f"not a workbook: {err}") from err

    def _sheets(self) -> tuple[dict[str, str], bool]:
        """Part of each sheet by its name, in the workbook's order."""
        with self.archive.open("xl/_rels/workbook.xml.rels") as part:
            targets = {e.get("Id"): posixpath.normpath(posixpath.join("xl", e.get("Target", ""))) for e in _elements(part, "Relationship")}
        found, from_1904 = {}, False
        with self.archive.open("xl/workbook.xml") as part:
            for e in _elements(part, "sheet", "workbookPr"):
                if _name(e) == "workbookPr":
                    from_1904 = e.get("date1904") in ("1", "true")
                else:
                    relation = e.get(RELATION) or next(v for k, v in e.items() if k.endswith("}id"))
                    target = targets[relation]
                    found[e.get("name", "")] = target.removeprefix("/") if target.startswith("/") else target
        return found, from_1904

    def _optional(self, name: str, *elements: str) -> Iterator[Element]:
        if name in self.archive.namelist():
            with self.archive.open(name) as part:
                yield from _elements(part, *elements)

    def shared_strings(self) -> list[str]:
        return [_text(e) for e in self._optional("xl/sharedStrings.xml", "si")]

    def date_styles(self) -> set[int]:
        """Numbers of the cell styles that show dates."""
        dates, styles = set(DATE_FORMATS), set()
        for e in self._optional("xl/styles.xml", "numFmt", "cellXfs"):
            if _name(e) == "numFmt":
                if is_date_format(e.get("formatCode", "")):
                    dates.add(int(e.get("numFmtId")))
                else:
                    dates.discard(int(e.get("numFmtId")))
            else:
                styles = {k for k, x in enumerate(e) if int(x.get("numFmtId", 0)) in dates}
        return styles

    def rows(self, sheet: str | None = None) -> Iterator[tuple[int, list[str | None]]]:
        """(row number from 1, cells) of the rows with a value, of the named or the first sheet."""
        if sheet is not None and sheet not in self.sheets:
            raise WorkbookError(f"no sheet {sheet!r}; there are {sorted(self.sheets)}")
        if not self.sheets:
            raise WorkbookError("a workbook without sheets")
        part = self.sheets[sheet] if sheet is not None else next(iter(self.sheets.values()))
        strings, dates, number = self.shared_strings(), self.date_styles(), 0
        with self.archive.open(part) as source:
            for row in _elements(source, "row"):
                number = int(row.get("r", number + 1))
                cells: list[str | None] = []
                for cell in row:
                    if _name(cell) != "c":
                        continue
                    at = _column(cell.get("r")) if cell.get("r") else len(cells)
                    cells += [None] * (at + 1 - len(cells))
                    cells[at] = self._value(cell, strings, dates)
                if any(c is not None for c in cells):
                    yield number, cells

    def _value(self, cell: Element, strings: list[str], dates: set[int]) -> str | None:
        kind, value = cell.get("t", "n"), None
        for e in cell:
            if _name(e) == "v":
                value = e.text
            elif _name(e) == "is":
                return _text(e) or None
        if not value or kind == "e":
            return None
        if kind == "s":
            return strings[int(value)] or None
        if kind == "b":
            return "TRUE" if value == "1" else "FALSE"
        if kind == "n":
            return date_text(value, self.from_1904) if int(cell.get("s", 0)) in dates else number_text(value)
        return value


def sheet_rows(path: str, sheet: str | None = None) -> Iterator[tuple[int, list[str | None]]]:
    system, place = _open(path)
    try:
        source = system.open_input_file(place)
    except (OSError, ArrowInvalid) as err:
        raise WorkbookError(f"{path}: {err}") from err
    with source:
        yield from Workbook(source).rows(sheet)


class WorkbookPartition(InputPartition):
    def __init__(self, file: str):
        self.file = file


class WorkbookReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.sheet = options["path"], options.get("sheet")

    def partitions(self) -> list[InputPartition]:
        return [WorkbookPartition(f) for f in workbook_files(self.path)]

    def read(self, partition: WorkbookPartition) -> Iterator[tuple]:
        for number, cells in sheet_rows(partition.file, self.sheet):
            yield partition.file, number, cells


class WorkbookSource(DataSource):
    """Options: ``path`` of a workbook or a folder of them, ``sheet`` (default: the first)."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WorkbookReader(self.options)


def read_workbook(spark: SparkSession, path: str, sheet: str | None = None, place: str = "__row_place") -> DataFrame:
    """The sheet as strings under its header row's names, and the order of its rows as ``place``.

    The first row with a value is the header. Names may repeat; a column without one has
    an empty name, and those behind the last name are dropped. Of a folder each workbook
    has its own header, and its columns go by the first one's names.
    """
    spark.dataSource.register(WorkbookSource)
    files = workbook_files(path)
    heads = {f: next(iter(sheet_rows(f, sheet)), None) for f in files}
    heads = {f: h for f, h in heads.items() if h}
    if not heads:
        raise WorkbookError(f"{path} is empty")
    names = [" ".join((c or "").split()) for c in next(iter(heads.values()))[1]]
    reader = spark.read.format("workbook")
    rows = (reader.option("sheet", sheet) if sheet is not None else reader).load(path)
    # the files and their header rows: as few as the workbooks that were named
    known = F.create_map(*(F.lit(x) for f, (number, _) in heads.items() for x in (f, number)))
    body = rows.where(F.col("sheet_row") > known[F.col("file")])
    rank = (F.array_position(F.lit(list(heads)), F.col("file")) - 1).cast("long")
    own = {f: [" ".join((c or "").split()) for c in h[1]] for f, h in heads.items()}
    values = []
    for k, name in enumerate(names):
        at = F.get("cells", F.lit(k))
        moved = [(f, theirs.index(name)) for f, theirs in own.items() if name in theirs and theirs.count(name) == 1 and theirs.index(name) != k]
        gone = [f for f, theirs in own.items() if name not in theirs]
        for f, other in moved:
            at = F.when(F.col("file") == f, F.get("cells", F.lit(other))).otherwise(at)
        values.append((F.when(F.col("file").isin(gone), None).otherwise(at) if gone else at).alias(f"_c{k}"))
    order = (F.shiftleft(rank, 40) + F.col("sheet_row")).alias(place)
    return body.select(*values, order).toDF(*names, place)
