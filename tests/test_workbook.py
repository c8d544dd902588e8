"""Workbooks against their CSV twins, cell by cell and as metadata."""

import csv
import zipfile
from xml.sax.saxutils import escape

import pytest

from scriptorium.sources import metadata as MD
from scriptorium.sources import workbook as W

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def letters(k):
    out = ""
    k += 1
    while k:
        k, r = divmod(k - 1, 26)
        out = chr(65 + r) + out
    return out


def write_workbook(path, sheets, date1904=False):
    """``sheets``: name -> rows of (kind, value) cells or None; kinds n, d, t (date and time), s, i, b, e, r (rich text)."""
    strings, parts = [], {}
    for number, (name, rows) in enumerate(sheets.items(), 1):
        body = ""
        for r, row in enumerate(rows, 1):
            if row is None:
                continue
            body += f'<row r="{r}">'
            for c, cell in enumerate(row):
                if cell is None:
                    continue
                kind, value = cell
                at = f'r="{letters(c)}{r}"'
                if kind in "sr":
                    strings.append((kind, value))
                    body += f'<c {at} t="s"><v>{len(strings) - 1}</v></c>'
                elif kind == "i":
                    body += f'<c {at} t="inlineStr"><is><t>{escape(value)}</t></is></c>'
                else:
                    style, t = {"n": (0, "n"), "d": (1, "n"), "t": (2, "n"), "b": (0, "b"), "e": (0, "e")}[kind]
                    body += f'<c {at} s="{style}" t="{t}"><v>{value}</v></c>'
            body += "</row>"
        parts[f"xl/worksheets/sheet{number}.xml"] = f'<worksheet xmlns="{MAIN}"><sheetData>{body}</sheetData></worksheet>'
    items = ""
    for kind, value in strings:
        half = len(value) // 2
        items += "<si>" + (f"<t>{escape(value)}</t>" if kind == "s" else f"<r><t>{escape(value[:half])}</t></r><r><t>{escape(value[half:])}</t></r><rPh><t>zz</t></rPh>") + "</si>"
    parts["xl/sharedStrings.xml"] = f'<sst xmlns="{MAIN}">{items}</sst>'
    parts["xl/styles.xml"] = (
        f'<styleSheet xmlns="{MAIN}"><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm\\-dd hh:mm"/></numFmts>'
        '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs></styleSheet>'
    )
    listed = "".join(f'<sheet name="{escape(n)}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(sheets, 1))
    parts["xl/workbook.xml"] = f'<workbook xmlns="{MAIN}" xmlns:r="{RELS}"><workbookPr date1904="{int(date1904)}"/><sheets>{listed}</sheets></workbook>'
    targets = "".join(f'<Relationship Id="rId{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1))
    parts["xl/_rels/workbook.xml.rels"] = f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{targets}</Relationships>'
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, text in parts.items():
            archive.writestr(name, text)
    return str(path)


HEADER = [("s", " Movie name "), ("s", "Year"), ("s", "IMDb  Rating"), ("s", "IMDb ID"), ("s", ".txt Files"), ("i", "Decaade"), ("r", "Movie length"), ("s", "Year"), ("s", "Released")]
ROWS = [
    [("s", "Up, & <away>"), ("n", "2009"), ("n", "8.3000000000000007"), ("s", "tt1"), ("n", "12"), ("s", "2000s"), ("n", "96"), ("n", "1"), ("d", "39962")],
    [("r", "Café \"noir\""), ("n", "1994.0"), ("s", "N/A"), None, ("s", "a.txt"), None, ("n", "1.5E2"), None, ("t", "34335.75")],
    None,
    [None, None, ("e", "#N/A"), ("b", "1"), ("s", ""), ("i", "1990s")],
    [("i", "line\nbreak"), ("n", "-3"), ("n", "0"), ("b", "0"), ("s", "b")],
]
TWIN = [
    [" Movie name ", "Year", "IMDb  Rating", "IMDb ID", ".txt Files", "Decaade", "Movie length", "Year", "Released"],
    ["Up, & <away>", "2009", "8.3", "tt1", "12", "2000s", "96", "1", "2009-05-29"],
    ["Café \"noir\"", "1994", "N/A", "", "a.txt", "", "150", "", "1994-01-01 18:00:00"],
    ["", "", "", "TRUE", "", "1990s", "", "", ""],
    ["line\nbreak", "-3", "0", "FALSE", "b", "", "", "", ""],
]


def test_workbook_equals_its_csv_twin(spark, tmp_path):
    book = write_workbook(tmp_path / "a.xlsx", {"Movies": [HEADER, *ROWS], "Other": [[("s", "x")]]})
    with open(tmp_path / "a.csv", "w", newline="") as f:
        csv.writer(f).writerows(TWIN)
    names = [c for c in MD.read_metadata(spark, book).columns if c not in ("row_ordinal", "source_path")]
    a, b = (MD.read_metadata(spark, p).orderBy("row_ordinal").select(*names).collect() for p in (book, str(tmp_path / "a.csv")))
    assert [tuple(r) for r in a] == [tuple(r) for r in b] and len(a) == 4
    assert [r.year for r in a] == ["2009", "1994", None, "-3"] and a[0].decade == "2000s"


def test_sheets_and_folders(spark, tmp_path):
    two = {"A": [[("s", "Movie name"), ("s", "Year")], [("s", "x"), ("n", "1")]], "B": [[("s", "Movie name")], [("s", "y")], [("s", "z")]]}
    write_workbook(tmp_path / "one.xlsx", two)
    write_workbook(tmp_path / "two.xlsx", {"A": [None, [("s", "Year"), ("s", "Movie name")], [("n", "2"), ("s", "w")]]})
    write_workbook(tmp_path / "three.xlsx", {"A": [[("s", "Year")], [("n", "3")]]})
    (tmp_path / "~$one.xlsx").write_bytes(b"lock")
    rows = W.read_workbook(spark, str(tmp_path / "one.xlsx"), "B").orderBy("__row_place").collect()
    assert [r["Movie name"] for r in rows] == ["y", "z"]
    folder = W.read_workbook(spark, f"file:{tmp_path}").orderBy("__row_place")
    assert [(r["Movie name"], r["Year"]) for r in folder.collect()] == [("x", "1"), (None, "3"), ("w", "2")]
    with pytest.raises(W.WorkbookError):
        W.read_workbook(spark, str(tmp_path / "one.xlsx"), "C")


def test_odd_workbooks_are_skipped_as_sources(spark, tmp_path):
    good = write_workbook(tmp_path / "good.xlsx", {"A": [[("s", "Movie name")], [("s", "x")]]})
    empty = write_workbook(tmp_path / "empty.xlsx", {"A": []})
    (tmp_path / "broken.xlsx").write_bytes(b"PK not a zip")
    found = MD.read_metadata(spark, [empty, str(tmp_path / "broken.xlsx"), good]).collect()
    assert [(r.source_ordinal, r.movie_name) for r in found] == [(2, "x")]
    header_only = write_workbook(tmp_path / "header.xlsx", {"A": [HEADER]})
    assert MD.read_metadata(spark, header_only).count() == 0


def test_dates_and_numbers():
    assert [W.date_text(x) for x in ("1", "59", "61", "44197", "44197.5", "0.25")] == [
        "1900-01-01", "1900-02-28", "1900-03-01", "2021-01-01", "2021-01-01 12:00:00", "06:00:00"]
    assert W.date_text("42735", from_1904=True) == "2021-01-01"
    assert [W.number_text(x) for x in ("1994.0", "7.0999999999999996", "-2", "1E-3", "1e20")] == ["1994", "7.1", "-2", "0.001", "1e+20"]
    assert [W.is_date_format(x) for x in ("yyyy-mm-dd", "0.00", "[h]:mm", '0 "days"', "[Red]0", "General", "#,##0 \\d")] == [True, False, True, False, False, False, False]


def test_rows_stream_without_growing(tmp_path):
    """A sheet is let go row by row."""
    path = write_workbook(tmp_path / "long.xlsx", {"A": [[("n", str(k)), ("i", "x" * 50)] for k in range(20_000)]})
    import tracemalloc

    tracemalloc.start()
    total = sum(1 for _ in W.sheet_rows(path))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == 20_000 and peak < 4 << 20
