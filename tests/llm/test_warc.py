"""ARC to WARC: parsing of both versions, round trips, revisits."""

import gzip
import hashlib

import pyarrow as pa
import pytest

from scriptorium.llm.common import read_table
from scriptorium.llm.warc import (
    arc_file, arc_records, convert, convert_arc_files, gzip_member, members, page_archive, parse_warc, warc_date, write_warc,
)

BODY = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>h\xc3\xa9 \n\n2 0 x</p>"


@pytest.mark.parametrize("version", [1, 2])
def test_both_versions(version):
    made = [("http://a/x y", "10.1.2.3", "20010203040506", "text/html", BODY), ("dns:a", "10.1.2.3", "2001", "text/dns", b"a. 1 IN A 10.1.2.3\n"), ("http://e", "-", "", "text/html", b"")]
    info, *records = arc_records(arc_file(made, version))
    assert info.is_filedesc and [r.body for r in records] == [m[-1] for m in made] and {r.version for r in records} == {version}
    page, dns, empty = map(convert, records)
    assert page.headers["WARC-Type"] == "response" and page.headers["WARC-Date"] == "2001-02-03T04:05:06Z"
    assert page.headers["WARC-Target-URI"] == "http://a/x%20y" and page.headers["WARC-IP-Address"] == "10.1.2.3"
    assert page.headers["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(b"<p>h\xc3\xa9 \n\n2 0 x</p>").hexdigest()
    assert dns.headers["WARC-Type"] == "resource" and dns.headers["Content-Type"] == "text/dns"
    assert empty.headers["WARC-Type"] == "resource" and empty.block == b""
    assert convert(info).headers["WARC-Type"] == "warcinfo"
    assert len({convert(r).headers["WARC-Record-ID"] for r in (info, *records)}) == 4
    for r in (page, dns, empty):
        again = parse_warc(r.to_bytes())
        assert again.block == r.block and again.headers["WARC-Record-ID"] == r.headers["WARC-Record-ID"]


def test_broken_archives():
    data = arc_file([("http://a", "1.1.1.1", "20010101000000", "text/html", b"x" * 50)])
    *_, last = arc_records(data[:-20])
    assert last.problem == "truncated" and convert(last).headers["WARC-Truncated"] == "length"
    info, *rest = arc_records(data + b"no header here\n\n" + data[data.index(b"http://a"):])
    assert [r.problem for r in rest] == ["", "header", ""] and rest[2].body == b"x" * 50
    assert list(arc_records(b"")) == []
    spaced = b"http://a b c 1.1.1.1 20010101000000 text/html 3\nabc\n"
    assert next(arc_records(spaced)).fields["URL"] == "http://a b c"
    with pytest.raises(ValueError):
        list(members(pa.BufferReader(gzip_member(b"a" * 1000)[:-5])))


def test_dates():
    assert [warc_date(d) for d in ("1999", "19990203", "", "20009999999999")] == [
        "1999-01-01T00:00:00Z", "1999-02-03T00:00:00Z", "0000-01-01T00:00:00Z", "2000-12-31T23:59:59Z"]


def brute(rows):
    first = {}
    for i, html in rows:
        p = (html or "").encode()
        if len(p) >= 100 and i is not None:
            first[p] = min(i, first.get(p, i))
    out = []
    for i, html in rows:
        p = (html or "").encode()
        again = p in first and first[p] != i
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", first[p] if again else None))
    return sorted(out, key=str)


def test_table(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages")
    assert sorted(map(tuple, page_archive(pages).collect()), key=str) == brute([(r.page_id, r.html) for r in pages.collect()])


def test_odd_rows(spark, tmp_path):
    big, small = "<p>é" + "x" * 200, "tiny"
    rows = [(5, "http://a", big, 1), (3, None, big, 1), (9, "b c\n", big, 1), (3, None, big, 1), (None, "http://n", big, 1), (1, "u", small, 1), (2, "u", small, 1),
            (7, "u", None, 1), (8, "", "", 1), (10, "u", "y" * 3_000_000, 1)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, refers_to int")
    want = brute([(r[0], r[2]) for r in rows])
    assert sorted(map(tuple, page_archive(pages).collect()), key=str) == want
    files = write_warc(pages, f"file://{tmp_path}/w", file_bytes=100)
    for r in files.collect():
        text = gzip.open(r.file.removeprefix("file://")).read()
        assert text.count(b"WARC/1.1\r\n") == r.n_records + 1
    assert page_archive(pages.limit(0)).count() == 0


def test_convert_arc_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    data = arc_file([("http://a", "1.1.1.1", "20010101000000", "text/html", BODY)] * 3, 2)
    (tmp_path / "in/a.arc").write_bytes(data)
    (tmp_path / "in/b.arc.gz").write_bytes(gzip.compress(data[:-9]))
    got = convert_arc_files(spark, f"{tmp_path}/in", f"file://{tmp_path}/out").collect()
    assert sorted((r.n_records, r.n_problems) for r in got) == [(4, 0), (4, 1)]
    for r in got:
        with open(r.file.removeprefix("file://"), "rb") as source:
            kinds = [parse_warc(x).headers["WARC-Type"] for x in members(source)]
        assert kinds == ["warcinfo", "response", "response", "response"]


def test_pages_with_the_address_of_a_description(spark):
    """Only a file's first record describes it."""
    rows = [(1, "http://a/", "x" * 120), (2, "filedesc://b", "y" * 120), (3, "http://c/", "y" * 120), (4, "filedesc:", None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1)
    got = sorted((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in page_archive(pages).collect())
    assert got == [(1, "response", None, 120), (2, "response", None, 120), (3, "revisit", 2, 120), (4, "response", None, 0)]
