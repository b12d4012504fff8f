"""ARC and WARC: headers of both versions, declared lengths, revisits, round trips."""

import base64
import hashlib
import zlib

import pytest

from vigil.llm import warc

PAGES = "page_id long, url string, html string, key string, refers_to string"


def run(pages, ws, least=0, version=1, file_bytes=warc.FILE_BYTES):
    warc.write_arc(pages, ws.path("arc"), version, file_bytes)
    warc.convert(ws, ws.path("arc"), ws.path("warc"), least, file_bytes)
    return warc.read_warc(ws, ws.path("warc"))


def brute(pages, least=0):
    first = {}
    for page_id, html in pages:
        first[html or ""] = max(first.get(html or "", -1), -1 if page_id is None else page_id)
    out = []
    for page_id, html in pages:
        body = (html or "").encode()
        again = len(body) >= least and first[html or ""] != (-1 if page_id is None else page_id)
        out.append((-1 if page_id is None else page_id, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(),
                    "revisit" if again else "response", first[html or ""] if again else None))
    return sorted(out, key=str)


def found(df):
    rows = df.collect()
    assert all(r.intact for r in rows)
    return sorted(((-1 if r.page_id is None else r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str)


TRAPS = [(1, "http://a/b c?é", "WARC/1.1\r\nWARC-Type: response\r\n\r\n"), (2, None, None), (3, "http://x", ""), (4, "dns:x", "\r\n\r\n\n\nhttp://x 1 2 text/html 5\nabcde"),
         (5, "http://y", "same"), (6, "http://z", "same"), (7, "http://z", "same"), (8, "http://l", "é" * 300_000), (None, "http://n", "no id")]


@pytest.mark.parametrize("version", [1, 2])
def test_round_trip(rows, ws, version):
    pages = rows([(*p, "k", "r") for p in TRAPS], PAGES, 3)
    assert found(run(pages, ws, version=version)) == brute([(p[0], p[2]) for p in TRAPS])


def test_small_files_and_least_size(rows, ws):
    pages = [(i, f"http://h/{i}", f"page {i % 6} " * (i % 6)) for i in range(80)]
    got = run(rows([(*p, "k", "r") for p in pages], PAGES, 4), ws, least=20, file_bytes=500)
    assert found(got) == brute([(p[0], p[2]) for p in pages], 20)


def test_repeated_rows_have_one_response(rows, ws):
    got = run(rows([(1, "http://a", "x", "k", "r")] * 3, PAGES, 2), ws).collect()
    assert sorted(r.record_type for r in got) == ["response", "revisit", "revisit"]
    assert {r.refers_to for r in got} == {None, 1}


def test_no_pages(rows, ws):
    got = run(rows([], PAGES), ws)
    assert got.count() == 0 and "refers_to" in got.columns


def test_foreign_arc_records_in_one_member():
    body = b"GIF89a\x00\xff"
    text = b"1 0 Other\n" + " ".join(warc.ARC_FIELDS[1]).encode() + b"\n\n"
    data = b"filedesc://x.arc 0.0.0.0 19970101 text/plain %d\n" % len(text) + text
    data += b"\nhttp://h/g.gif 1.2.3.4 19970102030405 image/gif %d\n" % len(body) + body + b"\n"
    data += b"http://h/2 1.2.3.4 1997 text/html 0\n\n"
    got = list(warc.parse_arc("x.arc.gz", _gz(data)))
    assert [(r["url"], r["mime"], r["block"]) for r in got] == [("http://h/g.gif", "image/gif", body), ("http://h/2", "text/html", b"")]
    assert data[got[0]["offset"]:].startswith(b"http://h/g.gif")


def _gz(data):
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def test_a_cut_record_is_an_error():
    with pytest.raises(ValueError, match="declares 99 bytes"):
        list(warc.parse_arc("x", _gz(b"filedesc://x 0.0.0.0 1997 text/plain 99\nshort")))


def test_dates_and_identifiers():
    assert warc.iso_date("19970102030405") == "1997-01-02T03:04:05Z"
    assert warc.iso_date("19970102") == "1997-01-02T00:00:00Z" and warc.iso_date("1997") == "1997-01-01T00:00:00Z"
    assert warc.record_id("a", 1) == warc.record_id("a", 1) != warc.record_id("a", 2)


def _arc(records, fields=1):
    """Members of a version block and of raw (header line, block) records."""
    text = b"1 0 Other\n" + " ".join(warc.ARC_FIELDS[fields]).encode() + b"\n\n"
    return [b"filedesc://x.arc 0.0.0.0 19970101 text/plain %d\n" % len(text) + text] + [h + b"\n" + b + b"\n" for h, b in records]


def test_broken_records_are_rejects_and_the_others_are_converted(spark, ws):
    from pathlib import Path

    page = b"HTTP/1.1 200 OK\r\nX-Page-Id: %d\r\n\r\nbody %d"
    good = lambda n, url=b"http://h/": (url + b" 1.2.3.4 19970102 text/html %d" % len(page % (n, n)), page % (n, n))
    records = [good(1), (b"http://h/none 1.2.3.4 19970102 text/html many", b"x"), good(2, b"http://h/a b  c"), (b"http://h/cut 1.2.3.4 19970102 text/html 999", b"short"),
               (b"http://h/date 1.2.3.4 notadate text/html 1", b"x"), (b"only two", b"x"), good(3)]
    folder = Path(ws.path("arc").removeprefix("file:"))
    folder.mkdir(parents=True)
    (folder / "a.arc.gz").write_bytes(b"".join(map(_gz, _arc(records))))
    (folder / "plain.arc").write_bytes(b"".join(_arc([good(4), good(5, b"dns: h")])))
    (folder / "damaged.arc.gz").write_bytes(b"".join(map(_gz, _arc([good(6)]))) + b"\x1f\x8b\x08rubbish that is no member")
    (folder / "bare.arc").write_bytes(b"http://h/ 1.2.3.4 19970102 text/html 1\nx\n")
    assert warc.convert(ws, ws.path("arc"), ws.path("warc"))
    got = {r.page_id: (r.url, r.intact) for r in warc.read_warc(ws, ws.path("warc")).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6} and all(ok for _, ok in got.values()) and got[2][0] == "http://h/a b  c" and got[5][0] == "dns: h"
    rejects = sorted((r.name, r.reason.split(": ", 1)[-1]) for r in warc.arc_rejects(ws, ws.path("arc")).collect())
    assert [n for n, _ in rejects] == ["a.arc.gz"] * 4 + ["bare.arc", "damaged.arc.gz"]
    assert sum("declares no length" in r for _, r in rejects) == 2 and any("has 5" in r or "has 6" in r for _, r in rejects)
    assert warc.arc_rejects(ws, ws.path("nothing")).count() == 0
