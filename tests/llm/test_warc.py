import io
import struct
import zipfile

import pytest

from wardline.llm import warc


def reader(data):
    return warc.ZipReader(lambda at, n: data[at : at + n], len(data))


def test_zip_members_are_read_by_others_and_by_us():
    for zip64 in (True, False):
        out = io.BytesIO()
        z = warc.ZipWriter(out, zip64)
        z.add("a/b.txt", b"hello" * 100)
        z.add("é.bin", b"")
        z.close()
        with zipfile.ZipFile(io.BytesIO(out.getvalue())) as other:
            assert other.testzip() is None and other.read("a/b.txt") == b"hello" * 100 and other.namelist() == ["a/b.txt", "é.bin"]
        r = reader(out.getvalue())
        assert r.range("a/b.txt", 5, 7) == b"hellohe" and r.members["é.bin"].size == 0
        with pytest.raises(ValueError):
            r.range("a/b.txt", 499, 2)


def test_zip_of_others_with_comment_and_many_members():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for i in range(70_000):  # more than the 16-bit count holds
            z.writestr(f"m{i}", str(i))
        z.comment = b"PK\x05\x06 not the end"
    r = reader(out.getvalue())
    assert len(r.members) == 70_000 and r.range("m69999", 0, 5) == b"69999"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z, z.open("big", "w", force_zip64=True) as f:
        f.write(b"x" * 1000)
    with pytest.raises(ValueError):
        reader(out.getvalue()).range("big", 0, 1)
    for broken in (b"", b"PK", b"x" * 100, warc.END + struct.pack("<HHHHIIH", 0, 0, 1, 1, warc.FULL32, 0, 0)):
        with pytest.raises(ValueError):
            reader(broken)


def test_records():
    for refers in (None, 9):
        headers, http, payload = warc.parse_record(warc.record(3, "http://a b\n", b"<p>\r\n\r\n</p>", refers))
        assert headers["warc-payload-digest"] == "sha1:" + warc.payload_digest(b"<p>\r\n\r\n</p>")
        assert payload == (b"<p>\r\n\r\n</p>" if refers is None else b"") and b"Content-Length: 11" in http


@pytest.mark.parametrize("least", [0, 3])
def test_pages(spark, monkeypatch, least):
    monkeypatch.setattr(warc, "PACKAGE", 2000)
    rows = [(i, f"http://x/{i}", "<p>same</p>") for i in range(30)] + [(100, None, None), (101, "u", ""), (102, "u", "é" * 50000), (103, "u", "ab"), (104, "u", "ab"), (104, "u", "ab"), (105, "u", "other\r\n\r\n"), (103, "u", "a payload of its own")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id bigint, url string, html string, refs int").repartition(3)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(df, least).collect()), key=repr)
    want = []
    for i, _, h in rows:
        body = (h or "").encode()
        last = max(j for j, _, g in rows if (g or "").encode() == body)
        again = len(body) >= least and last != i
        want.append((i, len(body), warc.payload_digest(body), "revisit" if again else "response", last if again else None))
    assert got == sorted(want, key=repr)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_streamed_members_are_read_by_others_and_by_us():
    for zip64 in (True, False):
        out = io.BytesIO()
        z = warc.ZipWriter(out, zip64)
        z.open("a.txt")
        for part in (b"hello", b"", b" there"):
            z.write(part)
        z.end()
        z.add("b", b"more")
        z.close()
        with zipfile.ZipFile(io.BytesIO(out.getvalue())) as other:
            assert other.testzip() is None and other.read("a.txt") == b"hello there" and other.read("b") == b"more"
        r = reader(out.getvalue())
        assert r.range("a.txt", 2, 7) == b"llo the" and r.range("b", 0, 4) == b"more"


@pytest.mark.parametrize("kind", ["string", "int", "smallint"])
def test_ids_of_other_types(spark, kind):
    rows = [(1, "u", "same"), (2, "u", "same"), (10, "u", "same"), (None, "u", "same"), (3, None, None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr(f"cast(page_id as {kind}) page_id", "url", "html")
    if kind == "string":
        df = df.unionByName(spark.createDataFrame([("None", "u", "x"), ("a/b é:", "u", "x")], df.schema))
    got = warc.round_trip(df)
    assert got.schema["page_id"].dataType.simpleString() == got.schema["refers_to"].dataType.simpleString() == kind
    last = "2" if kind == "string" else 10
    own = str if kind == "string" else int
    want = [(own(i), None if own(i) == last else last) for i in (1, 2, 10)] + [(None, None), (own(3), None)] + ([("None", "a/b é:"), ("a/b é:", None)] if kind == "string" else [])
    assert sorted(((r.page_id, r.refers_to) for r in got.collect()), key=repr) == sorted(want, key=repr)
