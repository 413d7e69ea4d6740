"""CSV files and rows that can't be read."""

import pytest

from quarryline.sources.quarantine import scan_with_refusals
from quarryline.sources.texts import first_look, in_utf8


@pytest.fixture
def folder(tmp_path):
    files = {
        "a.csv": b'id,name,n\n1,"x, y",2\n2,z\n3,z,4,5\n4,"a ""q"", b",7\n,,\n',
        "b.csv": "id,name,n\n5,ä,6\n".encode(),
        "c.csv": b"id,other,n\n6,b,7\n",
        "d.csv": "id,name,n\n7,中文,8\n".encode("gb18030"),
        "e.csv": b"id,name,n\n8,\xff\x80,9\n",
        "f.csv": b"\xef\xbb\xbfid,name,n\n9,bom,1\n",
        "g.csv": b"id,name,n\n",
    }
    for name, raw in files.items():
        (tmp_path / name).write_bytes(raw)
    return tmp_path


def names(rows):
    return sorted((r[0].rsplit("/", 1)[-1], *r[1:]) for r in rows)


@pytest.mark.parametrize("short", [False, True])
def test_rows_and_refusals(spark, folder, short):
    rows, refused = scan_with_refusals(spark, str(folder), short_rows=short)
    got = sorted((r["id"] or "", r["name"], r["n"]) for r in rows.collect())
    few = [] if short else [("2", "z", None)]
    assert got == sorted([("", None, None), ("1", "x, y", "2"), ("4", 'a "q", b', "7"), ("5", "ä", "6"), ("9", "bom", "1"), *few])
    want = [("a.csv", "too_many_fields", "3,z,4,5"), ("c.csv", "other_header", None), ("d.csv", "gb18030", None), ("e.csv", "undecodable", None)]
    assert names(refused.select("file", "reason", "line").collect()) == sorted(want + [("a.csv", "too_few_fields", "2,z")] * short)


def test_a_look_at_files(spark, folder):
    (folder / "h.csv").write_text('id,name,n\n1,"two\nlines",3\n')
    got = {r.file.rsplit("/", 1)[-1]: (r.header, r.utf8, r.quoted_lines) for r in first_look(spark, str(folder)).collect()}
    assert got["a.csv"] == ("id,name,n", True, False) and got["h.csv"] == ("id,name,n", True, True)
    assert got["f.csv"] == ("id,name,n", True, False) and not got["d.csv"][1] and not got["e.csv"][1]


def test_quoted_line_ends(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name\n1,"two\nlines"\n2,b,c\n')
    rows, refused = scan_with_refusals(spark, str(tmp_path))
    assert [(r["id"], r["name"]) for r in rows.collect()] == [("1", "two\nlines")]
    assert [(r.reason, r.line) for r in refused.collect()] == [("too_many_fields", "2,b,c")]


def test_files_in_utf8_are_left_where_they_are(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id\né\n", encoding="utf-8")
    assert in_utf8(spark, str(tmp_path)) == str(tmp_path)
    (tmp_path / "b.csv").write_bytes("id\n中\n".encode("gb18030"))
    assert in_utf8(spark, str(tmp_path)) != str(tmp_path)
    (tmp_path / "c.csv").write_bytes(b"id\n\xff\xff\n")
    with pytest.raises(ValueError, match="neither"):
        in_utf8(spark, str(tmp_path))
