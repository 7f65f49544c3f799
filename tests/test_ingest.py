"""Files of every kind the ingest boundary takes, on hand-made bytes."""

import io
import zipfile

import pytest

from weftline.sources import files

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
LINK = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def workbook(rows):
    cell = lambda v: f"<c t='inlineStr'><is><t>{v}</t></is></c>" if isinstance(v, str) else f"<c><v>{v}</v></c>"
    sheet = "".join("<row>" + "".join(map(cell, r)) + "</row>" for r in rows)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        book.writestr("xl/workbook.xml", f"<workbook xmlns='{MAIN}' xmlns:r='{LINK}'><sheets><sheet name='a' r:id='r1'/></sheets></workbook>")
        book.writestr("xl/_rels/workbook.xml.rels", "<Relationships><Relationship Id='r1' Target='worksheets/sheet1.xml'/></Relationships>")
        book.writestr("xl/worksheets/sheet1.xml", f"<worksheet xmlns='{MAIN}'><sheetData>{sheet}</sheetData></worksheet>")
    return out.getvalue()


def read(spark, tmp_path, content):
    path = tmp_path / "file.bin"
    path.write_bytes(content)
    rows, facts = files.read_any(spark, str(path))
    return rows.columns, [tuple(r) for r in rows.collect()], facts


def test_windows_1252(spark, tmp_path):
    columns, rows, facts = read(spark, tmp_path, b"n\xe4me;pr\x80is\n\x8eab\x81;\x99 1,5\n;\n")
    assert columns == ["näme", "pr€is"] and rows[0] == ("Žab\ufffd", "™ 1,5")
    assert facts["encoding"] == "windows-1252" and facts["sep"] == ";" and facts["format"] == "csv"


def test_utf8_with_mark_and_quotes(spark, tmp_path):
    columns, rows, facts = read(spark, tmp_path, "\ufeffa,b\r\n\"x\ny\",\"é \"\"q\"\"\"\r\n1,\r\n".encode())
    assert columns == ["a", "b"] and rows == [("x\ny", 'é "q"'), ("1", "")] and facts["encoding"] == "utf-8"


def test_character_over_the_65536th_byte(spark, tmp_path):
    columns, _, facts = read(spark, tmp_path, ("a" * 65535 + "é,b\n1,2\n").encode())
    assert facts["encoding"] == "utf-8" and facts["sep"] == "," and columns[0].endswith("é")


def test_workbook(spark, tmp_path):
    columns, rows, facts = read(spark, tmp_path, workbook([["id", "weight"], ["x", 3.0], [], ["y", 1.5, "beyond"], ["z"]]))
    assert facts["format"] == "xlsx" and columns == ["id", "weight"]
    assert rows == [("x", "3"), ("y", "1.5"), ("z", "")]


def test_broken_workbook():
    with pytest.raises(files.UnsupportedFormatError):
        list(files.workbook_rows(b"PK\x03\x04 not a workbook"))
