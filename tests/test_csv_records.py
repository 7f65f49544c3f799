"""CSV files in tiny blocks, so that borders fall anywhere, against the standard library's reader."""

import csv
import io

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.sources import csv_records, files

ODD = ['plain', 'a,b', 'line\nbreak', '"quoted"', 'x\r\ny', '', ' spaced ', '5" pipe', ',",\n"', '\n\n\n', 'é€', "long " * 30]


@pytest.fixture
def tiny_blocks(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "97b", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def table(n):
    return [[str(i), ODD[i % len(ODD)], ODD[(i * 7 + i // 12) % len(ODD)]] for i in range(n)]


def written(rows, newline="\r\n"):
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator=newline).writerows(rows)
    return out.getvalue()


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_round_trip_in_tiny_blocks(spark, tmp_path, tiny_blocks, newline):
    rows = table(150)
    for k in range(2):
        (tmp_path / f"{k}.csv").write_bytes(written([["id", "a", "b"], *[[f"{k}-{r[0]}", *r[1:]] for r in rows]], newline).encode())
    found = files.read_csv(spark, str(tmp_path))
    assert csv_records.lines_of(spark, str(tmp_path)).select("file", "block").distinct().count() > 40
    assert found.columns == ["id", "a", "b"]
    assert sorted(map(tuple, found.collect())) == sorted((f"{k}-{r[0]}", *r[1:]) for k in range(2) for r in rows)


def test_cells_longer_than_blocks(spark, tmp_path, tiny_blocks):
    rows = [["1", "x\n" * 400, "end"], ["2", "short", ""], ["3", '"\n",' * 100, "y"], ["4", "z", "\n"]]
    (tmp_path / "f.csv").write_bytes(written([["id", "a", "b"], *rows]).encode())
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "f.csv")).collect())) == [tuple(r) for r in rows]


def test_short_and_long_rows_stray_quotes_and_header(spark, tmp_path):
    text = 'id,"two\nlines",id,\n1\n2,5" pipe,x,y,beyond\n\n3,"open ""q"", still",,\n4,"never closed\nto the end,z\n'
    (tmp_path / "f.csv").write_text(text)
    found = files.read_csv(spark, str(tmp_path / "f.csv"))
    assert found.columns == ["id0", "two\nlines", "id2", "_c3"]
    got = sorted(map(tuple, found.collect()))
    assert got[:3] == [("1", "", "", ""), ("2", '5" pipe', "x", "y"), ("3", 'open "q", still', "", "")] and got[3][0] == "4" and len(got) == 4


def test_separator_charset_and_empty_files(spark, tmp_path):
    (tmp_path / "f.csv").write_bytes('n;"pr;\x80is"\r\n\x8eab;"\x99\r\n1;5"\r\n'.encode("latin-1"))
    found = files.read_csv(spark, str(tmp_path / "f.csv"), ";", "windows-1252")
    assert found.columns == ["n", "pr;€is"] and [tuple(r) for r in found.collect()] == [("Žab", "™\r\n1;5")]
    (tmp_path / "e.csv").write_bytes(b"a,b\n")
    assert files.read_csv(spark, str(tmp_path / "e.csv")).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.text('a",\n', max_size=6), min_size=2, max_size=3), min_size=1, max_size=6), st.integers(1, 9))
def test_any_split_into_blocks(rows, size):
    """Composing the bits of blocks says of every line whether it begins inside quotes, as the whole file does."""
    lines = written(rows, "\n").encode().split(b"\n")[:-1]
    state, truth = False, []
    for line in lines:
        truth.append(state)
        state = csv_records.ends_inside(line, state, b",")
    assert not state and truth.count(False) == len(rows)
    begin = False
    for at in range(0, len(lines), size):
        assert begin == truth[at]
        both = []
        for s in (False, True):
            for line in lines[at : at + size]:
                s = csv_records.ends_inside(line, s, b",")
            both.append(s)
        begin = both[begin]
