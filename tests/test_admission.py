"""Admission: identity, the immutable store, the gate, whole folders, and two admissions at once."""

import csv
import io
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from test_ingest import workbook

from weftline.functions import reference as R
from weftline.sources import admission, files
from weftline.streaming.admission import watch

NAMES = [n for n, _ in R.SOURCE_SCHEMA]
ROW = ["7", "STY", "SKU", "shell", "cotton", "100 CO", "200g", "Acme", "PT", "15/01/2024", "1", "9.5"]


def content(names=NAMES, rows=(ROW,), encoding="utf-8", sep=","):
    out = io.StringIO(newline="")
    csv.writer(out, delimiter=sep).writerows([names, *rows])
    return out.getvalue().encode(encoding)


def put(folder: Path, name: str, raw: bytes) -> str:
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(raw)
    return str(folder / name)


def stored(store: Path):
    return sorted(p.name for p in (store / "raw").iterdir() if not p.name.startswith("."))


def test_accepted_then_duplicate_then_rerun(spark, tmp_path):
    store = tmp_path / "store"
    path = put(tmp_path, "first.csv", content())
    got = admission.admit(spark, path, str(store))
    assert (got.status, got.format, got.encoding) == ("accepted", "csv", "utf-8") and got.rows.columns == NAMES
    assert (store / "raw" / f"{got.content_hash}.csv").read_bytes() == content()
    before = admission.registry(spark, str(store)).collect()
    again = admission.admit(spark, put(tmp_path, "second.csv", content()), str(store))
    assert again.status == "duplicate" and again.content_hash == got.content_hash and again.rows is None
    assert admission.registry(spark, str(store)).collect() == before and before[0]["filename"] == "first.csv"
    assert admission.admit(spark, path, str(store), rerun=True).status == "accepted"
    assert len(stored(store)) == 1 and admission.registry(spark, str(store)).count() == 1


def test_renamed_header_and_baseline(spark, tmp_path):
    store = str(tmp_path / "store")
    drift = admission.admit(spark, put(tmp_path, "drift.csv", content(["vendor" if n == "supplier" else n for n in NAMES])), store)
    assert (drift.status, drift.renames, drift.added, drift.removed) == ("review_required", {"vendor": "supplier"}, ["vendor"], ["supplier"])
    assert [(r["name"], r["dtype"]) for r in admission.baseline(spark, store).orderBy("pos").collect()] == [tuple(x) for x in R.SOURCE_SCHEMA]
    empty = admission.admit(spark, put(tmp_path, "empty.csv", content(rows=[])), store)
    assert empty.status == "accepted"
    # The last accepted schema counts, and its columns were empty.
    assert {r["dtype"] for r in admission.baseline(spark, store).collect()} == {"empty"}
    assert admission.admit(spark, put(tmp_path, "typed.csv", content()), store).type_changed == NAMES


def test_windows_1252_and_workbook(spark, tmp_path):
    store = str(tmp_path / "store")
    foreign = [*ROW[:7], "Sté Générale", *ROW[8:]]
    got = admission.admit(spark, put(tmp_path, "vendor.csv", content(rows=[foreign], encoding="cp1252", sep=";")), store)
    assert (got.status, got.encoding) == ("accepted", "windows-1252") and got.rows.first()["supplier"] == "Sté Générale"
    book = admission.admit(spark, put(tmp_path, "book.xlsx", workbook([NAMES, [float(x) if x in ("7", "1", "9.5") else x for x in ROW]])), store)
    assert (book.status, book.format, book.encoding) == ("accepted", "xlsx", "utf-8")


def test_broken_workbook_leaves_nothing(spark, tmp_path):
    store = tmp_path / "store"
    with pytest.raises(files.UnsupportedFormatError):
        admission.admit(spark, put(tmp_path, "book.xlsx", b"PK\x03\x04 no workbook"), str(store))
    assert not store.exists()


def test_folder_in_one_call(spark, tmp_path):
    inbox, store = tmp_path / "in", str(tmp_path / "store")
    more = [[str(i), *ROW[1:5], 'quoted "x"\nand a line', *ROW[6:]] for i in range(40)]
    put(inbox, "a.csv", content(rows=more))
    put(inbox, "b.csv", content())
    put(inbox, "c copy of b.csv", content())
    put(inbox, "d.csv", content(["vendor" if n == "supplier" else n for n in NAMES], sep=";"))
    put(inbox, "e.xlsx", b"PK\x03\x04 no workbook")
    put(inbox, "f.xlsx", workbook([NAMES[::-1], ROW[::-1]]))
    put(inbox, "g.csv", content(NAMES[:-1], [r[:-1] for r in more]))
    got = admission.admit_all(spark, str(inbox), store)
    assert [(a.path.rsplit("/", 1)[-1], a.status) for a in got] == [("a.csv", "accepted"), ("b.csv", "accepted"), ("c copy of b.csv", "duplicate"), ("d.csv", "review_required"), ("e.xlsx", "unsupported"), ("f.xlsx", "accepted"), ("g.csv", "review_required")]
    assert got[3].renames == {"vendor": "supplier"} and got[6].removed == [NAMES[-1]]
    assert admission.registry(spark, store).count() == 5
    assert [a.status for a in admission.admit_all(spark, str(inbox), store)].count("duplicate") == 6


def test_two_at_once_register_once(spark, tmp_path):
    store, path = str(tmp_path / "store"), put(tmp_path, "f.csv", content())
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda _: admission.admit(spark, path, store).status, range(4)))
        assert sorted(got) == ["accepted", "duplicate", "duplicate", "duplicate"]
        won = list(pool.map(lambda i: admission.put_if_absent(spark, f"{store}/one", str(i)), range(20)))
    assert won.count(True) == 1 and Path(f"{store}/one").read_text() == str(won.index(True))
    assert admission.entries(spark, store).count() == 1 and len(stored(Path(store))) == 1


def test_stream_admits_each_content_once(spark, tmp_path):
    inbox, store = tmp_path / "in", str(tmp_path / "store")
    put(inbox, "a.csv", content())
    put(inbox, "b.csv", content())
    watch(spark, str(inbox), store, str(tmp_path / "cp")).awaitTermination()
    put(inbox, "c.csv", content())
    put(inbox, "d.csv", content(rows=[]))
    watch(spark, str(inbox), store, str(tmp_path / "cp")).awaitTermination()
    assert sorted((r["filename"], r["status"]) for r in admission.registry(spark, store).collect()) == [("a.csv", "pending"), ("d.csv", "pending")]
    assert admission.admit(spark, str(inbox / "a.csv"), store).status == "duplicate"


def test_workbooks_with_columns_in_other_orders(spark, tmp_path):
    put(tmp_path, "1.xlsx", workbook([["id", "weight"], ["a", 1.0]]))
    put(tmp_path, "2.xlsx", workbook([["weight", "note", "id"], [2.5, "n", "b"], [3.0]]))
    found = files.read_workbook(spark, str(tmp_path))
    assert found.columns == ["id", "weight", "note"]
    assert sorted(map(tuple, found.collect())) == [("", "3", ""), ("a", "1", ""), ("b", "2.5", "n")]
