"""What queries leave on disk, and that they give the same rows with less of it."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from weftline.operators import anomalies, fill, footprint, ledger, mart
from weftline.operators import materialize as M
from weftline.plans import registry
from weftline.sources.workload import bom_lines
from weftline.staging import fresh_path, passing, shared_dir, staged


@pytest.fixture
def made(spark):
    """Names of the folders made since the test began, without their ids."""
    folder = lambda: {p.name for p in Path(shared_dir(spark).removeprefix("file:")).iterdir()}
    before = folder()
    return lambda: sorted(n.rsplit("-", 1)[0] for n in folder() - before)


def test_passing_removes_what_was_staged_within(spark, made):
    kept = fresh_path(spark, "kept")
    with pytest.raises(ValueError, match="stop"), passing(spark):
        staged(spark.range(3), "outer")
        with passing(spark):
            staged(spark.range(3), "inner").write.parquet(kept)
        assert made() == ["kept", "outer"]
        raise ValueError("stop")
    assert made() == ["kept"] and spark.read.parquet(kept).count() == 3


def test_ledger_query_keeps_its_result_alone(spark, small, made):
    """neither rows, nor lookups, nor the text stay, and of the lines the columns that are asked for."""
    out = registry.QUERIES["ledger_jsonl"](spark, small)
    assert made() == ["ledger-blocks", "ledger-lines"]
    columns = spark.read.parquet(out.inputFiles()[0]).columns + spark.read.parquet(out.inputFiles()[-1]).columns
    assert "value_before" in columns and "method_params" not in columns
    n = out.count()
    assert out.agg(F.min("n"), F.max("n"), F.count_distinct("n")).first() == (1, n, n) and n > 20000


def test_ledger_of_rows_costed_after_sorting(spark, small, tmp_path):
    """rows dealt raw and costed afterwards give the lines of costed rows, over several files a stage."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        cells = staged(M.cells(M.materialize(bom_lines(spark, small))).drop("composition_parts"), "cells")
        cells = M.with_suppliers(cells)
        ledger.write_rows_jsonl(footprint.components(fill.fill(cells)), "w", "v", "t", str(tmp_path / "one"))
        picked = fill.picked(cells).drop("band_low", "band_high", "ref_g")
        ledger.write_rows_jsonl(picked, "w", "v", "t", str(tmp_path / "other"), lambda rows: footprint.components(fill.outcome(fill.banded(rows))))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    one, other = (ledger.read_jsonl(spark, str(tmp_path / p)).orderBy("n").collect() for p in ("one", "other"))
    assert one == other and len(one) > 20000
    ids = [int(r["record_id"][1:]) for r in one if r["rule_id"] == "footprint"]
    assert ids == sorted(ids)
    for stage, slices in ((0, ledger.SLICES), (3, 1), (4, 1)):
        found = [list(p.glob("part-*")) for p in (tmp_path / "other" / f"stage={stage}").glob("slice=*")]
        assert len(found) == slices and all(len(files) > 1 and all(p.name.endswith(".gz") for p in files) for files in found)


def test_slices_hold_all_rows_in_order(spark):
    """each row lies in one slice, nulls in the first; repeated ids and frames with few rows make fewer slices."""
    for ids in ([None, *range(-50, 50), *[7] * 500], [3], [], [None]):
        parts = [[r[0] for r in p.collect()] for p in ledger.sliced(spark.createDataFrame([(i,) for i in ids], "id long"), 4)]
        key = lambda i: (i is not None, i or 0)
        assert [i for p in parts for i in sorted(p, key=key)] == sorted(ids, key=key) and 1 <= len(parts) <= 4


def test_lines_are_numbered_over_blocks(spark, tmp_path):
    """Blocks of one file that are read, and staged, in pieces."""
    line = lambda i: json.dumps({k.split()[0]: None for k in ledger.LINE.split(", ")} | {"event_id": str(i)})
    (tmp_path / "part-0.txt").write_text("\n".join(map(line, range(60))) + "\n")
    settings = {"spark.sql.files.maxPartitionBytes": "4000", "spark.sql.files.maxRecordsPerFile": "3"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        got = [tuple(r) for r in ledger.read_jsonl(spark, str(tmp_path), ["event_id"]).orderBy("n").collect()]
    finally:
        for k in settings:
            spark.conf.unset(k)
    assert got == [(i + 1, str(i)) for i in range(60)]


def test_explanation_puts_its_rows_together_once(spark, small, made, monkeypatch):
    """both marts of both periods rest on one staged table, which goes once the document is written."""
    lines, write, seen, there = registry.bom_lines, mart.write_document, [], []
    monkeypatch.setattr(registry, "bom_lines", lambda *a: seen.append(1) or lines(*a))
    monkeypatch.setattr(mart, "write_document", lambda *a: there.extend(made()) or write(*a))
    assert registry.QUERIES["explanation"](spark, small).count() > 8
    assert len(seen) == 1 and made() == ["explanation"]
    assert "rows" in there and not {"cells", "production-lines", "repeated-keys"} & set(there)


def test_first_rows_of_keys(spark):
    """the rows that are numbered 1, nulls being keys like others, and one key that many rows have."""
    rows = [(i, None if i % 3 else "s", f"k{i % 50}" if i < 200 else "hot", "c", i % 7) for i in range(2000, -1, -1)]
    df = spark.createDataFrame(rows, "id long, style_id string, sku string, component string, quantity long").repartition(7)
    want = anomalies.occurrences(df, "quantity").where("nth = 1").drop("nth")
    got = anomalies.firsts(df, "quantity").select(want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 50
