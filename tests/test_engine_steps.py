"""Steps that read a row's own cells instead of dealing its events: the same results as over the events."""

import json

import pytest
from pyspark.sql import functions as F

from tests.test_engine_rows import RAW, lines
from weftline.operators import anomalies, ledger, mart, materialize, review
from weftline.plans import pipeline, registry


@pytest.fixture(scope="module")
def run(spark):
    return pipeline.run(spark.createDataFrame(lines(), RAW), content_hash="abc", created_at="2026-01-01")


def test_ledger_of_rows(spark, run, tmp_path):
    """rows sorted and packed give the text that sorted entries give."""
    ledger.write_jsonl(run.ledger(), str(tmp_path / "entries"))
    ledger.write_rows_jsonl(run.components, "abc", run.version(), "2026-01-01", str(tmp_path / "rows"))
    one, other = (ledger.read_jsonl(spark, str(tmp_path / p)).orderBy("n").collect() for p in ("entries", "rows"))
    assert one == other and len(one) > 50
    assert all(p.name.endswith(".gz") for p in (tmp_path / "rows").glob("part-*"))


def test_lines_are_numbered_over_files_and_blanks(spark, tmp_path):
    line = lambda i: json.dumps({k.split()[0]: None for k in ledger.LINE.split(", ")} | {"event_id": str(i)})
    for f in range(3):
        (tmp_path / f"part-{f}.txt").write_text("\n \n".join(line(10 * f + i) for i in range(4 - f)) + "\n")
    got = [(r["n"], r["event_id"]) for r in ledger.read_jsonl(spark, str(tmp_path)).orderBy("n").collect()]
    assert got == list(enumerate(["0", "1", "2", "3", "10", "11", "12", "20", "21"], 1))


def test_explanation_adds_up_once(spark, tmp_path):
    """a mart that comes out otherwise each time it is worked out still meets its closed form."""
    rows = spark.createDataFrame([("v1", "wool", 1.0), ("v2", "wool", 1.25)], "vintage string, material string, factor double")
    shaky = rows.withColumn("mass_kg", 1e9 + 1e3 * F.udf(lambda: __import__("random").random(), "double").asNondeterministic()()).withColumn("footprint_kgco2e", F.col("mass_kg") * F.col("factor"))
    one = mart.explanation(shaky, shaky, "wool").first()
    assert one["pipeline"]["intensity_matches_factor_bump"] and one["ground_truth"]["intensity_matches_factor_bump"]


def test_trace_without_events(run):
    """what a row tells of itself is what its events tell."""
    by_id = lambda df: sorted(df.collect(), key=lambda r: r["id"])
    assert by_id(ledger.trace(run.components)) == by_id(ledger.trace(run.components, run.events))


def test_cell_heads(spark, run):
    """heads from rows with an alias and a single correction, against the lineage of their events."""
    rules = spark.createDataFrame([(None, "alias:Organic cottn", "v1", "reference_resolve", "r0006", "material_normalized", "organic cotton", "Organic cottn", "a", "", ""), (None, "approve:x", "v1", "reference_resolve", "r0009", "material_normalized", "wool", None, "b", "n", "t"), (None, "approve:y", "v1", "reference_resolve", "r0005", "component_weight_g", "7.5", None, "b", "n", "t")], "place string, rule_id string, rule_version string, source_type string, record_id string, column string, value string, key string, actor string, note string, at string")
    out = review.applied(run.records, rules)
    events = ledger.normalize_events(run.records).unionByName(review.approval_events(out))
    want = ledger.lineage(events).select("id", "record_id", F.explode("data_lineage").alias("column", "head"))
    key = lambda r: (r["id"], r["column"])
    got = sorted(review.cell_heads(out).collect(), key=key)
    assert got == sorted(want.collect(), key=key) and {r["head"]["rule_id"] for r in got} >= {"alias:Organic cottn", "approve:x", "approve:y"}


def test_categories_alone_start_no_other_jobs(spark, run, monkeypatch):
    """findings of single rows; neither keys are numbered nor logarithms gathered."""
    want = anomalies.detect(run.records).where("category = 'validity' or category = 'cross_field'").collect()
    monkeypatch.setattr(anomalies, "staged", None)
    assert sorted(anomalies.detect(run.records, ("validity", "cross_field")).collect()) == sorted(want)


def test_occurrences(spark):
    """F8: keys met once are left out of the numbering, nulls are keys like others."""
    rows = [(i, None if i % 3 == 0 else "s", f"k{i % 50}" if i < 200 else f"u{i}", "c") for i in range(260)]
    df = spark.createDataFrame(rows, "id long, style_id string, sku string, component string")
    seen, want = {}, {}
    for i, *key in rows:
        seen[tuple(key)] = seen.get(tuple(key), 0) + 1
        want[i] = seen[tuple(key)]
    assert {r["id"]: r["nth"] for r in anomalies.occurrences(df).collect()} == want
    assert anomalies.repeated(df)[1].count() == sum(n for n in seen.values() if n > 1)


def test_record_ids(spark):
    ids = spark.createDataFrame([(i,) for i in (0, 7, 999, 1000, 12345678901, -5)], "id long")
    got = ids.select(materialize.P.record_id(F.col("id"))).collect()
    assert [r[0] for r in got] == ["r0000", "r0007", "r0999", "r1000", "r12345678901", "r-005"]


def test_net_without_suppliers(spark, small, monkeypatch):
    """findings and decisions of the narrow rows are those of all rows; suppliers aren't looked up for them."""
    _, found, decisions = registry.net(spark, small)
    want = [sorted(map(str, df.collect())) for df in (found, decisions)]
    match, seen = materialize.matched_spellings, []
    monkeypatch.setattr(materialize, "matched_spellings", lambda rows, column, *a: seen.append((column, "supplier_raw" in rows.columns)) or match(rows, column, *a))
    got = registry.read_net(spark, small)
    assert [sorted(map(str, df.select(*of.columns).collect())) for df, of in zip(got, (found, decisions), strict=True)] == want
    assert seen == [("material_raw", False)] and want[1]
