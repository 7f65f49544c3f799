"""Engine operators on hand-made rows: numbering, ledger, trace, review, mart."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftline.operators import anomalies, fill, footprint, ledger, mart, materialize, numbering, review
from weftline.plans import pipeline
from weftline.staging import staged

RAW = "source_row_id string, style_id string, sku string, component string, material string, composition string, net_weight string, supplier string, country string, order_date string, quantity string, unit_price string"


def lines():
    row = lambda i, component="button", material="cotton", weight="5 g", style="AAA-01": (str(i), style, f"s{i}", component, material, "100% cotton", weight, "ACME TEXTILES", "china", "2024-01-31", "3", "1.5")
    return [*[row(i, weight=f"{w} g") for i, w in enumerate((4, 5, 5, 5, 6))], row(5, weight=""), row(6, "zipper", "Organic cottn", ""), row(7, "unheard of", "brass", "", "BBB-01"), row(8, weight="900 g"), row(9, material="plastic")]


@pytest.fixture(scope="module")
def run(spark):
    return pipeline.run(spark.createDataFrame(lines(), RAW), content_hash="abc", created_at="2026-01-01")


def test_fill_ladder(run):
    got = {r["id"]: (r["tier"], r["weight_g"], r["fill_low"], r["fill_high"], r["quality_status"]) for r in run.components.collect()}
    assert got[0][:2] == (None, 4.0)
    assert got[5] == ("grouped_median", 5.0, 4.5, 5.5, "ok")  # 4 5 5 5 6 and 900: distances 0 0 0 1 1 895
    assert got[6] == ("reference_constant", 16.0, 7.0, 48.0, "ok")  # the category's median of 5 lies outside the band
    assert got[7] == (None, None, None, None, "action_required") and got[8][4] == "flagged"


def test_findings(run):
    found = {(r["id"], r["category"], r["column"]) for r in run.findings.collect()}
    assert {(6, "mapping", "material_normalized"), (7, "completeness", "component_weight_g"), (8, "plausibility", "component_weight_g"), (9, "mapping", "estimated_kgco2e")} <= found


def test_ledger_text_and_look_up(spark, run, tmp_path):
    whole = run.ledger()
    ledger.write_jsonl(whole, str(tmp_path / "text"))
    parts = sorted(p for p in (tmp_path / "text").iterdir() if p.suffix == ".txt")
    written = [json.loads(x) for p in parts for x in p.read_text().splitlines()]
    want = [r.asDict() for r in whole.orderBy(*ledger.ORDER).collect()]
    assert [(w["event_id"], w["value_after"]) for w in written] == [(w["event_id"], w["value_after"]) for w in want]
    assert sorted(written[0]) == sorted("event_id run_id record_id column rule_id rule_version source_type method_params value_before value_after is_original_null uncertainty_range created_at".split())
    back = ledger.read_jsonl(spark, str(tmp_path / "text")).orderBy("n").collect()
    assert [r["n"] for r in back] == list(range(1, len(want) + 1)) and [r["event_id"] for r in back] == [w["event_id"] for w in written]
    assert {r["record_id"]: r["uncertainty_range"] for r in back if r["rule_id"] == "weight_constant"} == {"r0006": [7.0, 48.0]}
    ledger.append(whole, str(tmp_path / "table"))
    ledger.append(whole.withColumn("run_id", F.lit("later")), str(tmp_path / "table"))
    found = ledger.for_record(ledger.table(spark, str(tmp_path / "table")).where("run_id = 'later'"), "r0006")
    assert [r["event_id"] for r in found.collect()] == [w["event_id"] for w in want if w["record_id"] == "r0006"]
    assert found.select(F.input_file_name().alias("f")).distinct().count() == 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters")[1].split("]")[0] and "EqualTo(record_id,r0006)" in plan


def test_trace(run):
    doc = {r["id"]: r for r in ledger.trace(run.components, run.events).collect()}
    assert 7 not in doc and 9 not in doc
    one = doc[5]
    assert (one["record_id"], one["source_row_id"], one["weight_source"], one["uncertainty"]) == ("r0005", "5", "filled", pytest.approx([one["estimate"] * 0.9, one["estimate"] * 1.1]))
    assert one["raw"]["supplier"] == "ACME TEXTILES" and one["raw"]["net_weight"] == "" and set(one["raw"]) == {c.split()[0] for c in RAW.split(", ")}
    assert [e["rule_id"] for e in one["events"]] == ["amount_coerce", "amount_coerce", "composition_parse", "date_iso", "country_iso", "supplier_fuzzy", "material_vocab", "weight_median", "footprint"]
    assert one["material_lineage"] == [("normalize_material", "material_vocab")]


def test_review_and_alias(spark, run):
    mapping = run.findings.where("category = 'mapping' and column = 'material_normalized'")
    log = spark.createDataFrame([], review.DECISIONS)
    assert {r["status"] for r in review.current(mapping, log).collect()} == {"pending"}
    ids = [r["finding_id"] for r in mapping.collect()]
    log = review.decide(review.decide(log, ids, "rejected", "a", "no"), ids[:1], "approved", "b", "yes", "later")
    item = review.get(mapping, log, ids[0]).collect()
    assert len(item) == 1 and item[0]["status"] == "approved" and [h["status"] for h in item[0]["history"]] == ["rejected", "approved"]
    assert review.pending(mapping, log).count() == 0 and review.get(mapping, log, "none").count() == 0
    with pytest.raises(ValueError):
        review.decide(log, ids, "perhaps", "a")
    again = pipeline.run(spark.createDataFrame(lines(), RAW), approvals=review.approved_rules(mapping, log))
    doc = {r["id"]: r for r in ledger.trace(again.components, again.events).collect()}
    assert doc[6]["material"] == "organic cotton" and [m["source_type"] for m in doc[6]["material_lineage"]] == ["normalize_material", "reference_resolve"]


def test_numbers_of_hot_keys(spark):
    """Half of the rows share a key, and its rows lie in many slices."""
    rows = [(i, None if i % 2 else f"k{i % 40}", "") for i in range(4000)]
    df = staged(spark.createDataFrame(rows, "id long, a string, b string").repartition(5), "rows")
    got = {r["id"]: r["nth"] for r in numbering.numbered(df, ["a", "b"], ["id"], "nth").collect()}
    seen, want = Counter(), {}
    for i, a, b in rows:
        seen[a, b] += 1
        want[i] = seen[a, b]
    assert got == want
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sliced = numbering.numbered(df, ["a", "b"], ["id"], "nth")
        assert {r["id"]: r["nth"] for r in sliced.collect()} == want
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert numbering.numbered(df.where("false"), ["a"], ["id"], "nth").count() == 0


def test_duplicates(spark):
    rows = [(3, "r0003", "s", "k", "c"), (1, "r0001", "s", "k", "c"), (2, "r0002", "s", "k", "d"), (9, "r0009", "s", "k", "c")]
    found = anomalies.duplicates(spark.createDataFrame(rows, "id long, record_id string, style_id string, sku string, component string")).orderBy("id").collect()
    assert [(r["finding_id"], r["message"]) for r in found] == [(f"{r}:-:duplicate_key", "duplicate (style, sku, component) s, k, c") for r in ("r0003", "r0009")]


def test_vintage_is_replaced_alone(spark, tmp_path):
    kinds = "id long, vintage string, record_id string, material string, quantity long, weight_kg double, factor double, mass_kg double, footprint_kgco2e double"
    made = lambda vintage, mass, factor, n=1: spark.createDataFrame([(i, vintage, f"r{i}", "cotton", 1, mass, factor, mass, mass * factor) for i in range(n)], kinds)
    path = str(tmp_path / "lines")
    for frame in (made("v1", 2.0, 3.0), made("v2", 4.0, 3.5, 2), made("v1", 5.0, 3.0)):
        mart.keep_lines(frame, path)
    table = mart.kept_lines(spark, path)
    assert sorted((r["vintage"], r["mass_kg"]) for r in table.collect()) == [("v1", 5.0), ("v2", 4.0), ("v2", 4.0)]
    assert "vintage" in table.where("vintage = 'v1'")._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1].split("]")[0]
    total = mart.decompose(mart.models(table)["mart"]).first()
    assert (total["f_from"], total["f_to"], total["intensity_effect"], total["volume_mix_effect"], total["reconciles"]) == (15.0, 28.0, 2.5, 10.5, True)


def test_truth_round_trip(spark, tmp_path):
    mart.write_truth(spark.createDataFrame([("cotton", 1.25), ('odd, "name"', 3.0)], mart.TRUTH), str(tmp_path / "a"))
    assert sorted(map(tuple, mart.read_truth(spark, str(tmp_path / "a")).collect())) == [("cotton", 1.25), ('odd, "name"', 3.0)]
    (tmp_path / "b.csv").write_text("note,kg,fibre\nx,2.5,wool\n")
    assert [tuple(r) for r in mart.read_truth(spark, str(tmp_path / "b.csv"), {"kg": "mass_kg", "fibre": "material"}).collect()] == [("wool", 2.5)]
    with pytest.raises(ValueError, match="mass_kg"):
        mart.read_truth(spark, str(tmp_path / "b.csv"))
    (tmp_path / "c.csv").write_text("material,mass_kg\nwool,much\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|much"):
        mart.read_truth(spark, str(tmp_path / "c.csv")).collect()


def test_explanation_document(spark, tmp_path):
    rows = [("v1", "wool", 10.0, 1.0, 10.0), ("v2", "wool", 20.0, 1.25, 25.0), ("v1", "silk", 5.0, 1.0, 5.0), ("v2", "brass", 1.0, 3.0, 3.0)]
    made = spark.createDataFrame(rows, mart.MART)
    mart.write_truth(made.where("material = 'wool'"), str(tmp_path / "truth"), mart.MART)
    truth = mart.read_truth(spark, str(tmp_path / "truth"), columns=mart.MART)
    assert sorted(map(tuple, truth.collect())) == sorted(r for r in rows if r[1] == "wool")
    mart.write_document(mart.explanation(made, truth, "wool"), str(tmp_path / "doc"))
    files_ = list((tmp_path / "doc").glob("*.json"))
    doc = json.loads(files_[0].read_text())
    assert len(files_) == 1 and set(doc) == {"pipeline", "ground_truth", "agreement_vs_ground_truth", "by_material"}
    assert doc["pipeline"] == {"f_from": 15.0, "f_to": 28.0, "observed_delta": 13.0, "intensity_effect": 2.5, "volume_mix_effect": 10.5, "residual": 0.0, "reconciles": True, "intensity_matches_factor_bump": True}
    assert doc["agreement_vs_ground_truth"] == {"delta_gap": 0.1333, "intensity_gap": 0.0, "volume_mix_gap": 0.16}
    assert [m["material"] for m in doc["by_material"]["pipeline"]] == ["brass", "silk", "wool"] and len(doc["by_material"]["ground_truth"]) == 1
    back = mart.read_document(spark, str(tmp_path / "doc")).collect()
    assert [r.asDict(recursive=True) for r in back] == [doc]
    none = mart.explanation(made.limit(0), truth, "wool").first()
    assert none["pipeline"]["f_from"] == 0.0 and none["by_material"]["pipeline"] == [] and not none["pipeline"]["intensity_matches_factor_bump"]
    (tmp_path / "no.json").write_text('{"pipeline": "text"}')
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        mart.read_document(spark, str(tmp_path / "no.json")).collect()


def test_decide_all(spark):
    log = spark.createDataFrame([(0, "b", "approved", "x", "", ""), (1, "a", "rejected", "x", "", "")], review.DECISIONS)
    items = spark.createDataFrame([(f"k{i % 300:03d}",) for i in range(900)] + [(None,), ("a",)], "finding_id string")
    more = review.decide_all(log, items, "rejected", "y", "bulk", "now").orderBy("seq").collect()
    assert [(r["seq"], r["finding_id"]) for r in more] == [(0, "b"), (1, "a"), (2, "a"), *[(3 + i, f"k{i:03d}") for i in range(300)]]
    assert {(r["status"], r["actor"], r["note"], r["at"]) for r in more[2:]} == {("rejected", "y", "bulk", "now")}
    first = review.decide_all(log.limit(0), items.where("finding_id = 'a'"), "approved", "y").collect()
    assert [(r["seq"], r["finding_id"]) for r in first] == [(0, "a")] and review.decide_all(log, items.limit(0), "approved", "y").count() == 2
    with pytest.raises(ValueError):
        review.decide_all(log, items, "perhaps", "y")


def test_footprint_status(spark):
    rows = [(1, "a", "cotton", 100.0, None, 0.0, 0.0, "ok"), (2, "b", "cotton", 100.0, "grouped_median", 50.0, 150.0, "ok"), (3, "c", None, 10.0, None, None, None, "ok"), (4, "d", "cotton", None, None, None, None, "ok"), (5, "e", "wool", 9.0, None, None, None, "flagged")]
    found = footprint.components(spark.createDataFrame(rows, "id long, record_id string, material_normalized string, weight_g double, tier string, fill_low double, fill_high double, quality_status string"))
    assert {r["id"]: (r["status"], r["weight_source"]) for r in found.collect()} == {1: ("costed", "observed"), 2: ("costed", "filled"), 3: ("unmapped", "observed"), 4: ("no_weight", "missing"), 5: ("flagged", "observed")}
    two = found.where("id = 2").first()
    assert two["estimated_kgco2e"] == pytest.approx(0.34151) and two["low"] == pytest.approx(0.170755) and two["high"] == pytest.approx(0.512265)


def test_accuracy(spark):
    filled = spark.createDataFrame([(1, "grouped_median", 11.0), (2, "reference_constant", 5.0), (3, None, 7.0)], "id long, tier string, weight_g double")
    truth = spark.createDataFrame([(1, 10.0), (2, 0.0), (3, 9.0)], "id long, true_weight double")
    got = {r["tier"]: (r["n"], r["mae"], r["mape"]) for r in fill.accuracy(filled, truth).collect()}
    assert got == {"grouped_median": (1, 1.0, 0.1), "reference_constant": (1, 5.0, 0.0), "overall": (2, 3.0, 0.1)}


def test_missing_columns(spark):
    with pytest.raises(materialize.SourceSchemaError):
        materialize.materialize(spark.createDataFrame([("1",)], "source_row_id string"))
