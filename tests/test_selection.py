"""Exact medians by range counts against sorting."""

import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import anomalies, selection
from weftline.staging import staged


def grouped():
    rng = np.random.default_rng(3)
    values = {
        "odd": rng.normal(size=801).tolist(), "even": rng.normal(size=800).tolist(), "one": [4.5], "two": [1.0, 2.0], "alike": [7.0] * 9, "middles apart": [1.0] * 5 + [9.0] * 5,
        "wide": [10.0**k for k in range(-300, 300, 7)], "close": [1 + k * 2**-52 for k in range(3000)], "signs": [-5.0, 3.0, -1e308, 1e308, 0.0, -0.5], "infinite": [1.0, float("inf"), 2.0, float("-inf"), 3.0],
        "hot": rng.integers(0, 5, 4000).astype(float).tolist(),
    }
    return values


def test_groups(spark):
    values = grouped()
    rows = staged(spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k string, v double"), "values")
    got = {r["k"]: (r["n"], r["median"]) for r in selection.medians(rows, ["k"], "v").collect()}
    assert got == {k: (len(v), statistics.median_low(v) * 0.5 + statistics.median_high(v) * 0.5 if statistics.median_low(v) != statistics.median_high(v) else statistics.median_low(v)) for k, v in values.items()}
    spread = {r["k"]: r["mad"] for r in selection.spread(rows, ["k"], "v").collect()}
    for k in set(values) - {"infinite"}:
        assert spread[k] == pytest.approx(statistics.median(abs(x - got[k][1]) for x in values[k]), rel=1e-12)


def test_weights(spark):
    rng = np.random.default_rng(4)
    rows = [(f"g{g}", float(x), int(rng.integers(1, 9))) for g in range(5) for x in rng.choice(1000, 60, False)]
    got = {r["k"]: (r["n"], r["median"]) for r in selection.medians(staged(spark.createDataFrame(rows, "k string, v double, c int"), "values"), ["k"], "v", F.col("c")).collect()}
    for g in {k for k, *_ in rows}:
        whole = [v for k, v, c in rows if k == g for _ in range(c)]
        assert got[g] == (len(whole), statistics.median(whole))


def test_a_million_distinct_values(spark):
    rows = staged(spark.range(1_000_001).select(F.lit("price").alias("k"), F.exp(F.col("id") / 50000).alias("v")), "values")
    found = selection.spread(rows, ["k"], "v").first()
    v = rows.toPandas()["v"].to_numpy()
    assert found["n"] == 1_000_001 and found["median"] == np.median(v) and found["mad"] == np.median(np.abs(v - np.median(v)))


def test_no_rows(spark):
    assert selection.spread(spark.createDataFrame([], "k string, v double"), ["k"], "v").count() == 0


def test_outliers_of_hand_made_rows(spark):
    """Cutoff 3.5 on 0.6745 * |ln x - median| / mad; fewer than 3 values, or none apart, give none."""
    rows = [(i, f"r{i}", w, p) for i, (w, p) in enumerate([(10.0, 2.0), (11.0, 2.0), (9.0, 2.0), (10.5, 2.0), (9.5, 900.0), (100000.0, None), (0.0, -1.0), (None, float("nan"))])]
    df = spark.createDataFrame(rows, "id long, record_id string, component_weight_g double, unit_price double")
    assert [(r["id"], r["name"], r["value"]) for r in anomalies.outliers(df, ["component_weight_g", "unit_price"]).collect()] == [(5, "component_weight_g", 100000.0)]
    found = anomalies.distribution(df).collect()
    assert [(r["stage"], r["finding_id"], r["message"], r["evidence_value"]) for r in found] == [(5, "r5:component_weight_g:distribution", "extreme component_weight_g 100000", "100000")]
    assert anomalies.outliers(df.limit(2), ["component_weight_g"]).count() == 0


def test_plans_hold_no_percentile(spark, small):
    from weftline.plans import registry

    for name in ("outliers_price", "fill_group_stats"):
        plan = registry.QUERIES[name](spark, small)._jdf.queryExecution().toString()
        assert "percentile" not in plan
