"""The fill ladder for missing weights: guarded group medians, then reference constants, else action required."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import reference as R
from ..functions.parsing import number_text, positive
from ..staging import counted, staged
from . import selection
from .anomalies import emitted, finding

LEVELS = [("material_component_category", ["fill_material", "component", "category"]), ("component_category", ["component", "category"]), ("category", ["category"])]


def fill_material() -> Column:
    return F.coalesce("material_normalized", F.lower("material_raw"))


def weight_counts(rows: DataFrame) -> DataFrame:
    """Staged: observed positive weights counted per group of every level, groups with all their keys only. ``key`` names level and group."""
    seen = rows.where(positive(F.col("component_weight_g"))).withColumn("fill_material", fill_material())
    finest = LEVELS[0][1]
    none = F.lit(None).cast("string")
    groups = [F.when(reduce(Column.__and__, [F.col(k).isNotNull() for k in keys]), F.struct(F.lit(i).alias("level"), *[(F.col(k) if k in keys else none).alias(k) for k in finest])) for i, (_, keys) in enumerate(LEVELS, 1)]
    counts = seen.groupBy(*finest, F.col("component_weight_g").alias("w")).agg(F.count("*").alias("c"))
    each = counts.select(F.explode(F.filter(F.array(*groups), lambda g: g.isNotNull())).alias("g"), "w", "c").select("g.*", "w", "c")
    each = each.groupBy("level", *finest, "w").agg(F.sum("c").alias("c"))
    return staged(each.withColumn("key", F.to_json(F.struct("level", *finest), {"ignoreNullFields": "false"})), "weight-counts")


def all_stats(rows: DataFrame) -> DataFrame:
    """Exact statistics of the three levels in one staged frame: level, fill_material, component, category, n, median, mad."""
    counts = weight_counts(rows)
    groups = counts.select("key", "level", *LEVELS[0][1]).distinct()
    stats = selection.spread(counts, ["key"], "w", F.col("c"))
    return staged(groups.join(stats, "key").select("level", *LEVELS[0][1], "n", "median", "mad"), "weight-stats")


def banded(rows: DataFrame) -> DataFrame:
    """Adds the component's reference weight and band."""
    return rows.join(F.broadcast(R.weight_frame(rows.sparkSession)), "component", "left")


def fill(rows: DataFrame) -> DataFrame:
    """Adds weight_filled, tier, fill_level, fill_n, fill_dispersion, low/high, band and quality_status; keeps the observed weight column."""
    return outcome(picked(rows))


def picked(rows: DataFrame) -> DataFrame:
    """Adds the band and ``pick``, the group whose median a missing weight takes.

    A median outside the component's band is passed over and coarser groups are still tried.
    """
    all_ = all_stats(rows)
    out = banded(rows.withColumn("fill_material", fill_material()))
    picks = []
    for i, (name, keys) in enumerate(LEVELS):
        stats = all_.where(F.col("level") == i + 1).select(*keys, F.struct(F.lit(name).alias("level"), F.col("n"), F.col("median"), F.col("mad")).alias(f"s{i}"))
        out = out.join(counted(stats), keys, "left")
        s = F.col(f"s{i}")
        inside = F.col("band_low").isNull() | s["median"].between(F.col("band_low"), F.col("band_high"))
        good = (s["n"] >= R.SUPPORT) & (s["median"] != 0) & (s["mad"] / s["median"] <= R.DISPERSION) & inside
        picks.append(F.when(good, s))
    return out.withColumn("pick", F.when(F.col("component_weight_g").isNull(), F.coalesce(*picks))).drop("s0", "s1", "s2")


def outcome(out: DataFrame) -> DataFrame:
    """What filling makes of rows with their band and ``pick``; every expression is row-local."""
    observed = F.col("component_weight_g").isNotNull()
    pick, constant = F.col("pick"), F.col("ref_g")
    by_median = pick.isNotNull()
    implausible = positive(F.col("component_weight_g")) & ~F.col("component_weight_g").between(F.col("band_low"), F.col("band_high"))
    return out.withColumns({
        "tier": F.when(observed, F.lit(None)).when(by_median, "grouped_median").when(constant.isNotNull(), "reference_constant"),
        "weight_g": F.coalesce("component_weight_g", pick["median"], F.when(~observed, constant)),
        "fill_low": F.when(observed, F.lit(None)).when(by_median, pick["median"] - pick["mad"]).otherwise(F.col("band_low")),
        "fill_high": F.when(observed, F.lit(None)).when(by_median, pick["median"] + pick["mad"]).otherwise(F.col("band_high")),
        "quality_status": F.when(~observed & ~by_median & constant.isNull(), "action_required").when(F.coalesce(implausible, F.lit(False)), "flagged").otherwise(F.col("quality_status")),
    })


def fill_findings(filled: DataFrame) -> DataFrame:
    value = number_text(F.col("component_weight_g"))
    band = F.concat(F.lit("observed weight "), value, F.lit(" outside band ["), number_text(F.col("band_low")), F.lit(", "), number_text(F.col("band_high")), F.lit("]"))
    return emitted(filled, [
        (7, F.col("quality_status") == "action_required", finding("component_weight_g", "completeness", "medium", F.lit("weight unresolved by the fill ladder, action required"))),
        (7, F.col("quality_status") == "flagged", finding("component_weight_g", "plausibility", "high", band, None, ("value", value))),
    ])


def accuracy(filled: DataFrame, truth: DataFrame) -> DataFrame:
    """tier, n, mae, mape against ``truth`` (id, true_weight); the row ``overall`` covers all tiers."""
    scored = filled.where("tier is not null").select("id", "tier", "weight_g").join(truth, "id")
    error = F.abs(F.col("weight_g") - F.col("true_weight"))
    share = F.when(F.col("true_weight") != 0, error / F.abs("true_weight"))
    out = scored.rollup("tier").agg(F.count("*").alias("n"), F.round(F.avg(error), 4).alias("mae"), F.round(F.coalesce(F.avg(share), F.lit(0.0)), 4).alias("mape"), F.grouping("tier").alias("g"))
    return out.select(F.when(F.col("g") == 1, "overall").otherwise(F.col("tier")).alias("tier"), "n", F.coalesce("mae", F.lit(0.0)).alias("mae"), "mape")
