"""Component footprints: weight x factor with status, uncertainty, roll-ups and factor revisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import reference as R
from .anomalies import emitted, finding


def components(filled: DataFrame, version: str = "v1") -> DataFrame:
    """One row per line. Columns added: factor, estimated_kgco2e, low, high, weight_source, mapping_confidence, status.

    Everything is carried on the row; nothing joins back by record_id, which may repeat.
    """
    factors = R.factor_frame(filled.sparkSession, version).withColumnRenamed("material", "material_normalized")
    rows = filled.join(F.broadcast(factors), "material_normalized", "left")
    kilos = lambda c: F.col(c) / 1000 * F.col("factor")
    has_weight, has_factor, is_filled = F.col("weight_g").isNotNull(), F.col("factor").isNotNull(), F.col("tier").isNotNull()
    costed = has_weight & has_factor
    status = F.when(~has_weight, "no_weight").when(~has_factor, "unmapped").when(F.col("quality_status") == "flagged", "flagged").otherwise("costed")
    return rows.withColumns({
        "factor": F.when(has_weight, F.col("factor")),
        "estimated_kgco2e": F.when(costed, kilos("weight_g")),
        "low": F.when(costed & is_filled, kilos("fill_low")),
        "high": F.when(costed & is_filled, kilos("fill_high")),
        # A row without a factor says "observed" for any weight it has, filled or not.
        "weight_source": F.when(~has_weight, "missing").when(costed & is_filled, "filled").otherwise("observed"),
        "mapping_confidence": F.when(costed, 1.0).otherwise(0.0),
        "factor_version": F.lit(version),
        "status": status,
    })


def unmapped_findings(found: DataFrame) -> DataFrame:
    message = F.concat(F.lit("material "), F.coalesce("material_normalized", F.lit("(none)")), F.lit(" has no emission factor"))
    return emitted(found, [(8, F.col("status") == "unmapped", finding("estimated_kgco2e", "mapping", "medium", message, None, ("material_raw", F.col("material_raw"))))])


def totals() -> list[Column]:
    est, own = F.col("estimated_kgco2e"), F.coalesce(F.sum("estimated_kgco2e"), F.lit(0.0))
    observed = F.coalesce(F.sum(F.when(F.col("weight_source") == "observed", est)), F.lit(0.0))
    return [
        own.alias("total_kgco2e"),
        F.coalesce(F.sum(F.coalesce("low", est)), F.lit(0.0)).alias("low_kgco2e"),
        F.coalesce(F.sum(F.coalesce("high", est)), F.lit(0.0)).alias("high_kgco2e"),
        F.when(own == 0, 0.0).otherwise(observed / own).alias("observed_share"),
        F.when(own == 0, 0.0).otherwise(1 - observed / own).alias("filled_share"),
    ]


def summary(found: DataFrame) -> DataFrame:
    """One row: totals over costed lines and the number of lines per status."""
    costed = found.withColumns({c: F.when(F.col("status") == "costed", F.col(c)) for c in ("estimated_kgco2e", "low", "high")})
    counts = [F.count_if(F.col("status") == s).alias(f"{s}_n") for s in ("costed", "flagged", "unmapped", "no_weight")]
    return costed.agg(*totals(), *counts)


def breakdown(found: DataFrame, key: Column) -> DataFrame:
    """Costed lines by key, largest total first."""
    out = found.where("status = 'costed'").groupBy(key.alias("key")).agg(*totals(), F.count("*").alias("n"))
    return out.orderBy(F.desc("total_kgco2e"), "key")


def by_material(found: DataFrame) -> DataFrame:
    return breakdown(found, F.coalesce("material_normalized", F.lit("unmapped")))


def by_category(found: DataFrame) -> DataFrame:
    return breakdown(found, F.col("category"))


def by_product(found: DataFrame) -> DataFrame:
    return breakdown(found, F.col("style_id"))


def by_country(found: DataFrame) -> DataFrame:
    return breakdown(found, F.coalesce("factory_country_iso", F.lit("unknown")))


def factor_diff(filled: DataFrame, version_from: str = "v1", version_to: str = "v2") -> DataFrame:
    """Materials in use whose factor changed: both factors, both totals and the change, largest first. One pass over the lines."""
    spark = filled.sparkSession
    mass = components(filled, version_from).where("status = 'costed'").groupBy(F.col("material_normalized").alias("material")).agg(F.sum("estimated_kgco2e").alias("total_from"))
    old, new = (R.factor_frame(spark, v).withColumnRenamed("factor", n) for v, n in ((version_from, "factor_from"), (version_to, "factor_to")))
    after = components(filled, version_to).where("status = 'costed'").groupBy(F.col("material_normalized").alias("material")).agg(F.sum("estimated_kgco2e").alias("total_to"))
    both = mass.join(after, "material", "full").join(F.broadcast(old), "material").join(F.broadcast(new), "material").where("factor_from <> factor_to")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = both.select("material", "factor_from", "factor_to", zero("total_from").alias("total_from"), zero("total_to").alias("total_to"), (zero("total_to") - zero("total_from")).alias("delta_kgco2e"))
    return out.orderBy(F.desc(F.abs("delta_kgco2e")), "material")
