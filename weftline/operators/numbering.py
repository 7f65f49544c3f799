"""Running numbers per key where a key may hold a large part of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import staged


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """``rows``, staged, with their number (from 1) within their keys by ``order``; nulls are keys like others, and come first in order.

    ``rows`` is read twice, once for the ranges: a staged frame, or one that is cheap to make from it.

    Rows are dealt into slices by ranges of keys and order, so a hot key's rows lie in many slices. Ranks are counted within each
    slice, and a slice begins in the middle of one key at most: the rows of that key in earlier slices are what its ranks are behind. A row per
    slice is all that meets in one task.
    """
    held = staged(rows.repartitionByRange(*keys, *order).withColumn("_slice", F.spark_partition_id()), "slices")
    key = F.struct(*keys)
    borders = held.groupBy("_slice").agg(F.min(key).alias("first_key"), F.max(key).alias("last_key"))
    counts = held.join(F.broadcast(borders.select("_slice", "last_key")), "_slice").where(key.eqNullSafe(F.col("last_key"))).groupBy("_slice").agg(F.count("*").alias("n"))
    in_order = Window.orderBy("_slice")
    ends = borders.join(counts, "_slice").withColumn("goes_on", F.coalesce(F.lag("last_key").over(in_order).eqNullSafe(F.col("first_key")) & (F.lag("_slice").over(in_order).isNotNull()), F.lit(False)))
    # Rows that the last key has up to a slice's end: over its run of slices, which begins where the key before was another one.
    whole = F.col("goes_on") & F.col("first_key").eqNullSafe(F.col("last_key"))
    ends = ends.withColumn("run", F.sum(F.when(whole, 0).otherwise(1)).over(in_order))
    ends = ends.withColumn("so_far", F.sum("n").over(Window.partitionBy("run").orderBy("_slice")))
    offsets = ends.withColumn("behind", F.lag("so_far").over(in_order)).where("goes_on")
    offsets = staged(offsets.select(F.col("_slice").alias("_of"), *[F.col("first_key")[k].alias(f"_{i}") for i, k in enumerate(keys)], "behind"), "slice-offsets")
    rank = F.row_number().over(Window.partitionBy("_slice", *keys).orderBy(*order)).cast("bigint")
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(keys)], F.col("_slice") == F.col("_of"))
    return held.withColumn("_rank", rank).join(F.broadcast(offsets), same, "left").select(*rows.columns, (F.col("_rank") + F.coalesce("behind", F.lit(0))).alias(name))
