"""Column profiles, coarse types, schema drift and rename proposals."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parsing as P
from ..functions import reference as R
from ..staging import counted, staged

SAMPLES = 5
CLASSES = 64


def profile(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per column: pos, name, dtype, null_rate, cardinality, the 5 smallest distinct samples."""
    columns = columns or rows.columns
    names = F.array(*[F.lit(c) for c in columns])
    cells = rows.select(F.posexplode(F.array(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns])).alias("pos", "value"))
    return profiles(cells, []).select("pos", F.get(names, F.col("pos")).alias("name"), "dtype", "null_rate", "cardinality", "samples")


def profiles(cells: DataFrame, keys: list[str]) -> DataFrame:
    """The same for cells (keys, pos, value) of any number of tables, one for each of ``keys`` (a file, say), by column number. One scan of them.

    Cells are counted per distinct value, which is staged; all else works on distinct values. The smallest are
    found without ranking: a column's values fall into ``CLASSES`` by hash, and the fifth of the classes' least values bounds the fifth
    smallest value, so the few values up to it are all that is collected.
    """
    by = [*keys, "pos"]
    counts = staged(cells.groupBy(*by, "value").agg(F.count("*").alias("n")), "cell-counts")
    x, blank = F.col("value"), F.trim("value") == ""
    flags = {"integer": P.to_int(x).isNotNull(), "float": P.to_float(x).isNotNull(), "date": P.parse_date(x).isNotNull()}
    fits = [F.bool_and(F.when(~blank, ok)).alias(name) for name, ok in flags.items()]
    sums = [F.sum("n").alias("total"), F.sum(F.when(blank, F.col("n")).otherwise(0)).alias("blanks"), F.sum(F.when(blank, 0).otherwise(1)).alias("cardinality")]
    base = counts.groupBy(*by).agg(*sums, *fits)
    least = counts.where(~blank).groupBy(*by, F.pmod(F.xxhash64("value"), F.lit(CLASSES)).alias("class")).agg(F.min("value").alias("least"))
    bound = least.groupBy(*by).agg(F.get(F.array_sort(F.collect_list("least")), F.lit(SAMPLES - 1)).alias("bound"))
    base = staged(base.join(bound, by, "left"), "column-facts")
    few = counts.where(~blank).join(counted(base.select(*by, "bound")), by).where(F.col("bound").isNull() | (x <= F.col("bound")))
    firsts = few.groupBy(*by).agg(F.slice(F.array_sort(F.collect_list("value")), 1, SAMPLES).alias("samples"))
    dtype = F.when(F.col("cardinality") == 0, "empty").when(F.col("integer"), "integer").when(F.col("float"), "float").when(F.col("date"), "date").otherwise("string")
    none = F.array().cast("array<string>")
    return base.join(firsts, by, "left").select(*by, dtype.alias("dtype"), F.round(F.col("blanks") / F.col("total"), 6).alias("null_rate"), "cardinality", F.coalesce("samples", none).alias("samples"))


def expected_schema(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(R.SOURCE_SCHEMA)], "pos int, name string, dtype string")


def schema_diff(observed: DataFrame, baseline: DataFrame) -> DataFrame:
    """name, change (added, removed, type_changed), types; by name, order ignored. A column without values never changes type."""
    o, b = observed.select("name", F.col("dtype").alias("observed")), baseline.select("name", F.col("dtype").alias("expected"))
    change = F.when(F.col("expected").isNull(), "added").when(F.col("observed").isNull(), "removed").when((F.col("observed") != F.col("expected")) & (F.col("observed") != "empty"), "type_changed")
    return o.join(b, "name", "full").select("name", change.alias("change"), "expected", "observed").where("change is not null")


def gate(diff: DataFrame) -> DataFrame:
    """One row: number of changes and the verdict."""
    return diff.agg(F.count("*").alias("changes"), F.when(F.count("*") > 0, "review_required").otherwise("accepted").alias("status"))


def propose_mapping(added: list[str], removed: list[str]) -> tuple[dict[str, str], list[str], list[str]]:
    """Renames of added headers (tens at most): a known alias first, else the most similar free header; then what is left of both."""
    free, renames, rest = list(removed), {}, []
    for name in added:
        scored = [(difflib.SequenceMatcher(None, name, other).ratio(), -i, other) for i, other in enumerate(free)]
        scored = [s for s in scored if s[0] >= R.HEADER_CUTOFF]
        alias = R.HEADER_ALIASES.get(name)
        target = alias if alias in free else (max(scored)[2] if scored else None)
        if target is None:
            rest.append(name)
        else:
            renames[name] = target
            free.remove(target)
    return renames, rest, free


def proposals(diff: DataFrame) -> DataFrame:
    """source, target: the renames proposed for a schema's changes (tens of columns, one row of two lists), worked out by a task."""
    names = lambda kind: F.array_sort(F.collect_list(F.when(F.col("change") == kind, F.col("name")))).alias(kind)
    lists = diff.agg(names("added"), names("removed"))

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for added, removed in zip(batch.column("added").to_pylist(), batch.column("removed").to_pylist(), strict=True):
                renames = propose_mapping(added, removed)[0]
                yield pa.record_batch([pa.array(list(renames), pa.string()), pa.array(list(renames.values()), pa.string())], ["source", "target"])

    return lists.mapInArrow(propose, "source string, target string")
