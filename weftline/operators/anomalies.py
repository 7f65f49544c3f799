"""The anomaly net: findings over normalized rows before any weight is filled."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import reference as R
from ..functions.parsing import number_text, positive
from ..staging import counted, staged
from . import emission, selection
from .numbering import numbered

FINDING = ["id", "stage", "finding_id", "record_id", "column", "category", "severity", "message", "proposed_value", "evidence_key", "evidence_value"]


def finding(column: str | None, category: str, severity: str, message: Column, proposed: Column | None = None, evidence: tuple[str, Column] | None = None) -> dict[str, Column]:
    """A finding's fields by name; ``evidence`` is one named value."""
    key, value = evidence or ("", F.lit(None).cast("string"))
    return {
        "finding_id": F.concat_ws(":", "record_id", F.lit(column or "-"), F.lit(category)), "record_id": F.col("record_id"), "column": F.lit(column).cast("string"),
        "category": F.lit(category), "severity": F.lit(severity), "message": message,
        "proposed_value": proposed if proposed is not None else F.lit(None).cast("string"),
        "evidence_key": F.lit(key or None).cast("string"), "evidence_value": value.cast("string"),
    }


def emitted(rows: DataFrame, checks: list[tuple[int, Column, dict[str, Column]]]) -> DataFrame:
    """Rows x checks that hold, one pass: (stage, condition, finding)."""
    return emission.emitted(rows, [(cond, {"id": F.col("id"), "stage": F.lit(stage), **f}) for stage, cond, f in checks], FINDING)


def row_checks() -> list[tuple[int, Column, dict[str, Column]]]:
    worth = F.coalesce(positive(F.col("quantity")), F.lit(False)) | F.coalesce(positive(F.col("unit_price")), F.lit(False))
    total = F.col("composition_total")
    return [
        (0, F.col("material_proposal").isNotNull(), finding("material_normalized", "mapping", "medium", F.concat(F.lit("unrecognized material "), F.col("material_raw")), F.col("material_proposal"), ("raw_value", F.col("material_raw")))),
        (1, (F.trim("raw_order_date") != "") & F.col("order_date").isNull(), finding("order_date", "validity", "medium", F.concat(F.lit("unparseable date "), F.col("raw_order_date")))),
        (1, F.col("quantity") < 0, finding("quantity", "validity", "high", F.concat(F.lit("negative quantity "), F.col("quantity").cast("string")))),
        (2, F.col("factory_country_iso").isNull(), finding("factory_country_iso", "completeness", "low", F.lit("unresolved country"))),
        (4, (F.col("component_weight_g") == 0) & worth, finding("component_weight_g", "cross_field", "high", F.lit("zero weight on a line with positive value"))),
        (4, F.abs(total - 1) > R.COMPOSITION_TOLERANCE, finding("composition", "cross_field", "medium", F.concat(F.lit("composition sums to "), F.round(total * 100).cast("int").cast("string"), F.lit("%, not 100%")))),
    ]


#: The stage at which a category's checks of single rows stand.
CHECKED = {"mapping": 0, "validity": 1, "completeness": 2, "cross_field": 4}
BUSINESS_KEY = ["style_id", "sku", "component"]
#: Cells that findings of all categories read, beside the proposal.
READ = ["id", "record_id", *BUSINESS_KEY, "material_raw", "material_normalized", "raw_order_date", "order_date", "quantity", "unit_price", "factory_country_iso", "component_weight_g", "composition_total"]


def occurrences(rows: DataFrame, *more: str) -> DataFrame:
    """id, business key and further columns with ``nth``, the running number of a row within its key by id; a hot key's rows are counted in many tasks.

    ``rows`` is read more than once. Rows whose key is met once need no ordering: see ``repeated``.
    """
    alone, several = repeated(rows.select("id", *BUSINESS_KEY, *more))
    return alone.withColumn("nth", F.lit(1).cast("bigint")).unionByName(numbered(several, BUSINESS_KEY, ["id"], "nth"))


def firsts(rows: DataFrame, *more: str) -> DataFrame:
    """Business key, id and further columns of each key's first row by id, as ``occurrences`` numbers them 1. One pass and one shuffle; a task sends a row a key."""
    first = F.min_by(F.struct("id", *more), "id")
    return rows.groupBy(*BUSINESS_KEY).agg(first.alias("_first")).select(*BUSINESS_KEY, "_first.*")


def repeated(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose business key is theirs alone, and (staged) the others.

    Keys are told apart by a hash, counted before the shuffle. Rows of different keys with one hash count as repeated, which costs
    time only: they are numbered by their keys.
    """
    dealt = rows.withColumn("_hash", F.xxhash64(*BUSINESS_KEY))
    shared = staged(dealt.groupBy("_hash").agg(F.count("*").alias("_n")).where("_n > 1").select("_hash"), "shared-keys")
    side = counted(shared)
    several = dealt.join(side, "_hash", "left_semi").drop("_hash")
    return dealt.join(side, "_hash", "left_anti").drop("_hash"), staged(several, "repeated-keys")


def duplicates(rows: DataFrame) -> DataFrame:
    """Second and later rows of a (style, sku, component) key, in row order."""
    later = numbered(repeated(rows.select("id", *BUSINESS_KEY, "record_id"))[1], BUSINESS_KEY, ["id"], "nth").where("nth > 1")
    key = F.concat(F.lit("duplicate (style, sku, component) "), F.concat_ws(", ", *BUSINESS_KEY))
    return emitted(later, [(3, F.lit(True), finding(None, "duplicate_key", "medium", key))])


def logarithms(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Staged: column name, ln of every positive value, and how often it occurs."""
    return staged(positives(rows, columns, []).groupBy("name", F.ln("value").alias("ln")).agg(F.count("*").alias("times")), "logarithms")


def positives(rows: DataFrame, columns: list[str], kept: list[str]) -> DataFrame:
    """``kept``, name and value of positive cells."""
    rules = [(positive(F.col(c)), {**{k: F.col(k) for k in kept}, "name": F.lit(c), "value": F.col(c).cast("double")}) for c in columns]
    return emission.emitted(rows, rules, [*kept, "name", "value"])


def outlier_bounds(rows: DataFrame, columns: list[str]) -> DataFrame:
    """name, median and MAD of ln for each column that has 3 positive values or more, not all of them alike."""
    return selection.spread(logarithms(rows, columns), ["name"], "ln", F.col("times")).where("n >= 3 and mad > 0").select("name", "median", "mad")


def outliers(rows: DataFrame, columns: list[str]) -> DataFrame:
    """id, record_id, name, value and z of cells whose modified z-score of ln lies above the cutoff. There is one row of bounds a column."""
    bounds = F.broadcast(outlier_bounds(rows, columns))
    cells = positives(rows, columns, ["id", "record_id"])
    z = 0.6745 * F.abs(F.ln("value") - F.col("median")) / F.col("mad")
    return cells.join(bounds, "name").where(z > R.OUTLIER).select("id", "record_id", "name", "value", z.alias("z"))


def distribution(rows: DataFrame) -> DataFrame:
    value = number_text(F.col("value"))
    checks = [(stage, F.col("name") == column, finding(column, "distribution", "medium", F.concat(F.lit(f"extreme {column} "), value), None, ("value", value))) for stage, column in ((5, "component_weight_g"), (6, "unit_price"))]
    return emitted(outliers(rows, ["component_weight_g", "unit_price"]), checks)


#: Categories whose findings come from more than the row itself. They run jobs of their own, which a reader of other categories doesn't need.
OVER_ROWS = {"duplicate_key": duplicates, "distribution": distribution}
CATEGORIES = ("mapping", "validity", "completeness", "cross_field", *OVER_ROWS)


def detect(rows: DataFrame, categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """All findings of normalized (and reviewed) rows, or those of some categories."""
    checks = [c for c in row_checks() if c[0] in {CHECKED[k] for k in categories if k in CHECKED}]
    parts = [emitted(rows, checks)] if checks else []
    return reduce(DataFrame.unionByName, parts + [OVER_ROWS[k](rows) for k in OVER_ROWS if k in categories])
