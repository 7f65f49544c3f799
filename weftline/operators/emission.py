"""Rows of a second kind, made from rows where conditions hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def emitted(rows: DataFrame, rules: list[tuple[Column, dict[str, Column]]], names: list[str]) -> DataFrame:
    """Rows x rules that hold, in the order of rules: (condition, fields by name). One pass.

    Only the number of the rule is exploded; fields are picked by it afterwards, so those that nobody reads aren't worked out.
    """
    at = F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(i)) for i, (cond, _) in enumerate(rules)])
    hit = rows.withColumn("_rule", F.explode(at)).where("_rule is not null")

    def field(name: str) -> Column:
        out = F.when(F.col("_rule") == 0, rules[0][1][name])
        for i, (_, fields) in enumerate(rules[1:], 1):
            out = out.when(F.col("_rule") == i, fields[name])
        return out.alias(name)

    return hit.select(*[field(n) for n in names])
