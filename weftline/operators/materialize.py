"""Raw rows to canonical records: header mapping, required columns, ids, and normalization of every cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parsing as P
from ..functions import reference as R
from ..functions.similarity import matched_spellings
from ..staging import counted, staged

RAW = [name for name, _ in R.SOURCE_SCHEMA]
CANONICAL = [
    "record_id", "source_row_id", "style_id", "category", "sku", "component", "material_raw", "material_normalized", "composition",
    "component_weight_g", "supplier_raw", "supplier_normalized", "factory_country_iso", "order_date", "quantity", "unit_price", "quality_status",
]
RULESET = "v1"


class SourceSchemaError(ValueError):
    """The source lacks a column the contract needs, or a row id is not an integer."""


def apply_mapping(rows: DataFrame, mapping: dict[str, str] | None) -> DataFrame:
    """Confirmed header renames; of two headers with one target the later wins."""
    for source, target in (mapping or {}).items():
        if source in rows.columns and source != target:
            rows = (rows.drop(target) if target in rows.columns else rows).withColumnRenamed(source, target)
    return rows


def materialize(rows: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Raw text columns plus id, record_id and category. Missing cells are blank, never null.

    A row id that is no integer fails the job when it runs (``raise_error``), as no result may hold such a row.
    """
    rows = apply_mapping(rows, mapping)
    missing = [c for c in RAW if c not in rows.columns]
    if missing:
        raise SourceSchemaError(f"missing columns: {', '.join(missing)}")
    text = rows.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in RAW})
    row_id = P.to_int(F.col("source_row_id"))
    checked = F.coalesce(row_id, F.raise_error(F.concat(F.lit("source_row_id is not an integer: "), F.col("source_row_id"))).cast("bigint"))
    out = text.withColumn("id", checked)
    return out.withColumns({"record_id": P.record_id(F.col("id")), "category": P.category(F.col("style_id"))})


def literal_map(rows: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(v) for pair in sorted(rows.items()) for v in pair])


def country_iso(raw: Column) -> Column:
    return F.try_element_at(literal_map({n.lower(): iso for n, iso in R.COUNTRIES}), F.lower(F.trim(raw)))


def exact_material(raw: Column) -> Column:
    names = {s: n for n, _, synonyms in R.MATERIALS for s in synonyms} | {n: n for n, _, _ in R.MATERIALS}
    return F.try_element_at(literal_map(names), F.lower(F.trim(raw)))


def cells(rows: DataFrame) -> DataFrame:
    """Canonical columns beside the raw ones (as ``raw_*`` where the names meet); every expression is row-local. Cells whose raw column isn't there are left out."""
    renamed = rows.withColumnsRenamed({"material": "material_raw", "supplier": "supplier_raw", "net_weight": "raw_net_weight", "country": "raw_country", "composition": "raw_composition", "order_date": "raw_order_date", "quantity": "raw_quantity", "unit_price": "raw_unit_price"})
    out = renamed.withColumn("composition_parts", P.parse_composition(F.col("raw_composition"))) if "raw_composition" in renamed.columns else renamed
    made = [
        ("quantity", "raw_quantity", P.to_int),
        ("unit_price", "raw_unit_price", P.to_float),
        ("component_weight_g", "raw_net_weight", P.parse_weight),
        ("composition", "composition_parts", P.format_composition),
        ("composition_total", "composition_parts", P.composition_total),
        ("order_date", "raw_order_date", P.parse_date),
        ("factory_country_iso", "raw_country", country_iso),
        ("material_normalized", "material_raw", exact_material),
    ]
    return out.withColumns({name: parse(F.col(raw)) for name, raw, parse in made if raw in out.columns} | {"quality_status": F.lit("ok")})


def similar(out: DataFrame) -> DataFrame:
    """Adds the supplier match and the material proposal with their ratios, looked up once per distinct spelling.

    The rows are staged, as spellings are gathered from them before they are joined: they are worked out once, and readers of the result
    find their cells parsed. Beside few spellings the join runs with each reader, else the result is staged too.
    """
    out = staged(out.drop("composition_parts"), "cells")
    suppliers = matched_spellings(out, "supplier_raw", R.SUPPLIERS, R.SUPPLIER_CUTOFF, "supplier_normalized")
    materials = matched_spellings(out.where("material_normalized is null"), "material_raw", [n for n, _, _ in R.MATERIALS], R.MATERIAL_CUTOFF, "material_proposal")
    found = [staged(f, "spellings") for f in (suppliers, materials)]
    sides = [counted(f) for f in found]
    rows = out.join(sides[0], "supplier_raw", "left").join(sides[1], "material_raw", "left")
    return rows if all(side is not f for side, f in zip(sides, found, strict=True)) else staged(rows, "normalized")


def proposed(out: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of cells with the material proposal of ``similar``, for readers that need no supplier: no more is staged or looked up."""
    return with_proposals(staged(out.select(*columns), "cells"))


def with_proposals(out: DataFrame) -> DataFrame:
    """Cells with the material proposal of ``similar``. They are read more than once: a staged frame, or one that is cheap to make from it."""
    return met(out, "material_raw", matched_spellings(out.where("material_normalized is null"), "material_raw", [n for n, _, _ in R.MATERIALS], R.MATERIAL_CUTOFF, "material_proposal"))


def with_suppliers(out: DataFrame) -> DataFrame:
    """Cells with the supplier match of ``similar``; they are read more than once, as above."""
    return met(out, "supplier_raw", matched_spellings(out, "supplier_raw", R.SUPPLIERS, R.SUPPLIER_CUTOFF, "supplier_normalized"))


def met(out: DataFrame, column: str, spellings: DataFrame) -> DataFrame:
    """Rows beside their spelling's match. Beside few spellings the join runs with each reader, else the result is staged."""
    found = staged(spellings, "spellings")
    side = counted(found)
    rows = out.join(side, column, "left")
    return rows if side is not found else staged(rows, "normalized")


def normalize(rows: DataFrame) -> DataFrame:
    """All of the canonical contract but the filled weight."""
    return similar(cells(rows))


def canonical(records: DataFrame) -> DataFrame:
    return records.select(*CANONICAL)
