"""Reference tables of the engine, as small frames, and their content digests.

All tables here have a fixed, small number of rows, so joins may broadcast them.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

# Reference data that results depend on.
COUNTRIES = [("China", "CN"), ("India", "IN"), ("Portugal", "PT"), ("Sweden", "SE"), ("Vietnam", "VN")]
SUPPLIERS = ["Acme Textiles", "Bharat Mills", "Golden Thread", "Nordic Weave", "Oceanic Fabrics"]
#: canonical name, composition code, synonyms
MATERIALS = [
    ("cotton", "CO", []), ("organic cotton", None, []), ("polyester", "PL", []), ("nylon", None, ["polyamide"]), ("viscose", None, []),
    ("elastane", None, []), ("wool", None, []), ("acrylic", None, []), ("brass", None, []), ("metal", None, []),
]
#: component, reference weight, band low, band high; grams
WEIGHTS = [
    ("brand label", 2, 1, 6), ("button", 5, 2, 15), ("care label", 1, 1, 3), ("drawcord", 6, 3, 18), ("hood lining", 90, 40, 150),
    ("hook and eye", 2, 1, 6), ("lining", 80, 30, 240), ("metal eyelet", 2, 1, 6), ("pocket lining", 44, 17, 130), ("rib collar", 12, 5, 36),
    ("rib cuffs", 37, 15, 110), ("sequin panel", 33, 11, 100), ("shell fabric", 300, 90, 900), ("side tape", 4, 2, 12), ("size label", 1, 1, 3),
    ("thread", 3, 1, 9), ("waistband", 49, 19, 150), ("webbing strap", 33, 8, 110), ("zipper", 16, 7, 48),
]
#: material, kgCO2e per kg; by table version
FACTORS = {
    "v1": [("cotton", 3.4151), ("organic cotton", 0.9991), ("polyester", 4.8288), ("nylon", 12.3703), ("viscose", 4.9672), ("elastane", 7.915), ("wool", 28.9041), ("acrylic", 11.0771), ("brass", 4.2), ("metal", 3.5)],
    "v2": [("cotton", 3.4151), ("organic cotton", 0.9991), ("polyester", 5.3), ("nylon", 12.3703), ("viscose", 4.9672), ("elastane", 7.915), ("wool", 28.9041), ("acrylic", 11.0771), ("brass", 4.2), ("metal", 3.5)],
}
#: Material codes of compact compositions.
CODES = {code: name for name, code, _ in MATERIALS if code}
#: Headers that stand for a column of the expected schema.
HEADER_ALIASES = {"vendor": "supplier"}
#: The expected source columns, in order, with their coarse types.
SOURCE_SCHEMA = [
    ("source_row_id", "integer"), ("style_id", "string"), ("sku", "string"), ("component", "string"), ("material", "string"), ("composition", "string"),
    ("net_weight", "string"), ("supplier", "string"), ("country", "string"), ("order_date", "string"), ("quantity", "integer"), ("unit_price", "float"),
]
SUPPORT, DISPERSION, OUTLIER, COMPOSITION_TOLERANCE = 5, 0.30, 3.5, 0.001
SUPPLIER_CUTOFF, MATERIAL_CUTOFF, HEADER_CUTOFF = 0.75, 0.85, 0.80
FACTOR_SOURCE = {"brass": "base-empreinte-2024", "metal": "base-empreinte-2024"}
FACTOR_SOURCE_DEFAULT = "ecoinvent-3.9.1"


def weight_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, float(r), float(lo), float(hi)) for c, r, lo, hi in WEIGHTS], "component string, ref_g double, band_low double, band_high double")


def factor_frame(spark: SparkSession, version: str = "v1") -> DataFrame:
    if version not in FACTORS:
        raise ValueError(f"no factor table {version!r}")
    return spark.createDataFrame(FACTORS[version], "material string, factor double")


def digest(tables: dict[str, str]) -> str:
    """16 hex digits over the named contents, independent of their order."""
    found = hashlib.sha256()
    for name, content in sorted(tables.items()):
        found.update(name.encode() + b"\0" + content.encode() + b"\0")
    return found.hexdigest()[:16]


def factor_digest(version: str) -> str:
    return digest({f"factors_{version}": repr(FACTORS[version])})


def reference_digest() -> str:
    return digest({"countries": repr(COUNTRIES), "suppliers": repr(SUPPLIERS), "materials": repr(MATERIALS), "weights": repr(WEIGHTS)})
