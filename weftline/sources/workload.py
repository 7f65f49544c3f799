"""Bills of materials for the benchmark: a projection of the star schema to the 12 raw text columns.

Every messy form that the rules know is planted by the residue of the row id. The id is built from the
order key and the line's rank within its order, so numbering needs one shuffle by order, never a global sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.reference import WEIGHTS

COMPONENTS = {"plate": "shell fabric", "widget": "lining", "ring": "metal eyelet", "rod": "webbing strap", "gizmo": "zipper", "bolt": "button", "gear": "sequin panel", "anvil": "mystery trim"}
FIBRES = {"red": "cotton", "small": "Organic cottn", "hot": "polyester", "large": "polyamide", "old": "viscose", "blue": "Cotton ", "cold": "silk", "new": "wool"}
SPELLINGS = ["Acme Textiles", "Bharat Mills", "Golden Thread", "Nordic Weave", "Oceanic Fabrics", "Acme Textiles Ltd.", "ACME TEXTILES", "acme textiles ltd", "Golden Thread Co.", "Golden Thread Company", "Bharat Mills Pvt Ltd", "Oceanic Fabric", "OCEANIC FABRICS INC", "Nordic Weave AB", "Zeta Holdings"]
COUNTRY_NAMES = ["China", "India", "Portugal", "Sweden", "Vietnam"]
MULTIPLIERS = {"SMA": 1.20, "LAR": 1.10, "PRO": 0.90, "ECO": 0.85}
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
#: More than the most lines an order has.
STEP = 97
RAW = ["source_row_id", "style_id", "sku", "component", "material", "composition", "net_weight", "supplier", "country", "order_date", "quantity", "unit_price"]


def lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(v) for kv in table.items() for v in kv]), key)


def pick(values: list[str], at: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))


def bom_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw columns as text, plus ``id`` and ``true_weight`` (grams, long)."""
    read = lambda name: spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER))
    lines = read("lineitem").select("l_orderkey", *LINE_ORDER).withColumn("id", F.col("l_orderkey") * STEP + rank)
    part = read("part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand", "p_type", "p_size")
    supplier = read("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    rows = lines.join(part, "l_partkey").join(supplier, "l_suppkey")

    i, q = F.col("id"), F.col("l_quantity").cast("bigint")
    at = lambda n: i % n
    rows = rows.withColumns({
        "component": lookup(COMPONENTS, F.substring_index("p_name", " ", -1)),
        "material": lookup(FIBRES, F.substring_index("p_name", " ", 1)),
        "style_id": F.concat(F.upper(F.substring("p_type", 1, 3)), F.lit("-"), F.lpad(F.regexp_extract("p_brand", "([0-9]+)", 1), 2, "0")),
    })
    component, reference = F.col("component"), lookup({c: r for c, r, _, _ in WEIGHTS}, F.col("component"))
    weight = (
        F.when(component.isin("webbing strap", "mystery trim"), 8 + 2 * q)
        .when((component == "zipper") & (F.col("p_type") == "ECONOMY"), F.lit(200))
        .when(component == "sequin panel", F.lit(33))
        .otherwise(F.greatest(F.lit(1), F.floor(reference * (90 + F.col("p_size") % 21) / 100)))
        .cast("bigint")
    )
    grams = F.concat(F.col("true_weight").cast("string"), F.lit(" g"))
    kilos = F.concat(F.format_string("%d.%03d", F.floor(F.col("true_weight") / 1000), F.col("true_weight") % 1000), F.lit(" kg"))
    trim = F.col("component") == "mystery trim"
    net = (
        F.when(F.col("component") == "sequin panel", F.when(at(500) == 0, grams).otherwise(""))
        .when(at(20) < 7, "")
        .when(at(997) == 0, "0 g")
        .when((at(1499) == 0) & ~trim, "1000000000 g")
        .when((at(1499) == 1) & ~trim, "5000 g")
        .when(at(13) == 0, kilos)
        .otherwise(grams)
    )
    composition = (
        F.when(at(11) == 0, "70/30 CO/PL")
        .when(at(11) == 1, "80% cotton / 20% polyester")
        .when(at(11) == 2, "80% cotton / 30% polyester")
        .when(at(11) == 3, "mostly cotton")
        .when(at(11) == 4, "")
        .otherwise(F.concat(F.lit("100% "), F.col("material")))
    )
    date = (
        F.when(at(101) == 0, "2024-13-07")
        .when(at(101) == 1, "2024/02/31")
        .when(at(101) == 2, "")
        .when(at(101) == 3, F.date_format("l_shipdate", "yyyyMMdd"))
        .otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
    )
    price = F.floor(F.col("l_extendedprice") / F.col("l_quantity")).cast("bigint").cast("string")
    rows = rows.withColumn("true_weight", weight)
    return rows.select(
        "id", "true_weight", i.cast("string").alias("source_row_id"), "style_id",
        F.concat("style_id", F.lit("-"), F.col("l_orderkey").cast("string")).alias("sku"), "component", "material",
        composition.alias("composition"), net.alias("net_weight"), pick(SPELLINGS, F.col("l_suppkey") % 15).alias("supplier"),
        F.when(at(103) == 0, "Atlantis").when(at(103) == 1, "").otherwise(pick(COUNTRY_NAMES, F.col("s_nationkey") % 5)).alias("country"),
        date.alias("order_date"), F.when(at(211) == 0, "-5").when(at(211) == 1, "n/a").otherwise(q.cast("string")).alias("quantity"),
        F.when(at(1999) == 0, "99999999").when(at(211) == 2, "nan").otherwise(price).alias("unit_price"),
    )


def second_period(raw: DataFrame) -> DataFrame:
    """The later period of the same lines: quantities scaled by category, some cotton replaced."""
    prefix = F.substring("style_id", 1, 3)
    whole = F.col("quantity").rlike("^-?[0-9]+$")
    scaled = F.floor(F.col("quantity").try_cast("bigint") * F.coalesce(lookup(MULTIPLIERS, prefix), F.lit(1.0))).cast("bigint").cast("string")
    shifted = (F.col("component") == "shell fabric") & (prefix == "SMA") & (F.col("material") == "cotton")
    return raw.withColumns({"quantity": F.when(whole, scaled).otherwise(F.col("quantity")), "material": F.when(shifted, "organic cotton").otherwise(F.col("material"))})
