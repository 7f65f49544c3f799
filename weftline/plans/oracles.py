"""SQL that states the workload and every stage independently of the Spark code, for DuckDB."""

from __future__ import annotations

from ..sources import workload as W

# Fixed values, stated apart from the engine's, so that a wrong one there shows.
ISO_CODES = {"china": "CN", "india": "IN", "portugal": "PT", "sweden": "SE", "vietnam": "VN"}
MATERIAL_NAMES = ["cotton", "organic cotton", "polyester", "nylon", "viscose", "elastane", "wool", "acrylic", "brass", "metal"]
MATERIAL_CODES = {"CO": "cotton", "PL": "polyester"}
#: component, reference weight, band low, band high; grams
WEIGHTS = [
    ("brand label", 2.0, 1.0, 6.0), ("button", 5.0, 2.0, 15.0), ("care label", 1.0, 1.0, 3.0), ("drawcord", 6.0, 3.0, 18.0), ("hood lining", 90.0, 40.0, 150.0),
    ("hook and eye", 2.0, 1.0, 6.0), ("lining", 80.0, 30.0, 240.0), ("metal eyelet", 2.0, 1.0, 6.0), ("pocket lining", 44.0, 17.0, 130.0), ("rib collar", 12.0, 5.0, 36.0),
    ("rib cuffs", 37.0, 15.0, 110.0), ("sequin panel", 33.0, 11.0, 100.0), ("shell fabric", 300.0, 90.0, 900.0), ("side tape", 4.0, 2.0, 12.0), ("size label", 1.0, 1.0, 3.0),
    ("thread", 3.0, 1.0, 9.0), ("waistband", 49.0, 19.0, 150.0), ("webbing strap", 33.0, 8.0, 110.0), ("zipper", 16.0, 7.0, 48.0),
]
#: material, kgCO2e per kg; by table version
FACTORS = {
    "v1": [("cotton", 3.4151), ("organic cotton", 0.9991), ("polyester", 4.8288), ("nylon", 12.3703), ("viscose", 4.9672), ("elastane", 7.915), ("wool", 28.9041), ("acrylic", 11.0771), ("brass", 4.2), ("metal", 3.5)],
    "v2": [("cotton", 3.4151), ("organic cotton", 0.9991), ("polyester", 5.3), ("nylon", 12.3703), ("viscose", 4.9672), ("elastane", 7.915), ("wool", 28.9041), ("acrylic", 11.0771), ("brass", 4.2), ("metal", 3.5)],
}
#: The expected source columns and their coarse types.
COLUMN_TYPES = [
    ("source_row_id", "integer"), ("style_id", "string"), ("sku", "string"), ("component", "string"), ("material", "string"), ("composition", "string"),
    ("net_weight", "string"), ("supplier", "string"), ("country", "string"), ("order_date", "string"), ("quantity", "integer"), ("unit_price", "float"),
]


def case(subject: str, table: dict, default: str = "NULL") -> str:
    quoted = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE {subject} " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in table.items()) + f" ELSE {default} END"


def values(rows: list[tuple], columns: str) -> str:
    quoted = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else repr(v)
    return "(VALUES " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows) + f") AS t({columns})"


def picked(names: list[str], at: str) -> str:
    return case(f"({at})", dict(enumerate(names)))


BOM = f"""
lines_ AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(W.LINE_ORDER)}) AS k FROM lineitem),
joined_ AS (
  SELECT l_orderkey * {W.STEP} + k AS id, l_orderkey, CAST(l_quantity AS BIGINT) AS q, CAST(floor(l_extendedprice / l_quantity) AS BIGINT) AS price,
         l_shipdate, l_suppkey, s_nationkey, p_size, p_type,
         {case("split_part(p_name, ' ', 2)", W.COMPONENTS)} AS component, {case("split_part(p_name, ' ', 1)", W.FIBRES)} AS material,
         upper(substr(p_type, 1, 3)) || '-' || lpad(regexp_extract(p_brand, '([0-9]+)', 1), 2, '0') AS style_id
  FROM lines_ JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey),
weighed_ AS (
  SELECT *, CAST(CASE WHEN component IN ('webbing strap', 'mystery trim') THEN 8 + 2 * q WHEN component = 'zipper' AND p_type = 'ECONOMY' THEN 200
                      WHEN component = 'sequin panel' THEN 33
                      ELSE greatest(1, floor({case("component", {c: int(r) for c, r, _, _ in WEIGHTS})} * (90 + p_size % 21) / 100.0)) END AS BIGINT) AS true_weight
  FROM joined_),
bom AS (
  SELECT id, true_weight, CAST(id AS VARCHAR) AS source_row_id, style_id, style_id || '-' || CAST(l_orderkey AS VARCHAR) AS sku, component, material,
         CASE id % 11 WHEN 0 THEN '70/30 CO/PL' WHEN 1 THEN '80% cotton / 20% polyester' WHEN 2 THEN '80% cotton / 30% polyester' WHEN 3 THEN 'mostly cotton' WHEN 4 THEN '' ELSE '100% ' || material END AS composition,
         CASE WHEN component = 'sequin panel' THEN CASE WHEN id % 500 = 0 THEN true_weight || ' g' ELSE '' END
              WHEN id % 20 < 7 THEN '' WHEN id % 997 = 0 THEN '0 g'
              WHEN id % 1499 = 0 AND component <> 'mystery trim' THEN '1000000000 g' WHEN id % 1499 = 1 AND component <> 'mystery trim' THEN '5000 g'
              WHEN id % 13 = 0 THEN printf('%d.%03d', true_weight // 1000, true_weight % 1000) || ' kg' ELSE true_weight || ' g' END AS net_weight,
         {picked(W.SPELLINGS, "l_suppkey % 15")} AS supplier,
         CASE id % 103 WHEN 0 THEN 'Atlantis' WHEN 1 THEN '' ELSE {picked(W.COUNTRY_NAMES, "s_nationkey % 5")} END AS country,
         CASE id % 101 WHEN 0 THEN '2024-13-07' WHEN 1 THEN '2024/02/31' WHEN 2 THEN '' WHEN 3 THEN strftime(l_shipdate, '%Y%m%d') ELSE strftime(l_shipdate, '%Y-%m-%d') END AS order_date,
         CASE id % 211 WHEN 0 THEN '-5' WHEN 1 THEN 'n/a' ELSE CAST(q AS VARCHAR) END AS quantity,
         CASE WHEN id % 1999 = 0 THEN '99999999' WHEN id % 211 = 2 THEN 'nan' ELSE CAST(price AS VARCHAR) END AS unit_price
  FROM weighed_)"""

SECOND = f"""
bom2 AS (
  SELECT id, true_weight, source_row_id, style_id, sku, component,
         CASE WHEN component = 'shell fabric' AND substr(style_id, 1, 3) = 'SMA' AND material = 'cotton' THEN 'organic cotton' ELSE material END AS material,
         composition, net_weight, supplier, country, order_date,
         CASE WHEN regexp_full_match(quantity, '-?[0-9]+') THEN CAST(CAST(floor(CAST(quantity AS BIGINT) * CAST({case("substr(style_id, 1, 3)", W.MULTIPLIERS, "1.0")} AS DOUBLE)) AS BIGINT) AS VARCHAR) ELSE quantity END AS quantity, unit_price
  FROM bom)"""

NAMED = lambda token: f"CASE upper({token}) " + " ".join(f"WHEN '{c}' THEN '{n}'" for c, n in MATERIAL_CODES.items()) + f" ELSE lower({token}) END"
SHORT = r"([0-9]+)\s*/\s*([0-9]+)\s+([A-Za-z]{2,})\s*/\s*([A-Za-z]{2,})"
PART = r"^([0-9]+)\s*%\s*(.+)$"
FLOAT = r"[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|[nN][aA][nN]|[iI][nN][fF]([iI][nN][iI][tT][yY])?)"
GRAMS = r"([0-9]+\.?[0-9]*|\.[0-9]+)\s*(kg|g|KG|Kg|kG|G)"


def norm(name: str = "norm", source: str = "bom") -> str:
    known = ", ".join(f"'{n}'" for n in MATERIAL_NAMES)
    listed = "list_transform(string_split(trim(composition), '/'), lambda p: trim(p))"
    return f"""
{name}_0 AS (
  SELECT *, {listed} AS parts, regexp_full_match(trim(composition), '{SHORT}') AS short FROM {source}),
{name} AS (
  SELECT id, true_weight, printf('r%04d', id) AS record_id, source_row_id, style_id, split_part(style_id, '-', 1) AS category, sku, component, material AS material_raw,
         CASE WHEN lower(trim(material)) IN ({known}) THEN lower(trim(material)) WHEN lower(trim(material)) = 'polyamide' THEN 'nylon' END AS material_normalized,
         CASE WHEN short THEN regexp_extract(trim(composition), '{SHORT}', 1) || '% ' || {NAMED(f"regexp_extract(trim(composition), '{SHORT}', 3)")} || ' / ' || regexp_extract(trim(composition), '{SHORT}', 2) || '% ' || {NAMED(f"regexp_extract(trim(composition), '{SHORT}', 4)")}
              WHEN len(list_filter(parts, lambda p: NOT regexp_matches(p, '{PART}'))) = 0
              THEN array_to_string(list_transform(parts, lambda p: CAST(CAST(regexp_extract(p, '{PART}', 1) AS INT) AS VARCHAR) || '% ' || {NAMED(f"trim(regexp_extract(p, '{PART}', 2))")}), ' / ') END AS composition,
         CASE WHEN short THEN CAST(regexp_extract(trim(composition), '{SHORT}', 1) AS DOUBLE) / 100 + CAST(regexp_extract(trim(composition), '{SHORT}', 2) AS DOUBLE) / 100
              WHEN len(list_filter(parts, lambda p: NOT regexp_matches(p, '{PART}'))) = 0 THEN list_sum(list_transform(parts, lambda p: CAST(regexp_extract(p, '{PART}', 1) AS DOUBLE) / 100)) END AS composition_total,
         CASE WHEN regexp_full_match(trim(net_weight), '{GRAMS}') THEN try_cast(regexp_extract(trim(net_weight), '{GRAMS}', 1) AS DOUBLE) * CASE WHEN lower(regexp_extract(trim(net_weight), '{GRAMS}', 2)) = 'kg' THEN 1000 ELSE 1 END END AS component_weight_g,
         supplier AS supplier_raw, {case("lower(trim(country))", ISO_CODES)} AS factory_country_iso,
         CASE WHEN regexp_full_match(trim(order_date), '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN try_cast(trim(order_date) AS DATE)
              WHEN regexp_full_match(trim(order_date), '[0-9]{{8}}') THEN try_cast(substr(trim(order_date), 1, 4) || '-' || substr(trim(order_date), 5, 2) || '-' || substr(trim(order_date), 7, 2) AS DATE) END AS order_date,
         CASE WHEN regexp_full_match(trim(quantity), '[+-]?[0-9]+') THEN try_cast(trim(quantity) AS BIGINT) END AS quantity,
         CASE WHEN regexp_full_match(trim(unit_price), '{FLOAT}') THEN try_cast(trim(unit_price) AS DOUBLE) END AS unit_price,
         composition AS raw_composition, net_weight AS raw_net_weight, country AS raw_country, order_date AS raw_order_date, quantity AS raw_quantity, unit_price AS raw_unit_price
  FROM {name}_0)"""


#: Similarity of the workload's spellings, worked out with the standard library; null: no match above the cutoff.
SUPPLIER_MATCHES = [
    ("Acme Textiles", "Acme Textiles", 1.0), ("Bharat Mills", "Bharat Mills", 1.0), ("Golden Thread", "Golden Thread", 1.0), ("Nordic Weave", "Nordic Weave", 1.0), ("Oceanic Fabrics", "Oceanic Fabrics", 1.0),
    ("Acme Textiles Ltd.", "Acme Textiles", 0.8387), ("ACME TEXTILES", "Acme Textiles", 1.0), ("acme textiles ltd", "Acme Textiles", 0.8667), ("Golden Thread Co.", "Golden Thread", 0.8667),
    ("Golden Thread Company", "Golden Thread", 0.7647), ("Bharat Mills Pvt Ltd", "Bharat Mills", 0.75), ("Oceanic Fabric", "Oceanic Fabrics", 0.9655), ("OCEANIC FABRICS INC", "Oceanic Fabrics", 0.8824),
    ("Nordic Weave AB", "Nordic Weave", 0.8889), ("Zeta Holdings", None, None),
]
PROPOSALS = [("Organic cottn", "organic cotton", 0.963)]
TYPO = "(CASE WHEN material_normalized IS NULL AND material_raw = 'Organic cottn' THEN 'organic cotton' END)"


def stats(name: str, keys: str, source: str = "obs") -> str:
    return f"""
{name}_m AS (SELECT {keys}, count(*) AS n, median(w) AS med FROM {source} GROUP BY {keys}),
{name} AS (SELECT {keys}, any_value(n) AS n, any_value(med) AS med, median(abs(w - med)) AS mad FROM {source} JOIN {name}_m USING ({keys}) GROUP BY {keys})"""


def filled(name: str = "filled", source: str = "norm", tag: str = "") -> str:
    good = lambda s: f"({s}.n >= 5 AND {s}.med <> 0 AND {s}.mad / {s}.med <= 0.3 AND (lo IS NULL OR {s}.med BETWEEN lo AND hi))"
    s1, s2, s3 = (f"s{i}{tag}" for i in (1, 2, 3))
    pick = lambda c: f"CASE WHEN {good(s1)} THEN {s1}.{c} WHEN {good(s2)} THEN {s2}.{c} WHEN {good(s3)} THEN {s3}.{c} END"
    level = f"CASE WHEN {good(s1)} THEN 'material_component_category' WHEN {good(s2)} THEN 'component_category' WHEN {good(s3)} THEN 'category' END"
    return f"""
obs{tag} AS (SELECT coalesce(material_normalized, lower(material_raw)) AS fm, component, category, component_weight_g AS w FROM {source} WHERE component_weight_g > 0),
{stats(s1, "fm, component, category", f"obs{tag}")},
{stats(s2, "component, category", f"obs{tag}")},
{stats(s3, "category", f"obs{tag}")},
band{tag} AS (SELECT * FROM {values(WEIGHTS, "component, ref_g, lo, hi")}),
picked{tag} AS (
  SELECT x.*, ref_g, lo, hi, {pick("n")} AS p_n, {pick("med")} AS p_med, {pick("mad")} AS p_mad, {level} AS p_level
  FROM (SELECT *, coalesce(material_normalized, lower(material_raw)) AS fm FROM {source}) x LEFT JOIN band{tag} USING (component)
  LEFT JOIN {s1} ON {s1}.fm = x.fm AND {s1}.component = x.component AND {s1}.category = x.category
  LEFT JOIN {s2} ON {s2}.component = x.component AND {s2}.category = x.category LEFT JOIN {s3} ON {s3}.category = x.category),
{name} AS (
  SELECT *, CASE WHEN component_weight_g IS NOT NULL THEN NULL WHEN p_med IS NOT NULL THEN 'grouped_median' WHEN ref_g IS NOT NULL THEN 'reference_constant' END AS tier,
         coalesce(component_weight_g, p_med, ref_g) AS weight_g,
         CASE WHEN component_weight_g IS NOT NULL THEN NULL WHEN p_med IS NOT NULL THEN p_med - p_mad ELSE lo END AS fill_low,
         CASE WHEN component_weight_g IS NOT NULL THEN NULL WHEN p_med IS NOT NULL THEN p_med + p_mad ELSE hi END AS fill_high,
         CASE WHEN component_weight_g IS NULL AND p_med IS NULL AND ref_g IS NULL THEN 'action_required' WHEN component_weight_g > 0 AND component_weight_g NOT BETWEEN lo AND hi THEN 'flagged' ELSE 'ok' END AS quality_status
  FROM picked{tag})"""


def foot(name: str = "foot", source: str = "filled", version: str = "v1") -> str:
    return f"""
factors_{name} AS (SELECT * FROM {values(FACTORS[version], "material, factor")}),
{name} AS (
  SELECT f.* , CASE WHEN weight_g IS NOT NULL THEN x.factor END AS factor, weight_g / 1000 * x.factor AS est,
         CASE WHEN tier IS NOT NULL THEN fill_low / 1000 * x.factor END AS low, CASE WHEN tier IS NOT NULL THEN fill_high / 1000 * x.factor END AS high,
         CASE WHEN weight_g IS NULL THEN 'missing' WHEN x.factor IS NOT NULL AND tier IS NOT NULL THEN 'filled' ELSE 'observed' END AS weight_source,
         CASE WHEN weight_g IS NULL THEN 'no_weight' WHEN x.factor IS NULL THEN 'unmapped' WHEN quality_status = 'flagged' THEN 'flagged' ELSE 'costed' END AS status
  FROM {source} f LEFT JOIN factors_{name} x ON x.material = f.material_normalized)"""


def q(*parts: str, select: str) -> str:
    return "WITH " + ",".join(parts) + "\n" + select


NORM = (BOM, norm())
FILLED = (*NORM, filled())
FOOT = (*FILLED, foot())


def thousandths(*names: str) -> str:
    return ", ".join(f"CAST(round(CASE WHEN isnan({n}) THEN NULL ELSE {n} END * 1000) AS BIGINT) AS {n}_milli" for n in names)


#: Events of normalizing, filling and costing, one for every cell that a rule changed.
EVENTS = f"""
events AS (
  SELECT id, record_id, 0 AS stage, 1 AS rule_ord, 'quantity' AS col, 'amount_coerce' AS rule_id, 'normalize_amount' AS source_type, raw_quantity AS value_before, CAST(quantity AS VARCHAR) AS value_after, CAST(quantity AS DOUBLE) AS number, CAST(NULL AS DOUBLE) AS low, CAST(NULL AS DOUBLE) AS high FROM foot WHERE quantity IS NOT NULL
  UNION ALL SELECT id, record_id, 0, 2, 'unit_price', 'amount_coerce', 'normalize_amount', raw_unit_price, NULL, unit_price, NULL, NULL FROM foot WHERE unit_price IS NOT NULL
  UNION ALL SELECT id, record_id, 0, 3, 'component_weight_g', 'weight_to_grams', 'normalize_unit', raw_net_weight, NULL, component_weight_g, NULL, NULL FROM foot WHERE component_weight_g IS NOT NULL
  UNION ALL SELECT id, record_id, 0, 4, 'composition', 'composition_parse', 'normalize_composition', raw_composition, composition, NULL, NULL, NULL FROM foot WHERE composition IS NOT NULL
  UNION ALL SELECT id, record_id, 0, 5, 'order_date', 'date_iso', 'normalize_date', raw_order_date, strftime(order_date, '%Y-%m-%d'), NULL, NULL, NULL FROM foot WHERE order_date IS NOT NULL
  UNION ALL SELECT id, record_id, 0, 6, 'factory_country_iso', 'country_iso', 'normalize_country', raw_country, factory_country_iso, NULL, NULL, NULL FROM foot WHERE factory_country_iso IS NOT NULL
  UNION ALL SELECT id, record_id, 0, 7, 'supplier_normalized', 'supplier_fuzzy', 'normalize_supplier', supplier_raw, canonical, NULL, NULL, NULL FROM foot JOIN {values(SUPPLIER_MATCHES, "spelling, canonical, ratio")} ON spelling = supplier_raw WHERE canonical IS NOT NULL
  UNION ALL SELECT id, record_id, 0, 8, 'material_normalized', 'material_vocab', 'normalize_material', material_raw, material_normalized, NULL, NULL, NULL FROM foot WHERE material_normalized IS NOT NULL
  UNION ALL SELECT id, record_id, 3, 0, 'component_weight_g', CASE tier WHEN 'grouped_median' THEN 'weight_median' ELSE 'weight_constant' END, tier, '', NULL, weight_g, fill_low, fill_high FROM foot WHERE tier IN ('grouped_median', 'reference_constant')
  UNION ALL SELECT id, record_id, 4, 0, 'estimated_kgco2e', 'footprint', 'derived_formula', NULL, NULL, est, low, high FROM foot WHERE est IS NOT NULL)"""
LINES = (
    BOM, SECOND, norm("norm", "bom"), norm("normb", "bom2"), filled("filled", "norm"), filled("filledb", "normb", "b"), foot("foot", "filled", "v1"), foot("footb", "filledb", "v2"),
    """
lines AS (
  SELECT 'v1' AS vintage, id, record_id, material_normalized AS material, quantity, weight_g / 1000 AS weight_kg, factor, quantity * weight_g / 1000 AS mass_kg, quantity * weight_g / 1000 * factor AS footprint_kgco2e FROM foot WHERE status = 'costed' AND quantity IS NOT NULL
  UNION ALL
  SELECT 'v2', id, record_id, material_normalized, quantity, weight_g / 1000, factor, quantity * weight_g / 1000, quantity * weight_g / 1000 * factor FROM footb WHERE status = 'costed' AND quantity IS NOT NULL)""",
    """
mart AS (SELECT vintage, material, sum(mass_kg) AS mass_kg, min(factor) AS factor, sum(footprint_kgco2e) AS footprint_kgco2e FROM lines WHERE mass_kg >= 0 GROUP BY vintage, material)""",
)
EFFECTS = """
effects AS (
  SELECT material, coalesce(a.mass_kg * a.factor, 0) AS f_from, coalesce(b.mass_kg * b.factor, 0) AS f_to, coalesce(coalesce(a.mass_kg, 0) * (b.factor - a.factor), 0) AS intensity
  FROM (SELECT * FROM mart WHERE vintage = 'v1') a FULL JOIN (SELECT * FROM mart WHERE vintage = 'v2') b USING (material))"""


def bounds(column: str, tag: str) -> str:
    return f"""
pos{tag} AS (SELECT ln({column}) AS x FROM norm WHERE {column} > 0 AND NOT isnan({column})),
med{tag} AS (SELECT median(x) AS med, count(*) AS n FROM pos{tag}),
mad{tag} AS (SELECT med, n, (SELECT median(abs(x - med)) FROM pos{tag}, med{tag}) AS mad FROM med{tag})"""


def outlier_rows(column: str, tag: str) -> str:
    return f"SELECT id, record_id, {column} AS value FROM norm, mad{tag} WHERE {column} > 0 AND NOT isnan({column}) AND n >= 3 AND mad > 0 AND 0.6745 * abs(ln({column}) - med) / mad > 3.5"


FINDINGS = (
    *FOOT, bounds("component_weight_g", "w"), bounds("unit_price", "p"),
    f"""
dups AS (SELECT id, record_id, row_number() OVER (PARTITION BY style_id, sku, component ORDER BY id) AS nth, style_id, sku, component FROM norm),
found AS (
  SELECT id, 0 AS stage, record_id, 'material_normalized' AS col, 'mapping' AS category, 'medium' AS severity, 'organic cotton' AS proposed, material_raw AS evidence FROM norm WHERE {TYPO} IS NOT NULL
  UNION ALL SELECT id, 1, record_id, 'order_date', 'validity', 'medium', NULL, NULL FROM norm WHERE trim(raw_order_date) <> '' AND order_date IS NULL
  UNION ALL SELECT id, 1, record_id, 'quantity', 'validity', 'high', NULL, NULL FROM norm WHERE quantity < 0
  UNION ALL SELECT id, 2, record_id, 'factory_country_iso', 'completeness', 'low', NULL, NULL FROM norm WHERE factory_country_iso IS NULL
  UNION ALL SELECT id, 3, record_id, NULL, 'duplicate_key', 'medium', NULL, NULL FROM dups WHERE nth > 1
  UNION ALL SELECT id, 4, record_id, 'component_weight_g', 'cross_field', 'high', NULL, NULL FROM norm WHERE component_weight_g = 0 AND (quantity > 0 OR (unit_price > 0 AND NOT isnan(unit_price)))
  UNION ALL SELECT id, 4, record_id, 'composition', 'cross_field', 'medium', NULL, NULL FROM norm WHERE abs(composition_total - 1) > 0.001
  UNION ALL SELECT id, 5, record_id, 'component_weight_g', 'distribution', 'medium', NULL, NULL FROM ({outlier_rows("component_weight_g", "w")})
  UNION ALL SELECT id, 6, record_id, 'unit_price', 'distribution', 'medium', NULL, NULL FROM ({outlier_rows("unit_price", "p")})
  UNION ALL SELECT id, 7, record_id, 'component_weight_g', 'completeness', 'medium', NULL, NULL FROM filled WHERE quality_status = 'action_required'
  UNION ALL SELECT id, 7, record_id, 'component_weight_g', 'plausibility', 'high', NULL, NULL FROM filled WHERE quality_status = 'flagged'
  UNION ALL SELECT id, 8, record_id, 'estimated_kgco2e', 'mapping', 'medium', NULL, material_raw FROM foot WHERE status = 'unmapped'),
items AS (SELECT *, concat_ws(':', record_id, coalesce(col, '-'), category) AS finding_id FROM found)""",
)
#: The example decision log of the review queries: every seventh proposal is approved, the next rejected, some approvals taken back.
DECIDED = """
decisions AS (
  SELECT 2 * id AS seq, finding_id, CASE id % 7 WHEN 0 THEN 'approved' ELSE 'rejected' END AS status FROM items WHERE stage = 0 AND id % 7 <= 1
  UNION ALL SELECT 2 * id + 1, finding_id, 'rejected' FROM items WHERE stage = 0 AND id % 49 = 0),
latest AS (SELECT finding_id, arg_max(status, seq) AS status, count(*) AS n_decisions FROM decisions GROUP BY finding_id)"""
