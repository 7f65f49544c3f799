"""Parsers of messy text cells, as column expressions; what doesn't parse is null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .reference import CODES

INTEGER = r"^[+-]?[0-9]+$"
FLOAT = r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|[nN][aA][nN]|[iI][nN][fF]([iI][nN][iI][tT][yY])?)$"
WEIGHT = r"^([0-9]+\.?[0-9]*|\.[0-9]+)\s*(kg|g|KG|Kg|kG|G)$"
SHORTHAND = r"^([0-9]+)\s*/\s*([0-9]+)\s+([A-Za-z]{2,})\s*/\s*([A-Za-z]{2,})$"
PERCENT = r"^([0-9]+)\s*%\s*(.+)$"


def once(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, as a lambda's variable; keeps generated code small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def to_int(raw: Column) -> Column:
    """64-bit integer; anything else, and what overflows, is null."""
    return once(F.trim(raw), lambda x: F.when(x.rlike(INTEGER), x.try_cast("bigint")))


def to_float(raw: Column) -> Column:
    return once(F.trim(raw), lambda x: F.when(x.rlike(FLOAT), x.try_cast("double")))


def parse_date(raw: Column) -> Column:
    """ISO calendar dates with or without hyphens, and ISO week dates."""
    week = r"^([0-9]{4})-?W([0-9]{2})-?([1-7])$"

    def of_week(x: Column) -> Column:
        year, number, day = (F.regexp_extract(x, week, i).try_cast("int") for i in (1, 2, 3))
        # The Monday of week 1 is the Monday of the week with January 4; December 28 lies in the last week.
        fourth = F.make_date(year, F.lit(1), F.lit(4))
        monday = F.date_sub(fourth, F.weekday(fourth))
        last = F.weekofyear(F.make_date(year, F.lit(12), F.lit(28)))
        return F.when((year > 0) & (number >= 1) & (number <= last), F.date_add(monday, (number - 1) * 7 + day - 1))

    def of(x: Column) -> Column:
        compact = F.concat_ws("-", F.substring(x, 1, 4), F.substring(x, 5, 2), F.substring(x, 7, 2))
        plain = F.when(x.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), x).when(x.rlike(r"^[0-9]{8}$"), compact)
        return F.coalesce(plain.try_cast("date"), F.when(x.rlike(week), of_week(x)))

    return once(F.trim(raw), of)


def parse_weight(raw: Column) -> Column:
    """Grams from ``<number> g`` or ``<number> kg``."""

    def of(x: Column) -> Column:
        number = F.regexp_extract(x, WEIGHT, 1).try_cast("double")
        return F.when(x.rlike(WEIGHT), F.when(F.lower(F.regexp_extract(x, WEIGHT, 2)) == "kg", number * 1000).otherwise(number))

    return once(F.trim(raw), of)


def parse_composition(raw: Column) -> Column:
    """array<struct<fraction, material>> from ``70/30 CO/PL`` or ``80% a / 20% b``; null if any part is bad."""
    codes = F.create_map(*[F.lit(v) for pair in sorted(CODES.items()) for v in pair])

    def pair(percent: Column, material: Column) -> Column:
        return F.struct((percent.try_cast("double") / 100).alias("fraction"), material.alias("material"))

    def named(token: Column) -> Column:
        return F.coalesce(F.try_element_at(codes, F.upper(token)), F.lower(token))

    def of(x: Column) -> Column:
        short = F.array(*[pair(F.regexp_extract(x, SHORTHAND, i), named(F.regexp_extract(x, SHORTHAND, i + 2))) for i in (1, 2)])
        parts = F.transform(F.split(x, "/"), lambda p: F.trim(p))
        listed = F.transform(parts, lambda p: pair(F.regexp_extract(p, PERCENT, 1), named(F.trim(F.regexp_extract(p, PERCENT, 2)))))
        return F.when(x.rlike(SHORTHAND), short).when(F.forall(parts, lambda p: p.rlike(PERCENT)), listed)

    return once(F.trim(raw), of)


def format_composition(pairs: Column) -> Column:
    each = F.transform(pairs, lambda p: F.concat(F.round(p["fraction"] * 100).cast("int").cast("string"), F.lit("% "), p["material"]))
    return F.array_join(each, " / ")


def composition_total(pairs: Column) -> Column:
    return F.aggregate(pairs, F.lit(0.0), lambda a, p: a + p["fraction"])


def number_text(x: Column) -> Column:
    """Whole numbers without a decimal point, others as Spark prints them."""
    return F.when((x == F.floor(x)) & (F.abs(x) < 9e15), x.cast("bigint").cast("string")).otherwise(x.cast("string"))


def category(style: Column) -> Column:
    return F.substring_index(style, "-", 1)


def record_id(row_id: Column) -> Column:
    # The formatter is slow: it is left for ids below 0.
    digits = row_id.cast("string")
    return F.when(row_id >= 1000, F.concat(F.lit("r"), digits)).when(row_id >= 0, F.concat(F.lit("r"), F.lpad(digits, 4, "0"))).otherwise(F.format_string("r%04d", row_id))


def run_id(content_hash: Column, version: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", content_hash, version), 256), 1, 16)


def positive(x: Column) -> Column:
    """Above zero; NaN is not."""
    return F.nanvl(x.cast("double"), F.lit(0.0)) > 0
