"""Files into all-text rows: format and encoding by content, CSV and workbook readers."""

from __future__ import annotations

import csv
import datetime
import io
import re
import zipfile
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import islice
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from . import csv_records

WORKBOOK_MAGIC = b"PK\x03\x04"


class UnsupportedFormatError(ValueError):
    """The bytes have a workbook's signature but no readable workbook."""


def read_bytes(spark: SparkSession, paths: str) -> DataFrame:
    """path, file (the name that metadata of readers has), content and facts of each file; any store Spark reads, any number of files."""
    raw = spark.read.format("binaryFile").load(paths).select("path", F.col("_metadata.file_path").alias("file"), "length", "content")
    return raw.withColumns({"format": file_format(F.col("content")), "content_hash": content_hash(F.col("content")), "encoding": encoding(F.col("content"))})


def file_format(content: Column) -> Column:
    return F.when(F.substring(content, 1, 4) == F.unhex(F.lit("504B0304")), "xlsx").otherwise("csv")


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def encoding(content: Column) -> Column:
    return F.when(F.is_valid_utf8(content.cast("string")), "utf-8").otherwise("windows-1252")


def from_latin(text: Column) -> Column:
    """Windows-1252 read as ISO-8859-1: what the two differ in is bytes 80 to 9F. Undefined bytes become U+FFFD."""
    codes = bytes(range(0x80, 0xA0))
    return F.translate(text, codes.decode("latin-1"), codes.decode("cp1252", "replace"))


def decoded(content: Column, charset: str | None = None) -> Column:
    """Text without a byte-order mark; Windows-1252 where the bytes are not UTF-8, or as ``charset`` says."""
    utf8, latin = content.cast("string"), from_latin(F.decode(content, "ISO-8859-1"))
    plain = {"utf-8": utf8, "windows-1252": latin}.get(charset, F.when(F.is_valid_utf8(utf8), utf8).otherwise(latin))
    return F.regexp_replace(plain, "^﻿", "")


def delimiter(header: Column) -> Column:
    """``;`` where the first line has more of them than of commas."""
    count = lambda c: F.length(header) - F.length(F.replace(header, F.lit(c), F.lit("")))
    return F.when(count(";") > count(","), ";").otherwise(",")


def first_line(text: Column) -> Column:
    return F.regexp_extract(text, r"^([^\r\n]*)", 1)


def column_names(first: str, sep: str) -> list[str]:
    """Names in the first record."""
    return named(next(csv.reader(io.StringIO(first, newline=""), delimiter=sep), []))


def named(names: list[str]) -> list[str]:
    """Empty names after their place, repeated ones with it."""
    often = Counter(n.lower() for n in names)
    return [f"_c{i}" if n == "" else f"{n}{i}" if often[n.lower()] > 1 else n for i, n in enumerate(names)]


def split_cells(record: Column, sep: str, width: int) -> Column:
    """The first ``width`` cells of a record's text, as an array; missing ones are null."""
    kind = ", ".join(f"c{i} string" for i in range(max(width, 1)))
    parsed = F.from_csv(record, kind, {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE", "lineSep": "\x00\x01"})
    return F.transform(F.array(parsed), lambda r: F.array(*[r[f"c{i}"] for i in range(max(width, 1))]))[0]


def record_text(record: Column, charset: str | None = None) -> Column:
    return F.regexp_replace(decoded(record, charset), "\r$", "")


def read_csv(spark: SparkSession, path: str, sep: str = ",", charset: str = "utf-8") -> DataFrame:
    """All columns as text, blanks and missing cells as ''; cells beyond the header's are left out. Large files are read by many tasks."""
    head = csv_records.header(csv_records.lines_of(spark, path), sep.encode())
    first = head.decode("cp1252", "replace") if charset == "windows-1252" else head.decode("utf-8-sig", "replace")
    names = column_names(first.removesuffix("\r"), sep)
    rows = csv_records.records(spark, path, sep).select(record_text(F.col("record"), charset).alias("record")).where(F.col("record") != "")
    cells = rows.select(split_cells(F.col("record"), sep, len(names)).alias("cells"))
    return cells.select(*[F.coalesce(F.col("cells")[i], F.lit("")).alias(n) for i, n in enumerate(names)])


@dataclass
class Sheets:
    """Many files at once: the names of each file's columns, and all cells as file, pos, value."""

    headers: dict[str, list[str]]
    cells: DataFrame
    errors: dict[str, str]


def read_sheets(spark: SparkSession, facts: list[Row]) -> Sheets:
    """The cells of all files in ``facts`` (path, file, format, sep, encoding), by file and column number; headers, a row per file, reach the driver."""
    headers: dict[str, list[str]] = {}
    errors: dict[str, str] = {}
    parts = [spark.createDataFrame([], "file string, pos int, value string")]

    def add(rows: DataFrame, cells: Column, some: dict[str, list[str]]) -> None:
        headers.update(some)
        known = F.broadcast(spark.createDataFrame([(f, len(n)) for f, n in some.items()], "file string, width int"))
        whole = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.coalesce(F.get(cells, i), F.lit("")))
        parts.append(rows.join(known, "file").where("width > 0").select("file", F.posexplode(whole).alias("pos", "value")))

    for sep, charset in sorted({(f["sep"], f["encoding"]) for f in facts if f["format"] == "csv"}):
        paths = [f["path"] for f in facts if (f["format"], f["sep"], f["encoding"]) == ("csv", sep, charset)]
        records = csv_records.records(spark, paths, sep, keyed=True).select("file", "first", record_text(F.col("record"), charset).alias("record"))
        heads = records.where("first").collect()
        some = {r["file"]: column_names(r["record"], sep) for r in heads}
        data = records.where(~F.col("first") & (F.col("record") != ""))
        add(data, split_cells(F.col("record"), sep, max(map(len, some.values()), default=1)), some)
    if books := [f["path"] for f in facts if f["format"] == "xlsx"]:
        cells = workbook_cells(spark, books)
        heads = cells.where("first").collect()
        errors = {r["file"]: r["error"] for r in heads if r["error"]}
        add(cells.where("not first"), F.col("cells"), {r["file"]: named(r["cells"]) for r in heads if not r["error"]})
    return Sheets(headers, reduce(DataFrame.unionByName, parts), errors)


def cell_text(kind: str, value: str, dated: bool) -> str:
    """Whole numbers without a decimal point; dates at midnight in ISO form."""
    if kind != "n" or value == "":
        return {"1": "True", "0": "False"}.get(value, value) if kind == "b" else value
    number = float(value)
    if dated:
        moment = datetime.datetime(1899, 12, 30) + datetime.timedelta(days=number)
        return moment.date().isoformat() if moment.time() == datetime.time() else str(moment)
    return str(int(number)) if number.is_integer() else str(number)


def workbook_rows(content: bytes) -> Iterator[list[str]]:
    """The first sheet's rows as text; fully blank rows are left out."""
    local = lambda e: e.tag.rpartition("}")[2]
    try:
        book = zipfile.ZipFile(io.BytesIO(content))
        outline = ElementTree.fromstring(book.read("xl/workbook.xml"))
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        sheet = next(e for e in outline.iter() if local(e) == "sheet")
        target = links[next(v for k, v in sheet.attrib.items() if k.rpartition("}")[2] == "id")].lstrip("/")
        body = book.read(target if target.startswith("xl/") else f"xl/{target}")
        names = set(book.namelist())
        shared = ["".join(t.text or "" for t in s.iter() if local(t) == "t") for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        formats: list[bool] = []
        if "xl/styles.xml" in names:
            styles = ElementTree.fromstring(book.read("xl/styles.xml"))
            own = {e.get("numFmtId"): bool(re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", e.get("formatCode", "")).lower())) for e in styles.iter() if local(e) == "numFmt"}
            cells = next((e for e in styles if local(e) == "cellXfs"), [])
            # Built-in number formats 14 to 22 and 45 to 47 are dates and times.
            formats = [own.get(x.get("numFmtId"), 14 <= int(x.get("numFmtId") or 0) <= 22 or 45 <= int(x.get("numFmtId") or 0) <= 47) for x in cells]
    except (KeyError, StopIteration, OSError, zipfile.BadZipFile, ElementTree.ParseError) as error:
        raise UnsupportedFormatError(f"workbook signature but not a readable workbook: {error}") from error
    for row in (e for e in ElementTree.fromstring(body).iter() if local(e) == "row"):
        cells: list[str] = []
        for cell in row:
            letters = re.match(r"[A-Z]*", cell.get("r") or "")[0]
            at = 0
            for c in letters:
                at = at * 26 + ord(c) - 64
            at = at - 1 if letters else len(cells)
            kind, style = cell.get("t") or "n", int(cell.get("s") or 0)
            value = next((v.text or "" for v in cell if local(v) == "v"), "")
            if kind == "s" and value:
                value = shared[int(value)]
            elif kind == "inlineStr":
                value = "".join(t.text or "" for t in cell.iter() if local(t) == "t")
            cells += [""] * (at - len(cells)) + [cell_text(kind, value, style < len(formats) and formats[style])]
        if any(cells):
            yield cells


def workbook_cells(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, first, cells of every row of the first sheets, one task per file; a file that is no workbook gives its error instead."""
    schema = pa.schema([("file", pa.string()), ("first", pa.bool_()), ("cells", pa.list_(pa.string())), ("error", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                rows, first = workbook_rows(content.as_py()), True
                try:
                    while some := list(islice(rows, 1 if first else 1000)):
                        n = len(some)
                        yield pa.record_batch([pa.array([path.as_py()] * n), pa.array([first] * n), pa.array(some, schema.field("cells").type), pa.nulls(n, pa.string())], schema=schema)
                        first = False
                except UnsupportedFormatError as error:
                    yield pa.record_batch([[path.as_py()], [True], pa.nulls(1, schema.field("cells").type), [str(error)]], schema=schema)

    files = spark.read.format("binaryFile").load(paths).select(F.col("_metadata.file_path").alias("path"), "content")
    return files.mapInArrow(read, "file string, first boolean, cells array<string>, error string")


def read_workbook(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """First sheets of workbooks as text cells. Every file has its own header in row 1, and its cells go by their names: columns may
    come in any order, and what a file lacks is blank. Headers, a row per file, reach the driver."""
    cells = workbook_cells(spark, paths)
    heads = cells.where("first").select("file", "cells", "error").collect()
    if broken := [r["error"] for r in heads if r["error"]]:
        raise UnsupportedFormatError(broken[0])
    headers = {r["file"]: named(r["cells"]) for r in sorted(heads)}
    names = list(dict.fromkeys(n for h in headers.values() for n in h))
    at = F.broadcast(spark.createDataFrame([(f, [h.index(n) if n in h else -1 for n in names]) for f, h in headers.items()], "file string, at array<int>"))
    rows = cells.where("not first").join(at, "file")
    pick = lambda i: F.when(F.col("at")[i] >= 0, F.get("cells", F.col("at")[i]))
    return rows.select(*[F.coalesce(pick(i), F.lit("")).alias(n) for i, n in enumerate(names)])


def facts_of(spark: SparkSession, paths: str) -> DataFrame:
    """What the bytes of each file say: path, file, length, format, content_hash, encoding, sep."""
    line = first_line(decoded(F.col("content")))
    return read_bytes(spark, paths).select("path", "file", "length", "format", "content_hash", F.when(F.col("format") == "csv", F.col("encoding")).otherwise("utf-8").alias("encoding"), delimiter(line).alias("sep"))


def read_any(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    """Rows as text, and what the bytes said: format, encoding, content hash, delimiter."""
    found = facts_of(spark, path).first().asDict()
    if found["format"] == "xlsx":
        return read_workbook(spark, path), found
    return read_csv(spark, path, found["sep"], found["encoding"]), found


def map_external(rows: DataFrame) -> DataFrame:
    """A wide garment list (category, component, material, weight_g, country) to the source contract, ids by position column ``pos``."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    weight = F.when(F.col("weight_g").isNotNull(), F.concat(text("weight_g"), F.lit(" g"))).otherwise("")
    return rows.select(
        F.col("pos").cast("string").alias("source_row_id"), F.concat(text("category"), F.lit("-"), text("pos")).alias("style_id"), F.concat(text("category"), F.lit("-"), text("pos")).alias("sku"),
        text("component").alias("component"), text("material").alias("material"), F.lit("").alias("composition"), weight.alias("net_weight"), F.lit("").alias("supplier"),
        text("country").alias("country"), F.lit("").alias("order_date"), F.lit("1").alias("quantity"), F.lit("").alias("unit_price"),
    )
