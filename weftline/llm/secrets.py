"""Secret scans over an incremental blob ledger.

A version is a row (path, text); its blob id is the SHA-256 of the text, so the same content under many
paths, or in many historical versions, is one blob. The ledger has one row per (blob, rule, rule version)
that was scanned, with the spans found, possibly none. A scan

1. addresses every version by content (narrow: path and blob id, no text moves),
2. forms the (blob, rule, version) pairs of the current rules that the ledger lacks, one text per blob,
3. scans only those and appends them to the ledger, a Parquet table in shared storage,
4. joins the findings back to every path through the blob id.

A new rule, or a new version of one, costs a scan of that rule alone; known blobs cost nothing.

Edge cases: null text counts as empty; a null path is a path like any other; repeated rows give repeated
results; an empty table gives an empty result; very long texts are scanned whole; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, keys_of_rows, staged, text_or_empty


@dataclass(frozen=True)
class Rule:
    """``group``: the group whose length counts; matches where it is shorter than ``least`` are dropped.

    ``hint``: every match contains one of these strings, in lower case, so texts without them are not searched.
    """

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0
    hint: tuple[str, ...] = ()


#: Kinds in the order in which equal starts are listed.
RULES = [
    Rule("assign", 1, r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, ("passw", "secret", "token", "api")),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20, ("akia",)),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
    Rule("private_key", 1, r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, 0, ("private key",)),
    Rule("signed_token", 1, r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 0, ("eyj",)),
]
BASE = ("assign", "access", "hex")
LEDGER = "blob_id binary, kind string, version int, spans array<struct<start:int,end:int>>"


def find_spans(rule: Rule, compiled: re.Pattern, text: str, lowered: str | None = None) -> list[tuple[int, int]]:
    """Leftmost matches that do not overlap, by code points; those that fail the length test are dropped."""
    if rule.hint and lowered is not None and not any(h in lowered for h in rule.hint):
        return []
    return [m.span() for m in compiled.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def scanner(rules: list[Rule]):
    def scan(text: pd.Series, due: pd.Series) -> pd.Series:
        compiled = [re.compile(r.pattern) for r in rules]
        out = []
        for body, which in zip(text, due, strict=True):
            lowered = body.lower()
            out.append([{"kind": rules[i].kind, "version": rules[i].version, "spans": [{"start": a, "end": b} for a, b in find_spans(rules[i], compiled[i], body, lowered)]} for i in which])
        return pd.Series(out)

    return F.pandas_udf(scan, "array<struct<kind:string,version:int,spans:array<struct<start:int,end:int>>>>")


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


class BlobLedger:
    """Scans versions against rules and remembers what it has scanned at ``path``."""

    def __init__(self, spark: SparkSession, path: str | None = None, rules: list[Rule] | None = None):
        self.spark, self.path, self.rules = spark, path or fresh_path(spark, "blob-ledger"), rules or RULES

    def entries(self) -> DataFrame:
        """Ledger rows; none before the first scan."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).parquet(self.path)

    def due(self, blobs: DataFrame) -> DataFrame:
        """blob_id with the indexes of the rules that its ledger entries lack; none is left out, none is doubled."""
        known = self.entries().select("blob_id", F.concat_ws(":", "kind", "version").alias("rule")).groupBy("blob_id").agg(F.collect_set("rule").alias("known"))
        names = F.array(*[F.lit(f"{r.kind}:{r.version}") for r in self.rules])
        joined = blobs.join(known, "blob_id", "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>")))
        wanted = F.filter(F.transform(names, lambda n, i: F.when(~F.array_contains(F.col("known"), n), i)), lambda i: i.isNotNull())
        return joined.select("first", "h", wanted.alias("due")).where(F.size("due") > 0)

    def scan(self, versions: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
        """One row per version: path, blob_id, h. Afterwards the ledger holds every pair of its blobs and the current rules."""
        body = text_or_empty(text)
        # A short hash with the path finds the row again; the blob id always comes from the text itself.
        paths = staged(versions.select(F.col(path).alias("path"), blob_of(body).alias("blob_id"), F.xxhash64(body).alias("h")), "blob-paths")
        blobs = paths.groupBy("blob_id").agg(F.min("path").alias("first"), F.min("h").alias("h"))
        due = staged(self.due(blobs), "blob-due")
        # One text per blob goes on: every text moves once, past the keys of the due blobs.
        rows = versions.select(F.col(path).alias("_path"), body.alias("_text")).withColumn("_h", F.xxhash64("_text"))
        unseen = rows.join(keys_of_rows(due), rows["_path"].eqNullSafe(due["first"]) & (rows["_h"] == due["h"])).withColumn("_blob", blob_of(F.col("_text")))
        found = unseen.select("_blob", F.explode(scanner(self.rules)("_text", "due")).alias("f"))
        # Rows that repeat with path and text are scanned alike; readers of the ledger take equal entries as one.
        found.select(F.col("_blob").alias("blob_id"), "f.kind", "f.version", "f.spans").write.mode("append").parquet(self.path)
        return paths

    def findings(self, paths: DataFrame) -> DataFrame:
        """Every path with the spans of its blob under the current rules, kinds in rule order."""
        order = F.array(*[F.lit(f"{r.kind}:{r.version}") for r in self.rules])
        current = self.entries().withColumn("rank", F.array_position(order, F.concat_ws(":", "kind", "version"))).where("rank > 0 and size(spans) > 0")
        spans = F.explode("spans").alias("s")
        by_blob = current.select("blob_id", "kind", "rank", spans).groupBy("blob_id").agg(F.sort_array(F.collect_set(F.struct("s.start", "rank", "kind", "s.end"))).alias("spans"))
        return paths.join(by_blob, "blob_id", "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")))


def count_of(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def deliveries(docs: DataFrame, count: int = 2) -> list[DataFrame]:
    """The versions as ``count`` disjoint deliveries, dealt by doc_id; together they are all rows."""
    dealt = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(count))
    return [docs.where(dealt == i) for i in range(count)]


def report(docs: DataFrame, ledger: BlobLedger | None = None) -> DataFrame:
    """Scans the deliveries one after the other on one ledger, so that the later ones skip what it knows, and lists all paths."""
    ledger = ledger or BlobLedger(docs.sparkSession)
    paths = [ledger.scan(versions) for versions in deliveries(docs)]
    found = ledger.findings(reduce(DataFrame.unionByName, paths))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(
        F.col("path").alias("doc_id"), *[count_of(k).alias(f"n_{k}") for k in BASE],
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), F.lower(F.hex("blob_id")).alias("blob_id"),
    )
