"""Exact deduplication over an extendible-hash index kept in shared files.

1. Every map task combines copies it meets (same hash, same length, same bytes) and sends on one page per distinct
   text it holds, and one member row per document. A text the task has put out of its bounded memory is sent
   again; that costs a page, never a result.
2. Pages go, once, to the tasks that write the bucket files: ``<path>/generation=0/bucket=<hash prefix>``, sorted by hash. The number of
   bytes says how many bits the first directory has.
3. While a bucket holds more than ``bucket_bytes``, besides its largest chain, it splits by the next hash bits: its file is
   read and written as buckets of the next generation, and the directory doubles as often. The directory is kept in
   ``<path>/directory``: prefix, depth, generation, bytes, and whether one file holds the bucket.
4. Owner tasks read the buckets of the directory. A bucket is one row group of one file, so it has one owner, who holds the
   chain of one hash at a time: pages with equal hashes are compared by bytes. Buckets too large for a row group, by a
   long chain, are dealt by hash and chained in the same way.
5. Member rows learn their class through the page they belong to. A page stands for copies within one
   map task, so a group that holds a third of all rows still spreads over as many pages as tasks.
   ``deduplicate`` needs no members: a page carries the row that stays, and no text is joined.

Edge cases: null text counts as empty, and stays null in the row that stays; text that is not valid UTF-8 is compared by its bytes; repeated
rows are members like any other, and of rows equal in doc_id and text the first read stays; a null doc_id is
below every other; an empty table gives an empty result; very long texts pass whole; further columns, whatever their names,
are kept by ``deduplicate`` and ignored by ``classes``.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import bounded_batches, fresh_path, keys_of_rows, text_or_empty

BUCKET_BYTES = 32 << 20
#: A bucket up to twice ``BUCKET_BYTES`` is surely one row group of this size.
ROW_GROUP_BYTES = 128 << 20
#: A bucket is one file of one row group whatever the session says; a writer's options go before the session's settings.
ONE_FILE = {"maxRecordsPerFile": 0, "parquet.block.size": ROW_GROUP_BYTES, "parquet.block.row.count.limit": (1 << 31) - 1, "parquet.writer.max-padding": 0}
MOST_BITS = 24
#: Texts a map task keeps to recognise copies, in bytes.
COMBINE_BYTES = 48 << 20
LEAST = -(1 << 63)

INDEX = "doc_id long, uid long, rid long, text_sha256 string, hash long, n_bytes long, copies long, best long, text binary"
NAMES = [f.split()[0] for f in INDEX.split(", ")]
TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]


def combiner(budget: int, with_rows: bool):
    """Rows (doc_id, hash, text_sha256, text, row) to member rows and pages; with rows: to pages that carry the row that stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        serial = rid = TaskContext.get().partitionId() << 40
        held: OrderedDict[int, list] = OrderedDict()  # hash -> chain of [uid, hash, size, copies, best, bytes, rid of best, row]
        total, schema = 0, None

        def pages(found: list) -> pa.RecordBatch:
            uid, key, size, copies, best, text, first, row = zip(*found, strict=True)
            none = [None] * len(found)
            columns = [none, uid, first, none, key, size, copies, best, text, *([row] if with_rows else [])]
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            schema = schema or pa.schema([*zip(NAMES, TYPES, strict=True), *([("row", batch.schema.field(4).type)] if with_rows else [])])
            out, ids, keys = [], batch.column(0).to_pylist(), batch.column(1).to_pylist()
            others = batch.column(4).to_pylist() if with_rows else [None] * len(ids)
            beside = batch.column(4).nbytes // max(len(ids), 1) if with_rows else 0
            uids = np.empty(len(ids), np.int64)
            for at, (doc, key, text, row) in enumerate(zip(ids, keys, batch.column(3), others, strict=True)):
                body, chain = text.as_py(), held.setdefault(key, [])
                doc = LEAST if doc is None else doc
                for page in chain:
                    if page[5] == body:
                        page[3] += 1
                        if doc > page[4]:
                            page[4], page[6], page[7] = doc, rid + at, row
                        break
                else:
                    page = [serial, key, len(body) + beside, 1, doc, body, rid + at, row]
                    serial += 1
                    total += page[2] + 200
                    chain.append(page)
                held.move_to_end(key)
                uids[at] = page[0]
                while total > budget and len(held) > 1:
                    _, old = held.popitem(last=False)
                    out += old
                    total -= sum(p[2] + 200 for p in old)
            if not with_rows:
                none = pa.nulls(len(ids), pa.int64())
                yield pa.record_batch([batch.column(0), pa.array(uids), pa.array(np.arange(rid, rid + len(ids))), batch.column(2), none, none, none, none, pa.nulls(len(ids), pa.binary())], schema=schema)
            rid += len(ids)
            if out:
                yield pages(out)
        rest = [p for chain in held.values() for p in chain]
        for at in range(0, len(rest), 500):
            yield pages(rest[at : at + 500])

    return run


def prefix(bits: int) -> Column:
    """The first bits of the hash."""
    return F.shiftrightunsigned("hash", 64 - bits) if bits else F.lit(0).cast("long")


def write_buckets(pages: DataFrame, path: str, bits: int) -> None:
    """Pages to one file per bucket, sorted by hash; member rows (no hash) to bucket -1, spread over the tasks."""
    tasks = min(1 << bits, 1 << 15)
    dealt = pages.withColumn("bucket", F.when(F.col("hash").isNull(), -1).otherwise(prefix(bits)))
    spread = F.when(F.col("bucket") < 0, F.pmod(F.xxhash64("rid"), F.lit(max(tasks, 8)))).otherwise(-1)
    dealt = dealt.repartition(max(tasks, 8), "bucket", spread).sortWithinPartitions("bucket", "hash")
    dealt.write.partitionBy("bucket").options(**ONE_FILE).parquet(path)


def chainer(with_rows: bool):
    """Pages in hash order to (uid, keep_id, group_size, keep_rid) or the rows that stay: compares the bytes of pages with equal hashes."""
    verdict = pa.schema([("uid", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("keep_rid", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, chain, schema = None, [], verdict

        def closed() -> Iterator[tuple]:
            for body, uids, copies, best, rid, row in chain:
                if with_rows:
                    yield body, row
                else:
                    for uid in uids:
                        yield uid, None if best == LEAST else best, copies, rid

        def batch_of(out: list) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            if with_rows:
                schema = pa.schema([("text", pa.binary()), ("row", batch.schema.field(6).type)])
            out: list = []
            columns = [batch.column(i).to_pylist() for i in range(5)]
            rows = batch.column(6).to_pylist() if with_rows else [None] * batch.num_rows
            for uid, key, copies, best, rid, text, row in zip(*columns, batch.column(5), rows, strict=True):
                if key != current:
                    out += closed()
                    current, chain = key, []
                body = text.as_py()
                for entry in chain:
                    if entry[0] == body:
                        entry[1].append(uid)
                        entry[2] += copies
                        if (best, -rid) > (entry[3], -entry[4]):
                            entry[3:] = [best, rid, row]
                        break
                else:
                    chain.append([body, [uid], copies, best, rid, row])
            if out:
                yield batch_of(out)
        if chain:
            yield batch_of(list(closed()))

    return run


class Index:
    """Bucket files and directory of the pages at ``path``."""

    def __init__(self, pages: DataFrame, path: str, total: int, bucket_bytes: int):
        self.spark, self.path, self.schema, self.bucket_bytes = pages.sparkSession, path, pages.schema, bucket_bytes
        self.depths = [min(MOST_BITS, max(0, math.ceil(math.log2(max(total, 1) / (bucket_bytes / 2)))))]
        write_buckets(pages, f"{path}/generation=0", self.depths[0])
        self.split()

    def generation(self, g: int) -> DataFrame:
        return self.spark.read.schema(StructType([*self.schema.fields]).add("bucket", "long")).parquet(f"{self.path}/generation={g}")

    def split(self) -> None:
        """Splits overfull buckets, generation by generation, and writes the directory."""
        self.gone: list[list[int]] = []
        entries = []
        while True:
            g = len(self.gone)
            file = F.col("_metadata.file_path")
            by_hash = self.generation(g).where("bucket >= 0").groupBy("bucket", "hash").agg(F.sum(F.col("n_bytes") + 64).alias("load"), F.min(file).alias("low"), F.max(file).alias("high"))
            loads = by_hash.groupBy("bucket").agg(F.sum("load").alias("load"), F.max("load").alias("chain"), (F.min("low") == F.max("high")).alias("whole"))
            # Hashes fill the buckets of the first directory evenly, so that few are overfull.
            over = loads.where((F.col("load") > self.bucket_bytes) & (2 * (F.col("load") - F.col("chain")) > self.bucket_bytes)).collect()
            self.gone.append([r["bucket"] for r in over] if self.depths[g] < 64 else [])
            entry = loads.select(F.col("bucket").alias("prefix"), F.lit(self.depths[g]).alias("depth"), F.lit(g).alias("generation"), "load", "whole")
            entries.append(entry.where(~F.col("prefix").isin(self.gone[g])))
            if not self.gone[g]:
                break
            more = max(1, min(8, math.ceil(math.log2(max(r["load"] for r in over) / self.bucket_bytes))))
            self.depths.append(min(64, self.depths[g] + more))
            again = self.generation(g).where(F.col("bucket").isin(self.gone[g])).drop("bucket")
            write_buckets(again, f"{self.path}/generation={g + 1}", self.depths[-1])
        reduce(DataFrame.unionByName, entries).write.parquet(f"{self.path}/directory")

    def directory(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/directory")

    def owned(self, with_rows: bool, schema: str | StructType) -> DataFrame:
        """What the owners of all buckets decide."""
        columns = ["uid", "hash", "copies", "best", "rid", "text", *(["row"] if with_rows else [])]
        # Buckets that a chain makes larger than a row group, or that a writer put into several files: their chains are dealt by hash.
        long = self.directory().where((F.col("load") > 2 * self.bucket_bytes) | ~F.col("whole")).select("prefix", "generation").collect()
        out = []
        for g, gone in enumerate(self.gone):
            chains = [r["prefix"] for r in long if r["generation"] == g]
            live = self.generation(g).where((F.col("bucket") >= 0) & ~F.col("bucket").isin(gone))
            out.append(live.where(~F.col("bucket").isin(chains)).select(columns).mapInArrow(chainer(with_rows), schema))
            if chains:
                apart = live.where(F.col("bucket").isin(chains)).select(columns).repartition("hash").sortWithinPartitions("hash")
                out.append(apart.mapInArrow(chainer(with_rows), schema))
        return reduce(DataFrame.unionByName, out)


def keyed(docs: DataFrame, hash_bits: int) -> tuple[DataFrame, int]:
    """Rows (doc_id, hash, text_sha256, text), and their bytes."""
    body = text_or_empty()
    key = F.shiftleft(F.shiftright(F.xxhash64(body), 64 - hash_bits), 64 - hash_bits) if hash_bits < 64 else F.xxhash64(body)
    total = docs.agg(F.sum(F.octet_length(body) + 64)).first()[0] or 0
    return docs.select(F.col("doc_id").cast("long"), key.alias("hash"), F.sha2(body, 256).alias("text_sha256"), body.cast("binary").alias("text")), total


def classes(docs: DataFrame, path: str | None = None, hash_bits: int = 64, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id (largest doc_id of its copies), group_size, kept, text_sha256.

    ``path`` is where the index files go; ``hash_bits`` below 64 forces collisions (tests).
    """
    bounded_batches(docs.sparkSession)
    rows, total = keyed(docs, hash_bits)
    index = Index(rows.mapInArrow(combiner(COMBINE_BYTES, False), INDEX), path or fresh_path(docs.sparkSession, "dedup-index"), total, bucket_bytes)
    members = index.generation(0).where("bucket = -1").select("doc_id", "uid", "rid", "text_sha256")
    decided = index.owned(False, "uid long, keep_id long, group_size long, keep_rid long")
    kept = F.col("rid") == F.col("keep_rid")  # one row of a group, even where rows repeat
    return members.join(keys_of_rows(decided), "uid").select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, path: str | None = None, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The rows that stay, all columns kept: of equal texts the one with the largest doc_id, once if that row repeats."""
    bounded_batches(docs.sparkSession)
    others = [c for c in docs.columns if c != "text"]
    row = F.struct(F.col("text").isNull().alias("none"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(others)])
    _, total = keyed(docs, 64)
    rows = docs.select(*[F.col("doc_id").cast("long"), F.xxhash64(text_or_empty()).alias("hash"), F.lit("").alias("text_sha256"), text_or_empty().cast("binary").alias("text"), row.alias("row")])
    kind = rows.schema["row"].dataType
    pages = StructType(docs.sparkSession.createDataFrame([], INDEX).schema.fields).add("row", kind)
    index = Index(rows.mapInArrow(combiner(COMBINE_BYTES, True), pages), path or fresh_path(docs.sparkSession, "dedup-index"), total, bucket_bytes)
    stays = index.owned(True, StructType().add("text", "binary").add("row", kind))
    columns = {c: F.col("row")[f"c{i}"] for i, c in enumerate(others)} | {"text": F.when(~F.col("row.none"), F.col("text").cast("string"))}
    return stays.select(*[columns[c].alias(c) for c in docs.columns])
