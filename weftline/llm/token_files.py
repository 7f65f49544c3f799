"""Token ids in files: canonical length-limited Huffman codes, blocks with bit-offset checkpoints.

Writing: texts are encoded once into a staging table, together with counts of ids per task. The global counts (one
row per id of the vocabulary) give code lengths by package-merge, at most ``MAX_BITS``; codes are canonical, so a file
set needs the lengths alone. Documents are dealt by ranges of doc_id and sorted; each task codes its documents into
blocks of about ``BLOCK_TOKENS`` ids, whole documents each.

Files (Parquet, so that any store Spark reads can hold them, and commits are atomic):
  ``<path>/codebook``  id int, length int, ids that occur
  ``<path>/blocks``    part int, block int (both ascending with doc_id), first long (ids before the block in its
                       part), doc_ids array<long>, n_tokens array<int>, checkpoints array<int> (bit offset of every
                       ``STRIDE``-th id), payload binary (bits from the high end of big-endian 32-bit words)

Reading: a table of 2 ** MAX_BITS entries gives id and length; all checkpoints of a batch are decoded in step. Any
block, and any stride of it, decodes without the ones before.

Edge cases: null text is empty and has the end id alone; a null doc_id comes first; rows with equal doc_ids are
ordered by their ids' bytes; an empty table gives an empty result; a corpus with one distinct id uses 1-bit codes; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, fresh_path, staged, text_or_empty
from .tokens import encoded, gathered

MAX_BITS = 18
BLOCK_TOKENS = 65_536
STRIDE = 512
STAGE = "doc_id long, ids binary, id int, n long"
BLOCKS = "part int, block int, first long, doc_ids array<long>, n_tokens array<int>, checkpoints array<int>, payload binary"


def ids_stager(path: str, end_id: int):
    """Per document its packed ids; at the end of a task a row per id with its count."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("id", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, press = np.zeros(1 << 16, np.int64), zstandard.ZstdCompressor(level=1)
        for batch in gathered(batches, 1):
            docs, texts = batch.column(0), batch.column(1)
            for first, each in encoded(texts, path, end_id):
                whole = np.concatenate(each)
                if len(whole):
                    here = np.bincount(whole)
                    if len(here) > len(counts):
                        counts = np.r_[counts, np.zeros(len(here) - len(counts), np.int64)]
                    counts[: len(here)] += here
                packed = [press.compress(pack_ids(ids)) for ids in each]
                none = len(each)
                yield pa.record_batch([docs.slice(first, len(each)), pa.array(packed, pa.binary()), pa.nulls(none, pa.int32()), pa.nulls(none, pa.int64())], schema=schema)
        used = np.flatnonzero(counts)
        if len(used):
            yield pa.record_batch([pa.nulls(len(used), pa.int64()), pa.nulls(len(used), pa.binary()), pa.array(used.astype(np.int32)), pa.array(counts[used])], schema=schema)

    return run


def pack_ids(ids: np.ndarray) -> bytes:
    """A byte for the width, then the ids."""
    return b"\x02" + ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 1 << 16 else b"\x04" + ids.astype("<u4").tobytes()


def unpack_ids(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u2" if data[0] == 2 else "<u4", offset=1)


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal prefix-code lengths up to ``limit`` for positive counts, by package-merge."""
    n = len(counts)
    if n < 2:
        return np.ones(n, np.int64)
    if n > 1 << limit:
        raise ValueError("more ids than codes of that length")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.int64)
    levels, row = [np.ones(n, bool)], leaves
    for _ in range(limit - 1):
        even = len(row) // 2 * 2
        packages = row[0:even:2] + row[1:even:2]
        both = np.r_[leaves, packages]
        sort = np.argsort(both, kind="stable")
        row = both[sort]
        levels.append(sort < n)
    lengths, need = np.zeros(n, np.int64), 2 * n - 2
    for is_leaf in reversed(levels):
        taken = int(is_leaf[:need].sum())
        lengths[order[:taken]] += 1
        need = 2 * (need - taken)
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, position)."""
    codes, code, last = np.zeros(len(lengths), np.uint64), 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    for at in order.tolist():
        code <<= int(lengths[at]) - last
        last = int(lengths[at])
        codes[at] = code
        code += 1
    return codes


def put_bits(codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Codes one after the other; and the bit offset of each. Bits of different codes don't overlap, so sums are unions."""
    ends = np.cumsum(lengths)
    at = ends - lengths
    word, shift = at >> 5, (64 - (at & 31) - lengths).astype(np.uint64)
    bits = codes << shift
    size = int(ends[-1] // 32 + 2) if len(ends) else 0
    high = np.bincount(word, (bits >> np.uint64(32)).astype(np.float64), size)
    low = np.bincount(word + 1, (bits & np.uint64(0xFFFFFFFF)).astype(np.float64), size)
    return (high + low).astype(">u4").tobytes(), at


class Decoder:
    """Table-driven: the next ``MAX_BITS`` bits give id and length."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        codes = canonical(lengths).astype(np.int64)
        self.ids, self.lengths = np.zeros(1 << MAX_BITS, np.uint32), np.ones(1 << MAX_BITS, np.int64)
        order = np.argsort(codes << (MAX_BITS - lengths), kind="stable")
        spans = (1 << (MAX_BITS - lengths))[order]
        used = int(spans.sum())
        self.ids[:used] = np.repeat(ids[order], spans)
        self.lengths[:used] = np.repeat(lengths[order], spans)

    def decode(self, payloads: list[bytes], checkpoints: list[np.ndarray], sizes: list[int]) -> list[np.ndarray]:
        """Ids of several blocks, all strides in step."""
        words = np.frombuffer(b"".join([*payloads, b"\0" * (4 * STRIDE * MAX_BITS // 32 + 64)]), ">u4").astype(np.uint64)
        pairs = (words[:-1] << np.uint64(32)) | words[1:]
        base = np.cumsum([0, *[len(p) for p in payloads[:-1]]]) * 8
        at = np.concatenate([c.astype(np.int64) + b for c, b in zip(checkpoints, base, strict=True)])
        out = np.empty((STRIDE, len(at)), np.uint32)
        mask = np.uint64((1 << MAX_BITS) - 1)
        for step in range(STRIDE):
            ahead = (pairs[at >> 5] >> (64 - MAX_BITS - (at & 31)).astype(np.uint64)) & mask
            ahead = ahead.astype(np.int64)
            out[step] = self.ids[ahead]
            at += self.lengths[ahead]
            np.minimum(at, (len(pairs) - 1) << 5, out=at)
        flat, first, found = out.T.reshape(-1), 0, []
        for c, n in zip(checkpoints, sizes, strict=True):
            found.append(flat[first : first + n])
            first += len(c) * STRIDE
        return found


def block_writer(ids: np.ndarray, lengths: np.ndarray):
    """Documents in order (doc_id, staged ids) to blocks."""
    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int32())), ("checkpoints", pa.list_(pa.int32())), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        size = int(ids.max()) + 1 if len(ids) else 0
        code, length = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        code[ids], length[ids] = canonical(lengths), lengths
        part, block, first, open_docs, tokens = TaskContext.get().partitionId(), 0, 0, [], 0
        unpress = zstandard.ZstdDecompressor()

        def closed() -> pa.RecordBatch:
            whole = np.concatenate([i for _, i in open_docs])
            payload, at = put_bits(code[whole], length[whole])
            row = [[part], [block], [first], [[d for d, _ in open_docs]], [[len(i) for _, i in open_docs]], [at[::STRIDE].tolist()], [payload]]
            return pa.record_batch([pa.array(v, f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                open_docs.append((doc, unpack_ids(unpress.decompress(data)).astype(np.int64)))
                tokens += len(open_docs[-1][1])
                if tokens >= BLOCK_TOKENS:
                    yield closed()
                    block, first, open_docs, tokens = block + 1, first + tokens, [], 0
        if open_docs:
            yield closed()

    return run


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2) -> None:
    spark = docs.sparkSession
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    stage = staged(rows.mapInArrow(ids_stager(tokenizer_path, end_id), STAGE), "token-ids")
    # One row per id of the vocabulary reaches the driver.
    counts = stage.where("id is not null").groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").toPandas()
    ids = counts["id"].to_numpy(np.int64)
    lengths = code_lengths(counts["n"].to_numpy(np.int64), MAX_BITS)
    book = spark.createDataFrame(list(zip(ids.tolist(), lengths.tolist(), strict=True)), "id int, length int")
    book.coalesce(1).write.mode("overwrite").parquet(f"{path}/codebook")
    ranged = stage.where("ids is not null").select("doc_id", "ids").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    ranged.mapInArrow(block_writer(ids, lengths), BLOCKS).write.mode("overwrite").option("compression", "none").parquet(f"{path}/blocks")


def block_reader(ids: np.ndarray, lengths: np.ndarray, with_ids: bool):
    fields = [("part", pa.int32()), ("doc_id", pa.int64()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema([*fields, *([("ids", pa.list_(pa.int32()))] if with_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = None
        for batch in batches:
            tool = tool or Decoder(ids, lengths)
            at = 0
            while at < batch.num_rows:
                some = batch.slice(at, 24)
                at += 24
                columns = {n: some.column(i).to_pylist() for i, n in enumerate(some.schema.names)}
                sizes = [sum(n) for n in columns["n_tokens"]]
                decoded = tool.decode(columns["payload"], [np.array(c, np.int64) for c in columns["checkpoints"]], sizes)
                out, cuts = [], []
                for part, first, docs, each, block in zip(columns["part"], columns["first"], columns["doc_ids"], columns["n_tokens"], decoded, strict=True):
                    a = 0
                    for doc, n in zip(docs, each, strict=True):
                        own = np.ascontiguousarray(block[a : a + n], "<u4")
                        out.append((part, doc, first + a, n, zlib.crc32(own.tobytes())))
                        if with_ids:
                            cuts.append(own.tolist())
                        a += n
                arrays = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=False)]
                yield pa.record_batch([*arrays, *([pa.array(cuts, schema.field(5).type)] if with_ids else [])], schema=schema)

    return run


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 (and ids)."""
    book = spark.read.schema("id int, length int").parquet(f"{path}/codebook").orderBy("id").toPandas()
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    schema = "part int, doc_id long, before long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    columns = blocks.select("part", "first", "doc_ids", "n_tokens", "checkpoints", "payload")
    docs = columns.mapInArrow(block_reader(book["id"].to_numpy(np.int64), book["length"].to_numpy(np.int64), with_ids), schema)
    held = blocks.select("part", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, n: a + n).alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    # One row per file part.
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = held.select("part", before.alias("base"))
    out = docs.join(starts, "part").withColumn("start", F.col("base") + F.col("before"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def round_trip(docs: DataFrame, tokenizer_path: str, path: str | None = None, end_id: int = 2) -> DataFrame:
    path = path or fresh_path(docs.sparkSession, "token-files")
    write_ids(docs, path, tokenizer_path, end_id)
    return read_ids(docs.sparkSession, path)
