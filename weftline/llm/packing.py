"""Best-two-fit packing of documents into sequences of at most ``capacity`` tokens.

Every document becomes one piece, a longer one several: all but the first are full. Full pieces are sequences of
their own. The others are dealt by hash into groups of some ``GROUP`` pieces, which are packed side by side; a
group leaves one sequence less than full for want of pieces, whatever its size. Within a group: open a sequence with
the longest piece, fill it greedily with the longest piece that fits, and when none fits, take out the smallest and
put in the two unpacked pieces that fit the larger gap most tightly, if together they are longer.

Edge cases: null text is empty and has one token, the end id; repeated rows are packed each for itself; a null
doc_id is kept; an empty table gives an empty result; very long texts are cut into as many pieces as it takes; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, staged, text_or_empty
from .tokens import encoded, gathered, give_back

CAPACITY = 2048
GROUP = 20_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cutter(path: str, capacity: int, end_id: int, with_ids: bool):
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema([*fields, *([("ids", pa.list_(pa.int32()))] if with_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, 1):
            docs, texts = batch.column(0).to_pylist(), batch.column(1)
            for first, each in encoded(texts, path, end_id):
                rows, cuts = [], []
                for doc, ids in zip(docs[first:], each, strict=False):
                    head = (len(ids) - 1) % capacity + 1
                    for piece, (a, b) in enumerate(zip([0, *range(head, len(ids), capacity)], [head, *range(head + capacity, len(ids) + 1, capacity)], strict=True)):
                        rows.append((doc, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())))
                        if with_ids:
                            cuts.append(ids[a:b].tolist())
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=False)]
                yield pa.record_batch([*columns, *([pa.array(cuts, schema.field(5).type)] if with_ids else [])], schema=schema)
        give_back()

    return run


def best_pair(lengths: list[int], counts: dict[int, int], room: int) -> tuple[int, int] | None:
    """Two pieces with the largest sum up to ``room``; ``lengths``: those present, ascending."""
    low, high, best, found = 0, bisect_right(lengths, room) - 1, 0, None
    while low <= high:
        a, b = lengths[low], lengths[high]
        if a + b > room or (low == high and counts[a] < 2):
            high -= 1
            continue
        if a + b > best:
            best, found = a + b, (a, b)
            if best == room:
                break
        low += 1
    return found


def best_two_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """For each piece its sequence and offset there."""
    held: dict[int, list[int]] = defaultdict(list)
    for i, n in enumerate(sizes):
        held[n].append(i)
    counts = {n: len(x) for n, x in held.items()}
    lengths = sorted(held)

    def take(n: int) -> int:
        counts[n] -= 1
        if not counts[n]:
            del lengths[bisect_right(lengths, n) - 1]
        return held[n].pop()

    def put(n: int, i: int) -> None:
        held[n].append(i)
        counts[n] += 1
        if counts[n] == 1:
            lengths.insert(bisect_right(lengths, n), n)

    sequence, offset, serial = [0] * len(sizes), [0] * len(sizes), 0
    while lengths:
        n = lengths[-1]
        inside, gap = [(n, take(n))], capacity - n
        while at := bisect_right(lengths, gap):
            n = lengths[at - 1]
            inside.append((n, take(n)))
            gap -= n
        if gap:
            least = min(inside)
            pair = best_pair(lengths, counts, gap + least[0])
            if pair and sum(pair) > least[0]:
                inside.remove(least)
                inside += [(n, take(n)) for n in pair]
                put(*least)
        at = 0
        for n, i in inside:
            sequence[i], offset[i] = serial, at
            at += n
        serial += 1
    return sequence, offset


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, group: int = GROUP, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    bounded_batches(docs.sparkSession)
    schema = PIECES + (", ids array<int>" if with_ids else "")
    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    pieces = rows.mapInArrow(cutter(tokenizer_path, capacity, end_id, with_ids), schema)
    pieces = staged(pieces.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    full = pieces.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.col("uid")).withColumn("offset", F.lit(0).cast("long"))
    short = pieces.where(F.col("length") < capacity)
    groups = max(1, -(-short.count() // group))

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "uid"], ascending=False, ignore_index=True)
        sequence, offset = best_two_fit(rows["length"].tolist(), capacity)
        base = int(rows["group"].iloc[0]) << 32
        return rows.drop(columns="group").assign(sequence_id=np.array(sequence, np.int64) + base, offset=np.array(offset, np.int64))

    narrow = short.select("uid", "doc_id", "piece", "length", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "uid"), F.lit(groups)).alias("group"))
    placed = narrow.groupBy("group").applyInPandas(packed, "uid long, doc_id long, piece int, length long, sequence_id long, offset long")
    placed = short.join(placed.select("uid", "sequence_id", "offset"), "uid")
    out = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else [])]
    return full.select(out).unionByName(placed.select(out))
