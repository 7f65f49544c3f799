"""Sharding by histogram sort: splitters from exact byte counts, then one exchange.

Rows are ordered by (64-bit hash of the text, doc_id, size). Probes are candidate key boundaries; a round
counts, over all partitions, the exact bytes and rows between neighbouring probes (one row per gap
reaches the driver). Wherever a splitter is not yet within tolerance, the next round puts new probes
into its gap. A gap that holds a single key cannot be parted further. When every splitter is within
tolerance, or can't be improved, each row gets its part by binary search and moves once.

The law is ``bytes``: shards have near-equal sums of sizes. Equal texts are neighbours in the order, so
a group of copies stays together unless a shard boundary falls into it; then doc_id parts it.

A shard consists of many parts (``part_rows`` at most, near enough); a row's slot is the exact number of
rows in earlier parts of its shard plus its rank in its own part, so no task holds a shard.

Edge cases: null text has size 8 and the checksum of no bytes; null doc_ids sort first; rows equal in
every key column fall into one part and take their slots in any order, which leaves their shard and the
set of slots the same; an empty table gives an empty result. Other columns are kept by ``shard_rows``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, text_or_empty

KEYS = ("k1", "k2", "k3")


def search(batch: pa.RecordBatch, probes: np.ndarray) -> np.ndarray:
    """For every row the number of probes at or below its key; probes and keys are lexicographic triples."""
    keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
    low = np.searchsorted(probes[:, 0], keys[0], "left")
    high = np.searchsorted(probes[:, 0], keys[0], "right")
    # Rows that tie with probes on the first key only: settle them one tied probe at a time.
    at = low.copy()
    open_rows = np.flatnonzero(high > low)
    while len(open_rows):
        probe = probes[at[open_rows]]
        below = (probe[:, 1] < keys[1][open_rows]) | ((probe[:, 1] == keys[1][open_rows]) & (probe[:, 2] <= keys[2][open_rows]))
        at[open_rows[below]] += 1
        open_rows = open_rows[below]
        open_rows = open_rows[at[open_rows] < high[open_rows]]
    return at


def gap_counter(probes: np.ndarray):
    schema = pa.schema([("gap", pa.int64()), ("n", pa.int64()), ("bytes", pa.int64()), *[(f"{m}{k}", pa.int64()) for m in ("lo", "hi") for k in KEYS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            gap = search(batch, probes)
            order = np.lexsort((keys[2], keys[1], keys[0], gap))
            starts = np.flatnonzero(np.r_[True, np.diff(gap[order]) != 0])
            ends = np.r_[starts[1:], len(order)] - 1
            size = batch.column(3).to_numpy(zero_copy_only=False)[order]
            low, high = keys[:, order[starts]], keys[:, order[ends]]
            columns = [gap[order[starts]], np.diff(np.r_[starts, len(order)]), np.add.reduceat(size, starts), *low, *high]
            yield pa.record_batch([pa.array(c.astype(np.int64)) for c in columns], schema=schema)

    return run


def count_gaps(keyed: DataFrame, probes: np.ndarray) -> list:
    """Per gap: rows, bytes, least and greatest key. At most one row per gap reaches the driver."""
    schema = "gap long, n long, bytes long, " + ", ".join(f"{m}{k} long" for m in ("lo", "hi") for k in KEYS)
    partial = keyed.select(*KEYS, "size").mapInArrow(gap_counter(probes), schema)
    low, high = F.min(F.struct(*[f"lo{k}" for k in KEYS])), F.max(F.struct(*[f"hi{k}" for k in KEYS]))
    return partial.groupBy("gap").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), low.alias("low"), high.alias("high")).collect()


def between(low: tuple, high: tuple, n: int, fractions: list[float]) -> list[tuple]:
    """Probe keys inside (low, high]: even over the first key component in which the two differ, and near where the splitters are expected."""
    for i in range(3):
        if low[i] != high[i]:
            span = high[i] - low[i]
            near = [f + d * w for f in fractions for w in (0.002, 0.01, 0.05) for d in (-1, 1)] + fractions
            at = {min(high[i], max(low[i] + 1, low[i] + round(span * x))) for x in [*[j / (n + 1) for j in range(1, n + 1)], *near]}
            return [(*low[:i], v, *[-(1 << 63)] * (2 - i)) for v in sorted(at)]
    return []


def splitters(keyed: DataFrame, shards: int, tolerance: float = 0.002, part_rows: int = 250_000, rounds: int = 40) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Probe keys that bound the parts, and for each part (shard, first slot)."""
    probes = np.zeros((0, 3), np.int64)
    while True:
        gaps = {r["gap"]: r for r in count_gaps(keyed, probes)}
        total, rows = sum(r["bytes"] for r in gaps.values()), sum(r["n"] for r in gaps.values())
        ends = np.cumsum([gaps[g]["bytes"] if g in gaps else 0 for g in range(len(probes) + 1)])
        fresh: set[tuple] = set()
        slack = tolerance * total / shards
        wanted: dict[int, list[float]] = {}
        for s in range(1, shards):
            goal = total * s / shards
            gap = int(np.searchsorted(ends, goal, "left"))
            below = ends[gap] - (gaps[gap]["bytes"] if gap in gaps else 0)
            if gap in gaps and min(goal - below, ends[gap] - goal) > slack:
                wanted.setdefault(gap, []).append(float((goal - below) / gaps[gap]["bytes"]))
        for gap, r in gaps.items():
            if r["n"] > part_rows:
                wanted.setdefault(gap, [])
        for gap, fractions in wanted.items():
            r = gaps[gap]
            share = max(4, min(512, int(2 * r["n"] / part_rows) + 8 * (len(fractions) > 0)))
            fresh |= set(between(tuple(r["low"]), tuple(r["high"]), share, fractions))
        fresh -= {tuple(p) for p in probes.tolist()}
        rounds -= 1
        if not fresh or not rows or not rounds:
            break
        probes = np.array(sorted({tuple(p) for p in probes.tolist()} | fresh), np.int64).reshape(-1, 3)
    starts = np.r_[0, ends[:-1]] if len(ends) else np.zeros(1)
    # A part belongs to the shard whose span holds its middle byte; bounds lie within tolerance of the ideal ones.
    middles = (starts + ends) / 2
    shard = np.minimum(shards - 1, (middles * shards // max(total, 1)).astype(int))
    counts, slot, parts = [gaps[g]["n"] if g in gaps else 0 for g in range(len(probes) + 1)], {}, []
    for s, n in zip(shard.tolist(), counts, strict=True):
        parts.append((s, slot.get(s, 0)))
        slot[s] = slot.get(s, 0) + n
    return probes, parts


def part_finder(probes: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(search(batch, probes).astype(np.int32))], [*batch.schema.names, "part"])

    return run


def assign_shards(docs: DataFrame, shards: int = 24, tolerance: float = 0.002, part_rows: int = 250_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row."""
    spark = docs.sparkSession
    body = text_or_empty()
    size = (F.octet_length(body) + 8).cast("long")
    keyed = docs.select(F.xxhash64(body).alias("k1"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("k2"), size.alias("k3"), size.alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.col("doc_id"))
    keyed = staged(keyed, "shard-keys")
    probes, parts = splitters(keyed, shards, tolerance, part_rows)
    columns = "k1 long, k2 long, k3 long, size long, text_crc32 long, doc_id long, part int"
    placed = keyed.mapInArrow(part_finder(probes), columns)
    # One entry per part; parts hold part_rows rows, so at 10^10 rows there are some 10^5 of them.
    bounds = spark.createDataFrame([(i, s, f) for i, (s, f) in enumerate(parts)], "part int, shard int, first long")
    ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy(*KEYS)))
    return ranked.join(bounds, "part").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
