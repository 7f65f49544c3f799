"""Exact integer k-means with Elkan's bounds.

Vectors become integers (floor of ``scale`` times each component), so distances, sums and means are exact and runs agree
bit by bit however the rows are dealt out. The vectors lie in blocks, one row per block of some hundred, with what
Elkan's method caches for each of them: its cluster, an upper bound of the distance to that centroid and a lower bound
for every centroid. A round

1. moves the bounds by the distance that each centroid moved,
2. passes over vectors whose upper bound lies below half the distance to the next centroid, and centroids whose lower bound,
   or half whose distance to the own centroid, lies above the upper bound; only the rest is measured,
3. writes the blocks to the shared folder with the sums by which their vectors changed clusters; those sums are added up by
   Spark, and k centroids reach the driver.

Bounds are floats rounded outward: upper ones up, lower ones and halves down. A centroid is passed over only if a bound lies
strictly above, so a tie is always measured, and exact integers decide it for the smaller number.

Edge cases: a vector with another number of components, or with one that is null or not finite, or a null vector, is left out. Null
vec_ids take part but never start a centroid; repeated ids are vectors of their own, and where two of them start, the smaller components come first.
Fewer vectors than k give fewer centroids, no vectors an empty result. A component beyond 131072 (``LIMIT`` once scaled) raises
an error, as squared distances wouldn't fit a long. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh_path, staged

#: Vectors in a block at most.
BLOCK = 256
#: Largest scaled component: 64 squares of a difference of two such fit a long.
LIMIT = 1 << 27
STATE = "vec_ids array<bigint>, vectors binary, cluster binary, upper binary, lower binary, sums binary, measured bigint"


@dataclass
class Clustering:
    assigned: DataFrame  # vec_id, cluster, distance
    centroids: list[list[int]]
    inertia: list[int]  # by cluster
    measured: list[int]  # distances measured in each round


def usable(vectors: DataFrame, dims: int) -> DataFrame:
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where((F.size(x) == dims) & finite).select(F.col("vec_id").cast("bigint").alias("vec_id"), x.alias("embedding"))


def starts(vectors: DataFrame, k: int, scale: int, seed: str) -> list[list[int]]:
    """The k usable vectors with the smallest hashes of seed and vec_id."""
    hashed = vectors.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)).where("h is not null")
    return [[math.floor(scale * x) for x in r["embedding"]] for r in hashed.orderBy("h", "embedding").limit(k).collect()]


def down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


def up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    gap = a - b
    return np.einsum("...i,...i->...", gap, gap)


def half_gaps(centroids: np.ndarray) -> np.ndarray:
    """Half the distances of centroids, rounded down; none of a centroid to itself."""
    half = down(np.sqrt(squares(centroids[:, None], centroids[None]).astype(np.float64)) / 2)
    np.fill_diagonal(half, np.inf)
    return half


def reassign(vectors: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, half: np.ndarray) -> int:
    """Moves vectors to their nearest centroids and tightens the bounds, all in place; the number of distances measured."""
    rows = np.flatnonzero(upper >= half.min(1)[cluster])
    open_ = (lower[rows] <= upper[rows, None]) & (half[cluster[rows]] <= upper[rows, None])
    open_[np.arange(len(rows)), cluster[rows]] = False
    some = open_.any(1)
    rows, open_ = rows[some], open_[some]
    own = cluster[rows]
    best = squares(vectors[rows], centroids[own])
    root = np.sqrt(best.astype(np.float64))
    bound, lower[rows, own] = up(root), down(root)
    measured = len(rows)
    for c in range(len(centroids)):
        hit = np.flatnonzero(open_[:, c] & (lower[rows, c] <= bound) & (half[own, c] <= bound) & (own != c))
        found = squares(vectors[rows[hit]], centroids[c])
        lower[rows[hit], c] = down(np.sqrt(found.astype(np.float64)))
        nearer = (found < best[hit]) | ((found == best[hit]) & (c < own[hit]))
        moved = hit[nearer]
        best[moved], own[moved] = found[nearer], c
        bound[moved] = up(np.sqrt(best[moved].astype(np.float64)))
        measured += len(hit)
    cluster[rows], upper[rows] = own, bound
    return measured


def record(values: list, batch_schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*values, strict=True), batch_schema, strict=True)], schema=batch_schema)


ARROW = pa.schema([("vec_ids", pa.list_(pa.int64())), *[(n, pa.binary()) for n in ("vectors", "cluster", "upper", "lower", "sums")], ("measured", pa.int64())])


def blocks(vectors: DataFrame, k: int, dims: int, scale: int) -> DataFrame:
    """Blocks of integer vectors, in no cluster yet and without bounds."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.floor(scale * batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))
            if np.abs(x).max(initial=0) > LIMIT:
                raise ValueError(f"a component beyond {LIMIT / scale:g} has no exact distance in a long")
            for at in range(0, len(x), BLOCK):
                part = x[at : at + BLOCK].astype(np.int32)
                n = len(part)
                none = np.full(n, -1, np.int32), np.full(n, np.inf, np.float32), np.zeros((n, k), np.float32)
                yield record([[batch.column("vec_id").slice(at, BLOCK).to_pylist(), part.tobytes(), *[a.tobytes() for a in none], b"", 0]], ARROW)

    return vectors.mapInArrow(build, STATE)


def moved_blocks(state: DataFrame, before: list[list[int]] | None, now: list[list[int]], dims: int) -> DataFrame:
    """One round over all blocks: bounds move, vectors are assigned, sums tell what that changed."""
    k = len(now)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = np.array(now, np.int64)
        half = half_gaps(centroids)
        drift = np.zeros(k) if before is None else up(np.sqrt(squares(np.array(before, np.int64), centroids).astype(np.float64))).astype(np.float64)
        drift[(centroids == np.array(before or now, np.int64)).all(1)] = 0
        for batch in batches:
            columns = [batch.column(n) for n in ("vectors", "cluster", "upper", "lower")]
            for i in range(batch.num_rows):
                raw = [c[i].as_py() for c in columns]
                vectors = np.frombuffer(raw[0], np.int32).reshape(-1, dims).astype(np.int64)
                old = np.frombuffer(raw[1], np.int32)
                cluster = np.maximum(old, 0)
                upper = up(np.frombuffer(raw[2], np.float32) + drift[cluster])
                lower = np.maximum(down(np.frombuffer(raw[3], np.float32).reshape(-1, k) - drift), 0)
                measured = reassign(vectors, cluster, upper, lower, centroids, half)
                change = (cluster[None] == np.arange(k)[:, None]).astype(np.int64) - (old[None] == np.arange(k)[:, None])
                sums = np.column_stack([change @ vectors, change.sum(1)])
                yield record([[batch.column("vec_ids")[i].as_py(), raw[0], cluster.astype(np.int32).tobytes(), upper.tobytes(), lower.tobytes(), sums.tobytes(), measured]], ARROW)

    return state.mapInArrow(work, STATE)


def changes(state: DataFrame, k: int, dims: int) -> tuple[np.ndarray, int]:
    """By centroid the sums of components and the count by which a round changed it, in Python integers; distances measured."""
    schema = pa.schema([("slot", pa.int64()), ("value", pa.int64())])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * (dims + 1) + 1, np.int64)
        for batch in batches:
            for raw in batch.column("sums"):
                total[:-1] += np.frombuffer(raw.as_py(), np.int64)
            total[-1] += sum(batch.column("measured").to_pylist())
        yield pa.record_batch([pa.array(np.arange(len(total))), pa.array(total)], schema=schema)

    added = state.select("sums", "measured").mapInArrow(partial, "slot bigint, value bigint").groupBy("slot").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    out = {r["slot"]: int(r["value"]) for r in added.collect()}
    flat = [out.get(i, 0) for i in range(k * (dims + 1))]
    return np.array(flat, object).reshape(k, dims + 1), out.get(k * (dims + 1), 0)


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: str = "3") -> Clustering:
    """``rounds`` of assigning and replacing centroids, then a last assignment. ``vectors``: vec_id, embedding."""
    spark = vectors.sparkSession
    kept = usable(vectors, dims)
    now, before = starts(kept, k, scale, seed), None
    k = len(now)
    rows = "vec_id bigint, cluster int, distance bigint"
    if not k:
        return Clustering(spark.createDataFrame([], rows), [], [], [])
    path = fresh_path(spark, "vector-blocks")
    state = staged(blocks(kept, k, dims, scale), "", path)
    totals, measured = np.zeros((k, dims + 1), object), []
    for last in [False] * rounds + [True]:
        after = fresh_path(spark, "vector-blocks")
        state = staged(moved_blocks(state, before, now, dims), "", after)
        discard(spark, path)
        path = after
        change, count = changes(state, k, dims)
        totals, before = totals + change, now
        measured.append(count)
        if not last:
            now = [[s // t[-1] for s in t[:-1]] if t[-1] else own for t, own in zip(totals.tolist(), now, strict=True)]
    final = now

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = np.array(final, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                own = np.frombuffer(batch.column("cluster")[i].as_py(), np.int32)
                x = np.frombuffer(batch.column("vectors")[i].as_py(), np.int32).reshape(-1, dims).astype(np.int64)
                yield pa.record_batch([batch.column("vec_ids")[i].values, pa.array(own), pa.array(squares(x, centroids[own]))], ["vec_id", "cluster", "distance"])

    assigned = staged(state.select("vec_ids", "cluster", "vectors").mapInArrow(distances, rows), "vector-clusters")
    discard(spark, path)
    sums = {r["cluster"]: int(r["d"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    return Clustering(assigned, final, [sums.get(c, 0) for c in range(k)], measured)


def cluster_report(vectors: DataFrame, k: int = 8, rounds: int = 10) -> DataFrame:
    """Per vector its cluster and squared distance, the sums of distances, and the hash of its centroid."""
    found = cluster(vectors, k, rounds)
    by = lambda values, kind: F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster")) if values else F.lit(None).cast(kind)
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids]
    return found.assigned.select("vec_id", "cluster", "distance", by(found.inertia, "bigint").alias("cluster_inertia"), F.lit(sum(found.inertia)).cast("bigint").alias("inertia"), by(hashes, "string").alias("centroid_sha256"))
