"""Periodic runs of words by a harmonic grid of prefix hashes.

A run is a stretch of consecutive words with smallest period q and length of at least 2 * q (and ``least``) that no neighbouring
word extends. Whatever its place, a run of period p holds two neighbouring multiples of p, so for every period p only
the pairs (i, i + p) at the multiples i of p are looked at: n/1 + n/2 + ... = some n * ln(n) pairs of a text of n words.

1. Words become numbers; prefix sums of numbers times powers, modulo two primes, give the hash of any stretch.
2. For all pairs of equal words at once (NumPy), binary searches over lengths find how far both places agree forward and
   backward. What agrees over a period or more is a candidate.
3. Candidates with one start and end are one run, of their least period. Every run is verified on the words. Should a hash have
   been mistaken (a run that fails, or periods of one stretch that are no multiples), the texts are done again with other powers.

Texts of a batch are worked on together; pairs are taken in portions of ``PAIRS``, so memory is bounded by the longest text alone. No
rows are shuffled: every text is a task's own work.

``without_repeats`` drops, of every run, the words after its first period.

Edge cases: null text has no words, no runs and an empty result text; repeated rows give repeated results; very long texts are searched
whole; an empty table gives an empty result. ``find_runs`` keeps the columns named in ``keep`` and ignores the others.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import bounded_batches, unused
from .words import coded, grouped, within

LEAST = 12
#: Pairs of places that are searched at a time; the pairs of one period of one text stay together.
PAIRS = 1_000_000
PRIMES = (2_147_483_647, 2_147_483_629)
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


class Hashes:
    """Prefix hashes of a row of numbers."""

    def __init__(self, codes: np.ndarray, seed: int):
        rng = np.random.default_rng(seed)
        n, kinds = len(codes), int(codes.max(initial=-1)) + 1
        self.tables = []
        for p in PRIMES:
            prime, base = np.uint64(p), np.uint64(rng.integers(1 << 20, p - 1))
            power = np.ones(n + 1, np.uint64)
            done = 1
            step = base
            while done <= n:
                more = min(done, n + 1 - done)
                power[done : done + more] = power[:more] * step % prime
                done, step = done + more, step * step % prime
            values = rng.integers(1, p, kinds, dtype=np.int64).astype(np.uint64)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(values[codes] * power[:-1] % prime, out=sums[1:])
            self.tables.append((prime, power, sums % prime))

    def equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the stretches from a and from b >= a agree over the lengths."""
        out = np.ones(len(a), bool)
        for prime, power, sums in self.tables:
            left = (sums[a + length] + prime - sums[a]) % prime * power[b - a] % prime
            out &= left == (sums[b + length] + prime - sums[b]) % prime
        return out

    def agreed(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """Longest length, up to ``most``, over which a and b agree, forward from both or backward before both."""
        low, high = np.zeros_like(a), most.copy()
        live = np.arange(len(a))
        while len(live := live[low[live] < high[live]]):
            middle = (low[live] + high[live] + 1) // 2
            shift = middle if back else 0
            same = self.equal(a[live] - shift, b[live] - shift, middle)
            low[live[same]] = middle[same]
            high[live[~same]] = middle[~same] - 1
        return low


def candidates(codes: np.ndarray, bounds: np.ndarray, hashes: Hashes, least: int) -> np.ndarray:
    """Distinct (start, end, period), in this order, of stretches that agree with themselves a period on."""
    sizes = np.diff(bounds)
    text = np.repeat(np.arange(len(sizes)), sizes // 2)
    period = within(sizes // 2) + 1
    points = (sizes[text] - 1) // period
    ends = np.cumsum(points)
    found, at = [np.zeros((0, 3), np.int64)], 0
    while at < len(period):
        past = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        n, p, first, last = (np.repeat(x, points[at:past]) for x in (points[at:past], period[at:past], bounds[text[at:past]], bounds[text[at:past] + 1]))
        a = first + within(points[at:past]) * p
        at = past
        same = codes[a] == codes[a + p]
        # A run of 3 words or more has 2 equal pairs at least, so one of the neighbouring pairs is equal too.
        near = codes[np.minimum(a + 1, last - 1)] == codes[np.minimum(a + p + 1, last - 1)]
        near |= (a > first) & (codes[np.maximum(a - 1, 0)] == codes[np.maximum(a + p - 1, 0)])
        keep = same & near
        a, p, first, last = a[keep], p[keep], first[keep], last[keep]
        forth = hashes.agreed(a, a + p, last - a - p, False)
        back = hashes.agreed(a, a + p, a - first, True)
        length = back + p + forth
        long = (length >= 2 * p) & (length >= least)
        found.append(np.unique(np.column_stack([a - back, a + p + forth, p])[long], axis=0))
    return np.unique(np.concatenate(found), axis=0)


def runs_of(codes: np.ndarray, bounds: np.ndarray, least: int = LEAST, seeds: Iterator[int] | None = None) -> np.ndarray:
    """All runs (start, end, period) of texts on end, verified; places count over all texts."""
    if least < 3:
        raise ValueError("runs have 3 words at least")
    for seed in seeds or count():
        found = candidates(codes, bounds, Hashes(codes, seed), least)
        first = np.ones(len(found), bool)
        first[1:] = (found[1:, :2] != found[:-1, :2]).any(1)
        runs = found[first]
        own = runs[np.cumsum(first) - 1, 2]
        if (found[:, 2] % own == 0).all() and all(np.array_equal(codes[s : e - q], codes[s + q : e]) for s, e, q in runs.tolist()):
            return runs
    raise AssertionError("unreachable: seeds don't end")


def find_runs(docs: DataFrame, keep: Sequence[str], text: str = "text", least: int = LEAST) -> DataFrame:
    """The columns ``keep``, then n_words, runs (all of them by start and period) and collapsed: the text without repeated periods, its words joined by a space.

    The three get underscores before their names where ``keep`` has such columns.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(*keep)
    body, *names = (unused(rows, n) for n in ("text", "n_words", "runs", "collapsed"))
    added = StructType([StructField(n, t) for n, t in zip(names, (LongType(), StructType.fromDDL(f"r {RUNS}")[0].dataType, StringType()), strict=True)])
    schema = StructType([*rows.schema.fields, *added.fields])
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            for at, texts in grouped(batch.column(batch.num_columns - 1)):
                codes, _, bounds = coded(texts)
                runs = runs_of(codes, bounds, least)
                dropped = np.zeros(len(codes) + 1, np.int64)
                np.add.at(dropped, runs[:, 0] + runs[:, 2], 1)
                np.add.at(dropped, runs[:, 1], -1)
                stays = np.cumsum(dropped[:-1]) == 0
                owner = np.searchsorted(bounds, runs[:, 0], "right") - 1
                listed: list[list] = [[] for _ in texts]
                for i, (s, e, q) in sorted(zip(owner.tolist(), runs.tolist(), strict=True), key=lambda x: (x[1][0], x[1][2])):
                    listed[i].append({"start": s - int(bounds[i]), "length": e - s, "period": q})
                out = [b" ".join(w for w, s in zip(t, stays[bounds[i] : bounds[i + 1]].tolist(), strict=True) if s) if listed[i] else b" ".join(t) for i, t in enumerate(texts)]
                made = [pa.array([len(t) for t in texts], pa.int64()), pa.array(listed, run_type), pa.array([x.decode() for x in out], pa.string())]
                yield pa.record_batch([*[c.slice(at, len(texts)) for c in kept], *made], schema.names)

    return docs.select(*keep, F.col(text).alias(body)).mapInArrow(search, schema)


def without_repeats(docs: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """``docs`` with the text that is left once every run keeps its first period alone; null texts stay null, texts without runs as they are."""
    found = find_runs(docs, docs.columns, text, least)
    added = found.columns[-3:]
    short = F.when(F.size(found[added[1]]) > 0, found[added[2]]).otherwise(F.col(text))
    return found.withColumn(text, short).select(docs.columns)


def run_digests(found: DataFrame) -> DataFrame:
    """doc_id, number of runs, the greatest run, and hashes of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    longest = F.struct((-best["col2"]).alias("start"), best["length"].alias("length"), (-best["col3"]).alias("period"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    text = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    shown = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), longest.alias("r"), F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    exponent = F.floor(1000 * F.col("r.length") / F.col("r.period"))
    return shown.select("doc_id", "n_runs", "r.start", "r.length", "r.period", exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
