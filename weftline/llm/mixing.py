"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Targets: sources in code-point order (null last) weigh 1, 2, 3 and again; together they get as many words
as the corpus has. A target stops at ``cap`` times its source's words; the excess is shared again by weight
until none is above.

Drawing: in every pass a source's documents are permuted anew by a seeded hash and fall, in that order, into blocks of
nearly equal words. A target of e whole passes and a rest takes every block of e permutations, then blocks of one more
permutation until the rest is met; in the last block and a few after it documents are
taken in permuted order as far as they fit, and one more document, of all that are left, closes what is missing if that brings the sum nearer. Whole documents only.

Output shards: the exact block quotas of all sources are split in two at every node of a binary tree by a
multivariate hypergeometric draw; a leaf's quota says which run of each source's permuted blocks its shard
gets. Runs are disjoint and cover every drawn block. The driver draws the tree down to subtrees of ``SUBTREE`` shards at most,
tasks draw the subtrees. Blocks are numbered per source in stretches, so that no task sees all blocks of a source. Inside a shard, rows are ordered by a seeded hash. ``report``
counts the copies that the shards got; ``mix`` sends each copy to its shard and sorts there.

Edge cases: null text has 0 words; null source is a source of its own, last in order; documents without words
are never taken; repeated rows are drawn each for itself (rows equal in doc_id and text share a place in the
permutation and go in or out in row-number order); an empty table gives an empty result; further columns pass
through ``mix``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_FACTS, join_hot, keys_of_rows, release, staged, text_or_empty, unused, words_of

#: Words a block should have, and how many blocks in a row one task numbers.
BLOCK_WORDS = 20_000
STRETCH = 4096
#: Passes over the block in which a source's rest ends, and how many blocks after it they may take from.
FITTING_PASSES = 4
FITTING_BLOCKS = 3
#: Output shards: this many words each, but so many shards at least.
SHARD_WORDS = 200_000_000
LEAST_SHARDS = 8
#: Most shards of a subtree that one task draws.
SUBTREE = 256
#: Sources have one row each on the driver; more than this is refused.
MOST_SOURCES = 1_000_000


def targets(sizes: list[int], cap: float = 3.0) -> list[float]:
    """Words per source; ``sizes`` in source order."""
    total, weights = sum(sizes), [1 + i % 3 for i in range(len(sizes))]
    fixed: dict[int, float] = {}
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        left, weight = total - sum(fixed.values()), sum(weights[i] for i in free)
        over = [i for i in free if weight and left * weights[i] / weight > cap * sizes[i]]
        if not over:
            return [fixed.get(i, left * weights[i] / weight if i not in fixed else 0.0) for i in range(len(sizes))]
        fixed |= {i: float(cap * sizes[i]) for i in over}


def split_tree(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """shards x sources: exact block quotas of the output shards, shard totals at most one block apart."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def node(first: int, count: int, quota: np.ndarray) -> None:
        if count == 1:
            out[first] = quota
            return
        left = count // 2
        take = int(quota.sum()) * left // count
        rng = np.random.Generator(np.random.Philox(key=[seed, first * 1_000_003 + count]))
        drawn = np.zeros(len(quota), np.int64)
        rest, need = int(quota.sum()), take
        for i in np.flatnonzero(quota).tolist():  # the joint draw, one source after the other; most have nothing in a low node
            q = int(quota[i])
            rest -= q
            drawn[i] = need if rest == 0 else rng.hypergeometric(q, rest, need) if need else 0
            need -= int(drawn[i])
        node(first, left, drawn)
        node(first + left, count - left, quota - drawn)

    node(0, shards, np.array(quotas, np.int64))
    return out


def subtree_runs(shards: int, seed: int):
    """(subtree, sid, quota, first) of one subtree of ``shards`` leaves to the runs (sid, shard, first, end) of its shards."""

    def run(nodes: pd.DataFrame) -> pd.DataFrame:
        subtree = int(nodes["subtree"].iloc[0])
        leaves = split_tree(nodes["quota"].tolist(), shards, seed + subtree)
        shard, source = np.nonzero(leaves)
        ends = (nodes["first"].to_numpy() + np.cumsum(leaves, axis=0))[shard, source]
        return pd.DataFrame({"sid": nodes["sid"].to_numpy()[source], "shard": subtree * shards + shard, "first": ends - leaves[shard, source], "end": ends})

    return run


def running_sums(blocks: DataFrame, at: str, what: Column, name: str) -> DataFrame:
    """Staged ``blocks`` (sid, ``at``, ..) with the sum of ``what`` over the source's blocks before each, by stretches and within them."""
    blocks = blocks.withColumn("stretch", F.floor(F.col(at) / STRETCH)).withColumn("counted", what.cast("long"))
    earlier = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    sums = blocks.groupBy("sid", "stretch").agg(F.sum("counted").alias("counted"))
    ahead = sums.select("sid", "stretch", F.coalesce(F.sum("counted").over(earlier("sid").orderBy("stretch")), F.lit(0)).alias("ahead"))
    inside = F.coalesce(F.sum("counted").over(earlier("sid", "stretch").orderBy(at)), F.lit(0))
    return blocks.join(ahead, ["sid", "stretch"]).withColumn(name, F.col("ahead") + inside).drop("stretch", "counted", "ahead")


def in_pass(seed: int, number: Column) -> tuple[Column, Column]:
    """Place in the permutation of a pass, and block there."""
    h = F.xxhash64(F.lit(seed), number.cast("int"), "doc_id", "crc")
    return h, F.floor(F.shiftrightunsigned(h, 33) * F.col("blocks") / F.lit(2.0**31)).cast("int")


def of_sources(rows: DataFrame, table: DataFrame, key: str, sources: int, total: int) -> DataFrame:
    """``rows`` with what ``table`` has of their source (``members``: its rows): broadcast for a bounded number of sources, else hot ones are spread."""
    joined = rows.join(F.broadcast(table), key) if sources <= BROADCAST_FACTS else join_hot(rows, table, [key], "members", total, "rid")
    return joined.drop("members")


def plan(docs: DataFrame, seed: int = 17, cap: float = 3.0, rid: str | None = None) -> DataFrame:
    """Rows with size, source facts, place in the last pass's permutation (h) and block; ``rid``: the column of row ids, if there is one."""
    spark = docs.sparkSession
    size = F.size(words_of(text_or_empty())).cast("long")
    # Order of null last: sources sort by (is null, code points).
    rows = docs.select("doc_id", (F.col(rid) if rid else F.monotonically_increasing_id()).alias("rid"), F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")).alias("src"), size.alias("size"), F.crc32(text_or_empty().cast("binary")).alias("crc"))
    rows = staged(rows, "mix-rows")
    found = sorted(rows.groupBy("src").agg(F.sum("size").alias("words"), F.count("*").alias("members")).limit(MOST_SOURCES + 1).collect(), key=lambda r: (r["src"]["none"], r["src"]["name"]))
    if len(found) > MOST_SOURCES:
        raise ValueError("more sources than the driver may hold")
    goal = targets([r["words"] for r in found], cap)
    blocks = [int(max(1, -(-r["words"] // BLOCK_WORDS))) for r in found]
    facts = [(r["src"]["none"], r["src"]["name"], i, int(r["words"]), float(g), b, int(round(g) // max(r["words"], 1)), r["members"]) for i, (r, g, b) in enumerate(zip(found, goal, blocks, strict=True))]
    facts = spark.createDataFrame(facts, "none boolean, name string, sid int, source_size long, target double, blocks int, passes int, members long")
    facts = facts.select(F.struct("none", "name").alias("src"), "sid", "source_size", "target", "blocks", "passes", "members")
    h, block = in_pass(seed, F.col("passes"))
    placed_rows = of_sources(rows, facts, "src", len(found), sum(r["members"] for r in found))
    return placed_rows.withColumn("h", h).withColumn("block", block)


def draw(docs: DataFrame, seed: int = 17, cap: float = 3.0, rid: str | None = None) -> DataFrame:
    """One row per document: rid, doc_id, crc, size, source_size, target, taken, times, last (drawn in the last, partial pass) and its block."""
    rows = plan(docs, seed, cap, rid)
    rest = F.round("target") - F.col("passes") * F.col("source_size")
    by_block = staged(rows.groupBy("sid", "block").agg(F.sum("size").alias("block_words")), "mix-block-words")
    by_block = running_sums(by_block, "block", F.col("block_words"), "before")
    inner = rows.join(by_block, ["sid", "block"]).withColumn("rest", rest.cast("long"))
    # The block of a source in which its rest ends and the few after it: only these are ordered row by row. A row has a word
    # at least, so they are no more than the words of some blocks, however large the source is.
    ends_later = F.col("before") + F.col("block_words") > F.col("rest")
    partial = (F.col("size") > 0) & ends_later & (F.col("before") < F.col("rest") + FITTING_BLOCKS * F.col("source_size") / F.col("blocks"))
    cut = inner.where(partial).withColumn("last", F.lit(False))
    here = Window.partitionBy("sid")
    cut = cut.withColumn("before", F.min("before").over(here))
    ordered = here.orderBy("block", "h", "doc_id", "crc", "rid").rowsBetween(Window.unboundedPreceding, 0)
    for _ in range(FITTING_PASSES):  # in permuted order what fits; then, of the smaller ones left, what fits the remainder
        cut = cut.withColumn("short", F.col("rest") - F.col("before") - F.sum(F.when(F.col("last"), F.col("size")).otherwise(0)).over(here))
        fits = ~F.col("last") & (F.col("size") <= F.col("short"))
        running = F.sum(F.when(fits, F.col("size")).otherwise(0)).over(ordered)
        cut = cut.withColumn("last", F.col("last") | (fits & (running <= F.col("short"))))
    cut = cut.drop("short")
    whole = inner.where(~partial).withColumn("last", F.col("before") + F.col("block_words") <= F.col("rest"))
    chosen = staged(whole.unionByName(cut), "mix-chosen")
    missing = chosen.groupBy("sid").agg(F.first("rest").alias("rest"), F.sum(F.when(F.col("last"), F.col("size")).otherwise(0)).alias("got"), F.count("*").alias("members"))
    short = missing.select("sid", (F.col("rest") - F.col("got")).alias("short"), "members").where("short > 0")
    short = staged(short, "mix-short")
    sources, total = short.agg(F.count("*"), F.coalesce(F.sum("members"), F.lit(0))).first()
    order = F.struct(F.abs(F.col("size") - F.col("short")).alias("gap"), "h", "doc_id", "crc", "rid")
    # Not dealt by source, so each task keeps only its own best row of a source.
    open_rows = of_sources(chosen.where(~F.col("last") & (F.col("size") > 0)), short, "sid", sources, total)
    closing = open_rows.groupBy("sid").agg(F.min(order).alias("o"), F.first("short").alias("short"))
    # Closes the gap only if that brings the source nearer to its target.
    closing = closing.where("o.gap < short").select(F.col("o.rid").alias("rid"), F.lit(True).alias("closes"))
    rows = chosen.join(closing, "rid", "left")
    last = F.col("last") | F.coalesce("closes", F.lit(False))
    times = F.when(F.col("size") > 0, F.col("passes") + last.cast("int")).otherwise(0)
    return rows.select("rid", "doc_id", "crc", "size", "source_size", "target", (times * F.col("size")).cast("long").alias("taken"), times.cast("int").alias("times"), last.alias("last"), "block", "sid", "passes", "blocks", "h")


def placed(drawn: DataFrame, shards: int | None = None, seed: int = 17) -> DataFrame:
    """One row per drawn copy: rid, shard that the tree gives it, place there. ``drawn``: staged rows of ``draw``."""
    if shards is None:
        words = drawn.agg(F.sum("taken")).first()[0] or 0
        shards = max(LEAST_SHARDS, -(-words // SHARD_WORDS))
        shards = -(-shards // SUBTREE) * SUBTREE if shards > SUBTREE else shards  # whole subtrees
    copies = drawn.where("times > 0").select("rid", "doc_id", "crc", "sid", "blocks", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("copy"))
    # A source's drawn blocks, numbered along its permutations: pass after pass, those without a drawn row left out.
    copies = copies.withColumn("serial", F.col("copy").cast("long") * F.col("blocks") + in_pass(seed, F.col("copy"))[1])
    numbered = running_sums(staged(copies.select("sid", "serial").distinct(), "mix-serials"), "serial", F.lit(1), "at")
    numbered = staged(numbered, "mix-blocks")
    quotas = numbered.groupBy("sid").agg(F.count("*").alias("n")).orderBy("sid").collect()
    each = max(k for k in range(1, min(shards, SUBTREE) + 1) if shards % k == 0)
    top = split_tree([r["n"] for r in quotas], shards // each, seed + 2**32)
    ends = np.cumsum(top, axis=0)
    nodes = [(int(k), quotas[i]["sid"], int(top[k, i]), int(ends[k, i] - top[k, i])) for k, i in np.argwhere(top).tolist()]
    nodes = drawn.sparkSession.createDataFrame(nodes, "subtree int, sid int, quota long, first long")
    runs = nodes.groupBy("subtree").applyInPandas(subtree_runs(each, seed), "sid int, shard int, first long, end long")
    runs = runs.select("sid", "shard", F.explode(F.sequence(F.col("first"), F.col("end") - 1)).alias("at"))
    where = staged(numbered.join(runs, ["sid", "at"]).select("sid", "serial", "shard"), "mix-shards")
    return copies.join(keys_of_rows(where), ["sid", "serial"]).select("rid", "shard", F.xxhash64(F.lit(seed + 1), "doc_id", "crc", "copy").alias("place"))


def report(docs: DataFrame, seed: int = 17) -> DataFrame:
    """Per document: size, source_size, target, words taken and the output shards of its copies, in order."""
    drawn = staged(draw(docs, seed=seed), "mix-drawn")
    own = placed(drawn, seed=seed).groupBy("rid").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("shard")).cast("array<string>"), ",").alias("shards"))
    taken = (F.coalesce("n", F.lit(0)) * F.col("size")).cast("long")
    return drawn.join(own, "rid", "left").select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.coalesce("shards", F.lit("")).alias("shards"))


def mix(docs: DataFrame, shards: int | None = None, seed: int = 17) -> DataFrame:
    """The mixed rows, all columns kept, each as often as it was drawn, with ``_shard`` and ``_place``: a shard in one partition, in order of place.

    The two get more underscores before their names where ``docs`` has such columns.
    """
    rid, at, copy, shard, place = (unused(docs, n) for n in ("_rid", "_at", "_p", "_shard", "_place"))
    rows = staged(docs.withColumn(rid, F.monotonically_increasing_id()), "mix-docs")
    drawn = staged(draw(rows, seed, rid=rid), "mix-drawn")
    # At most ``cap`` copies of a row and one more.
    own = placed(drawn, shards, seed).groupBy("rid").agg(F.collect_list(F.struct("shard", "place")).alias(at))
    own = staged(own.select(F.col("rid").alias(rid), at), "mix-placed")
    release(docs.sparkSession)
    joined = rows.join(keys_of_rows(own), rid).select(*docs.columns, F.explode(at).alias(copy))
    joined = joined.select(*docs.columns, F.col(copy)["shard"].alias(shard), F.col(copy)["place"].alias(place))
    return joined.repartition(shard).sortWithinPartitions(shard, place)
