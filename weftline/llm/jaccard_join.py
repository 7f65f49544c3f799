"""N-gram Jaccard self-join by chosen paths.

A document is its set of hashed word 5-grams (fewer words: one gram of all of them). Documents with equal sets are one
record. In each run every record follows the path of the token that a shared random order puts first in its set: records
that chose the same token meet in a bucket. A bucket above ``LIMIT`` records splits again, each record following two
more sampled tokens, up to ``LEVELS`` deep; a bucket that does not shrink by half when split (a dense group) stays whole. Two
records of similarity s meet in a leaf of a run with probability at least 0.75 for s >= 0.8 (the fixed point of
p = s (1 - (1 - p)^2)), so ``runs_for`` runs reach the target recall.

Leaves up to ``BLOCK`` records are verified by brute force on the exact sets, where sizes and sampled tokens let a link be likely. A
larger leaf's records form a home, with the tokens of most of them as its middle. Records that differ from it by at most a ninth of
their size, at s = 0.8, are all linked with each other: a ball, whose links are counted by its sum of texts, without pairs. Records
far from the middle meet in leaves by sampled differences from it, so that a passage that many documents share brings none
together. What lies between is dealt into pairs of chunks: signatures first, then the sets of records with a likely pair. A pair is counted in its ball, else in its first common leaf: a leaf gives
each record its number of links and one link towards its group in the leaf. Groups are then connected components of balls and records.

Result per document: class_id (least doc_id of its connected group), copy_id (least doc_id with the same set), n_links (number of
different texts linked to its text), n_copies (documents with the same set).

Edge cases: null text counts as empty; texts without words form one class and have no links; repeated rows are
documents of their own; a null doc_id is the "least" of a group only if the whole group has none; an empty table
gives an empty result; very long texts take part whole; other columns are ignored here and kept by ``keep_one``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, join_hot, join_listed, keys_of_rows, let, staged, text_or_empty, unused, words_of

GRAM = 5
THRESHOLD = 0.8
TARGET_RECALL = 1 - 1e-6
#: Least probability that a run joins a pair at the threshold.
PER_RUN = 0.75
LIMIT = 256
BLOCK = 256
LEVELS = 3
BRANCHES = 2
PER_PATH = 1 + BRANCHES * (LEVELS - 1)
#: Bytes of a signature, one per sampled token. Records of similarity 0.8 agree in fewer than ``LEAST_AGREED`` of them with a chance below 1e-9.
LEAST_AGREED = 20
#: Most samples of a record's differences from the middle of a home, and the run numbers of their leaves and of a home's own blocks.
DIFFERENCE_RUNS = 32
FIRST_DIFFERENCE, HOME_BLOCKS = 24, 60
LINKS = "rid long, node long, links long, root long"


def runs_for(recall: float) -> int:
    return max(1, math.ceil(round(math.log(1 - recall) / math.log(1 - PER_RUN), 6)))


def grams(text: Column) -> Column:
    """Distinct hashed word 5-grams."""

    def of(w: Column) -> Column:
        each = F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, GRAM)]))
        many = F.slice(each, 1, F.greatest(F.size(w) - GRAM + 1, F.lit(1)))
        return F.when(F.size(w) == 0, F.array().cast("array<long>")).otherwise(F.array_distinct(many))

    return let(words_of(text), of)


def scrambled(values: np.ndarray, seed: int) -> np.ndarray:
    """A random order of 64-bit tokens for each seed, one to one."""
    mult = np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1)) & (2**64 - 1) | 1)
    x = (values ^ np.uint64((0xD6E8FEB86659FD93 * (seed + 1)) & (2**64 - 1))) * mult
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def sampler(runs: int):
    """Appends to (.., n, set) the sampled tokens of all paths, and a byte of each as signature, in place of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                some = batch.slice(at, 400)
                at += 400
                sets = some.column(some.num_columns - 1)
                flat = sets.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                sizes = np.diff(np.asarray(sets.offsets))
                full = np.flatnonzero(sizes)
                starts = (np.cumsum(sizes) - sizes)[full]
                found = np.zeros((len(sizes), runs * PER_PATH), np.int64)
                if len(full):
                    for k in range(runs * PER_PATH):
                        found[full, k] = np.minimum.reduceat(scrambled(flat, k), starts).view(np.int64)
                paths = pa.ListArray.from_arrays(np.arange(len(sizes) + 1, dtype=np.int32) * (runs * PER_PATH), pa.array(found.reshape(-1)))
                signs = pa.array([row.tobytes() for row in (found & 0xFF).astype(np.uint8)], pa.binary())
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], paths, signs], [*some.schema.names[:-1], "paths", "sign"])

    return run


def records(docs: DataFrame, runs: int) -> DataFrame:
    """Staged, per row: rid, doc_id, t1/t2 (text), s1/s2 (set), n (set size), paths, sign."""
    body = text_or_empty()
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(body).alias("t1"), F.xxhash64(F.lit(1), body).alias("t2"), grams(body).alias("set"))
    ordered = F.sort_array("set")
    rows = rows.select("doc_id", "t1", "t2", F.xxhash64(ordered).alias("s1"), F.xxhash64(F.lit(1), ordered).alias("s2"), F.size("set").alias("n"), "set")
    made = rows.mapInArrow(sampler(runs), "doc_id long, t1 long, t2 long, s1 long, s2 long, n int, paths array<long>, sign binary")
    return staged(made.withColumn("rid", F.monotonically_increasing_id()), "jaccard-records")


def distinct_sets(rows: DataFrame) -> DataFrame:
    """Per set: rep (a row), n_texts, n_copies, best (the row that comes first by doc_id). Copies combine before each shuffle."""
    order = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1", "t2", "rid"))
    texts = rows.groupBy("s1", "s2", "t1", "t2").agg(F.count("*").alias("copies"), F.min("rid").alias("rid"), order.alias("best"), F.min("n").alias("n"))
    return texts.groupBy("s1", "s2").agg(F.min("rid").alias("rep"), F.count("*").alias("n_texts"), F.sum("copies").alias("n_copies"), F.min("best").alias("best"), F.min("n").alias("n"))


def leaves(reps: DataFrame, runs: int) -> DataFrame:
    """(leaf, rid, size): leaves of two records or more; the run is in a leaf's high bits, so its order is run order."""
    first = F.transform(F.sequence(F.lit(0), F.lit(runs - 1)), lambda r: F.struct(r.alias("run"), leaf_id(r, r, F.get("paths", r * PER_PATH)).alias("node")))
    level = reps.select("rid", F.inline(first))
    out = []
    for depth in range(1, LEVELS + 1):
        counts = level.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
        level = staged(level.join(counts, "node"), "jaccard-level")
        out.append(level.where(F.col("size") <= LIMIT) if depth < LEVELS else level)
        large = level.where(F.col("size") > LIMIT)
        if depth == LEVELS or not large.limit(1).count():
            break
        base = 1 + BRANCHES * (depth - 1)
        child = F.transform(F.sequence(F.lit(0), F.lit(BRANCHES - 1)), lambda b, base=base: leaf_id(F.col("run"), "node", b, F.get("paths", F.col("run") * PER_PATH + base + b)))
        split = staged(large.join(reps.select("rid", "paths"), "rid").select("rid", "run", F.col("node").alias("parent"), "size", F.explode(child).alias("node")), "jaccard-split")
        sizes = split.groupBy("parent", "node").agg(F.count("*").alias("part"), F.first("size").alias("size"))
        dense = staged(sizes.groupBy("parent").agg(F.max("part").alias("most"), F.first("size").alias("size")).where("2 * most > size").select("parent"), "jaccard-dense")
        out.append(large.join(dense, large["node"] == dense["parent"], "left_semi"))
        level = split.join(dense, "parent", "left_anti").select("rid", "run", "node")
    found = out[0].select("node", "rid", "size")
    for more in out[1:]:
        found = found.unionByName(more.select("node", "rid", "size"))
    return staged(found.withColumnRenamed("node", "leaf"), "jaccard-leaves")


def runs_of_rows(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[list[list]]:
    """Rows of a stream sorted by columns 0..key-1, one list of columns per run of equal keys."""
    held, current = None, None
    for batch in batches:
        columns = [batch.column(i).to_pylist() if i < key else batch.column(i) for i in range(batch.num_columns)]
        keys = list(zip(*columns[:key], strict=True))
        at = 0
        while at < len(keys):
            end = at
            while end < len(keys) and keys[end] == keys[at]:
                end += 1
            part = batch.slice(at, end - at)
            if keys[at] == current:
                held.append(part)
            else:
                if held:
                    yield held
                current, held = keys[at], [part]
            at = end
    if held:
        yield held


def covered(leaf: int, lists: list[list[int]]) -> np.ndarray:
    """Pairs of members that share an earlier leaf."""
    out = np.zeros((len(lists), len(lists)), bool)
    earlier: dict[int, list[int]] = {}
    for i, own in enumerate(lists):
        for other in own:
            if other < leaf:
                earlier.setdefault(other, []).append(i)
    for members in earlier.values():
        if len(members) > 1:
            out[np.ix_(members, members)] = True
    return out


def likely_pairs(size: np.ndarray, sign: np.ndarray, other_size: np.ndarray, other_sign: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of records sizes and signatures let be linked."""
    agreed = np.zeros((len(size), len(other_size)), np.uint16)
    for one, other in zip(np.ascontiguousarray(sign.T), np.ascontiguousarray(other_sign.T), strict=True):
        agreed += one[:, None] == other[None, :]
    small, great = np.minimum(size[:, None], other_size[None, :]), np.maximum(size[:, None], other_size[None, :])
    return (agreed >= LEAST_AGREED * sign.shape[1] / 50) & (small >= threshold * great - 1e-9)


def needed(threshold: float):
    """(leaf, rid, mine, n, sign) sorted by leaf: the members with a likely pair that no earlier leaf has."""
    schema = pa.schema([("leaf", pa.int64()), ("rid", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for parts in runs_of_rows(batches, 1):
            leaf, rids, lists, sizes, signs = parts[0].column(0)[0].as_py(), [], [], [], []
            for p in parts:
                for held, column in zip((rids, lists, sizes, signs), p.columns[1:], strict=True):
                    held += column.to_pylist()
            size, sign = np.array(sizes), np.frombuffer(b"".join(signs), np.uint8).reshape(len(signs), -1)
            likely = likely_pairs(size, sign, size, sign, threshold)
            np.fill_diagonal(likely, False)
            if likely.any():
                likely &= ~covered(leaf, lists)
            out += [(leaf, rids[i]) for i in np.flatnonzero(likely.any(axis=1))]
            if len(out) > 5000:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)
                out = []
        if out:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)

    return run


def needed_leaves(members: DataFrame, rows: DataFrame, mine: DataFrame, threshold: float) -> DataFrame:
    """(leaf, rid) of the leaves up to ``BLOCK`` records in which a record has a likely pair. ``members``: leaf, rid."""
    signed = members.join(mine, "rid").join(rows.select("rid", "n", "sign"), "rid")
    signed = signed.select("leaf", "rid", F.filter("mine", lambda x: x < F.col("leaf")).alias("mine"), "n", "sign")
    return signed.repartition("leaf").sortWithinPartitions("leaf").mapInArrow(needed(threshold), "leaf long, rid long")


def needed_in_blocks(threshold: float):
    """Blocks (leaf, a, b, rid, chunk, n, sign), sorted by block, to the (rid, leaf, a, b, chunk) that have a likely pair in their block."""
    names = ("rid", "leaf", "a", "b", "chunk")
    schema = pa.schema([(c, pa.int64() if c in names[:2] else pa.int32()) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in runs_of_rows(batches, 3):
            leaf, a, b = (parts[0].column(i)[0].as_py() for i in range(3))
            rid, chunk, size = (np.concatenate([p.column(i).to_numpy(zero_copy_only=False) for p in parts]) for i in (3, 4, 5))
            sign = np.frombuffer(b"".join(x for p in parts for x in p.column(6).to_pylist()), np.uint8).reshape(len(rid), -1)
            one = np.flatnonzero(chunk == chunk[0])
            two = one if a == b else np.flatnonzero(chunk != chunk[0])
            if not len(two):
                continue
            likely = likely_pairs(size[one], sign[one], size[two], sign[two], threshold) & (rid[one][:, None] != rid[two][None, :])
            stay = np.union1d(one[likely.any(axis=1)], two[likely.any(axis=0)])
            if len(stay):
                columns = [rid[stay], *(np.full(len(stay), x) for x in (leaf, a, b)), chunk[stay]]
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections."""
    n = len(sets)
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]])
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, token, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = times[token] > 1
    _, token = np.unique(token[several], return_inverse=True)
    owner, out = owner[several], np.zeros((n, n))
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    for first in range(0, int(token[-1]) + 1 if len(token) else 0, 2048):
        a, b = np.searchsorted(token, [first, first + 2048])
        dense = np.zeros((n, 2048), np.float32)
        dense[owner[a:b], token[a:b] - first] = 1
        out += dense @ dense.T
    return np.rint(out).astype(np.int64)


def verifier(threshold: float):
    """Blocks (leaf, a, b, rid, chunk, weight, home, mine, set), sorted by block, to (rid, node, links, root)."""
    schema = pa.schema([("rid", pa.int64()), ("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int, int]] = []
        for parts in runs_of_rows(batches, 3):
            leaf, a, b = (parts[0].column(i)[0].as_py() for i in range(3))
            rid, chunk, weight, node = (np.concatenate([p.column(i).to_numpy(zero_copy_only=False) for p in parts]) for i in (3, 4, 5, 6))
            # A row repeated with its doc_id and text comes as often; once is enough.
            _, once = np.unique(rid, return_index=True)
            if len(once) < 2:
                continue
            sets = [s.values.to_numpy(zero_copy_only=False) for p in parts for s in p.column(8)]
            mine = [x for p in parts for x in p.column(7).to_pylist()]
            if len(once) < len(rid):
                rid, chunk, weight, node = rid[once], chunk[once], weight[once], node[once]
                sets, mine = [sets[i] for i in once], [mine[i] for i in once]
            size = np.array([len(s) for s in sets])
            both = shared_counts(sets)
            linked = both * (1 + threshold) >= threshold * (size[:, None] + size[None, :]) - 1e-9
            linked &= node[:, None] != node[None, :]  # members of one ball are counted there; also clears the diagonal
            if a != b:
                linked &= chunk[:, None] != chunk[None, :]
            if linked.any():
                linked &= ~covered(leaf, mine)
            if not linked.any():
                continue
            links = linked @ weight
            root = node
            while True:  # least node reachable inside the block
                least = np.minimum(root, np.where(linked, root[None, :], root[:, None]).min(axis=1))
                if (least == root).all():
                    break
                root = least
            out += [(int(rid[i]), int(node[i]), int(links[i]), int(root[i])) for i in np.flatnonzero(links)]
            if len(out) > 5000:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)
                out = []
        if out:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)

    return run


def homes_of(large: DataFrame) -> DataFrame:
    """Staged (rid, home), seldom more than one home a record: first records of the leaves above ``BLOCK`` that it lies in.

    Where a first record lies in the leaf of an earlier one, its own leaves move there.
    """
    firsts = staged(large.groupBy("leaf").agg(F.min("rid").alias("home"), F.count("*").alias("members")), "jaccard-firsts")
    homes = staged(join_listed(large.select("leaf", "rid"), firsts, "leaf", "members", large.count(), "rid").select("rid", "home").distinct(), "jaccard-homes")
    for _ in range(2):
        up = homes.groupBy(F.col("rid").alias("home")).agg(F.min("home").alias("up"))
        sized = staged(homes.groupBy("home").agg(F.count("*").alias("members")).join(up, "home"), "jaccard-up")
        homes = staged(join_hot(homes, sized, ["home"], "members", homes.count(), "rid").select("rid", F.col("up").alias("home")).distinct(), "jaccard-homes")
    return homes


def leaf_id(run: Column, *parts) -> Column:
    """The run is in a leaf's high bits, so that leaves are in the order of their runs."""
    return F.shiftleft(run.cast("long"), 57).bitwiseOR(F.shiftrightunsigned(F.xxhash64(*parts), 7))


def majorities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (home, block, set), sorted by block, to (home, held, tokens): the records of a block, and the tokens that more than half of them have."""
    schema = pa.schema([("home", pa.int64()), ("held", pa.int64()), ("tokens", pa.list_(pa.int64()))])
    for parts in runs_of_rows(batches, 2):
        held = sum(p.num_rows for p in parts)
        token, times = np.unique(np.concatenate([p.column(2).flatten().to_numpy(zero_copy_only=False) for p in parts]), return_counts=True)
        yield pa.record_batch([pa.array([parts[0].column(0)[0].as_py()], pa.int64()), pa.array([held], pa.int64()), pa.array([token[2 * times > held]], pa.list_(pa.int64()))], schema=schema)


def votes(own: DataFrame, sizes: DataFrame, total: int) -> DataFrame:
    """(home, token, n): how many records lie in blocks of the home whose majority has the token.

    All records of a home are dealt into blocks of some ``BLOCK``. A block tells the tokens of most of its records, so rows of tokens are made for
    each block, not for each record.
    """
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK), F.lit(1)).cast("bigint")
    dealt = join_hot(own.select("rid", "home", "set"), sizes, ["home"], "members", total, "rid").select("home", F.pmod(F.xxhash64("rid"), blocks).alias("block"), "set")
    told = dealt.repartition("home", "block").sortWithinPartitions("home", "block").mapInArrow(majorities, "home long, held long, tokens array<long>")
    return told.select("home", "held", F.explode("tokens").alias("token")).groupBy("home", "token").agg(F.sum("held").alias("n"))


def difference_runs(n: Column, d: Column, threshold: float) -> Column:
    """Samples that a record of n tokens, d of them or of the middle's in its difference, needs, at most ``DIFFERENCE_RUNS``.

    Another record linked with it differs in x <= n (1 - s) / s tokens, and so do their differences, whose similarity is then 1 - x / d at least.
    Of two linked records the one that takes fewer samples takes enough for both.
    """
    apart = (1 - threshold) / threshold * n / d
    needed = F.ceil(F.lit(math.log(1 - TARGET_RECALL)) / F.ln(apart))
    return F.when((d > 0) & (apart < 1), F.least(F.greatest(needed, F.lit(1)), F.lit(DIFFERENCE_RUNS))).otherwise(DIFFERENCE_RUNS).cast("int")


def balls(sets: DataFrame, homes: DataFrame, threshold: float) -> DataFrame:
    """Staged (rid, home, weight, inside, far, samples), a row per record and home.

    The middle of a home is the set of the tokens that more than half of its records have, by the ``votes`` of its blocks; what follows holds for
    any set as middle. With t = (1 - s) / (1 + s) two
    sets a, b are linked at s if and only if their symmetric difference is at most t (|a| + |b|). So all records within t |a| of a middle
    are linked with each other (``inside``; in the first of a record's homes only), and a record farther than t |a| + 2 t |middle| / (1 - t)
    is linked with none of them (``far``). Differences from the middle of two linked far records are alike, the more so the larger they are
    (``difference_runs``), so sampled ones bring them together, and records that have nothing but the middle in common stay apart.
    """
    own = sets.where("homes is not null").select("rid", "weight", "set", F.explode("homes").alias("home"), (F.array_min("homes")).alias("main"))
    total = homes.count()
    sizes = staged(homes.groupBy("home").agg(F.count("*").alias("members")), "jaccard-home-sizes")
    # A home's middle may have many tokens, so they are spread.
    common = join_hot(votes(own, sizes, total), sizes, ["home"], "members", total, "token").where("2 * n > members").groupBy("home").agg(F.collect_list("token").alias("middle"))
    middle = sizes.join(common, "home", "left").withColumn("middle", F.coalesce("middle", F.array().cast("array<bigint>")))
    middle = staged(middle, "jaccard-middles")
    t = (1 - threshold) / (1 + threshold)
    n, d = F.size("set"), F.size("set") + F.size("middle") - 2 * F.size(F.array_intersect("set", "middle"))
    near = join_hot(own, middle, ["home"], "members", total, "rid").withColumns({"_n": n, "_d": d})
    n, d = F.col("_n"), F.col("_d")
    inside = (F.col("home") == F.col("main")) & (d <= t * n - 1e-9)
    far = d > t * n + 2 * t / (1 - t) * F.size("middle") + 1e-9
    lacking = F.transform(F.array_except("middle", "set"), lambda x: F.xxhash64(F.lit(1), x))
    upto = difference_runs(n, d, threshold)
    samples = let(F.concat(F.array_except("set", "middle"), lacking), lambda v: F.transform(F.sequence(F.lit(0), upto - 1), lambda r: F.array_min(F.transform(v, lambda x: F.xxhash64(r, x)))))
    near = near.select("rid", "home", "weight", inside.alias("inside"), far.alias("far"), F.when(~inside & (d > 0), samples).alias("samples"))
    return staged(near.dropDuplicates(["rid", "home"]), "jaccard-balls")


def inside_links(judged: DataFrame) -> DataFrame:
    """(rid, node, links): the texts of a ball but the own ones, without a pair. Balls are nodes below 0, other records nodes by their number."""
    inside = judged.where("inside").select("rid", "home", "weight")
    whole = staged(inside.groupBy("home").agg(F.sum("weight").alias("whole"), F.count("*").alias("members")).where("members > 1"), "jaccard-whole")
    joined = join_hot(inside, whole, ["home"], "members", inside.count(), "rid")
    return joined.select("rid", (-1 - F.col("home")).alias("node"), (F.col("whole") - F.col("weight")).alias("links"))


def difference_leaves(judged: DataFrame) -> DataFrame:
    """Staged (leaf, rid, size): records of a home that agree in a sampled difference."""
    rows = judged.where("samples is not null").select("rid", "home", F.posexplode("samples").alias("run", "token"))
    rows = rows.select(leaf_id(F.col("run") + FIRST_DIFFERENCE, "home", "run", "token").alias("leaf"), "rid")
    rows = staged(rows, "jaccard-differences")
    counts = staged(rows.groupBy("leaf").agg(F.count("*").alias("size")).where("size > 1"), "jaccard-difference-sizes")
    return staged(join_listed(rows, counts, "leaf", "size", rows.count(), "rid"), "jaccard-difference-leaves")


def chunked(rows: DataFrame, sizes: DataFrame, total: int) -> DataFrame:
    """(rid, leaf, a, b, chunk, n, sign): rows (leaf, rid, core, n, sign) dealt into pairs of chunks. Those outside the core meet all, those inside only them."""

    def chunks(n: Column) -> Column:
        return F.ceil(n / BLOCK).cast("int")

    def chunk_of(n: Column) -> Column:
        return F.pmod(F.xxhash64("rid"), F.greatest(chunks(n), F.lit(1))).cast("int")

    def upto(n: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), n), lambda i: i < n)

    core, others = F.col("n_core"), F.col("size") - F.col("n_core")
    block = lambda a, b, chunk: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), chunk.cast("int").alias("chunk"))
    own = chunk_of(others)
    among = F.transform(upto(chunks(others)), lambda k: block(F.least(own, k), F.greatest(own, k), own))
    to_core = F.transform(upto(chunks(core)), lambda j: block(-1 - own, j, F.lit(-1)))
    from_core = F.transform(upto(chunks(others)), lambda q: block(-1 - q, chunk_of(core), F.lit(-2)))
    dealt = join_listed(rows, sizes, "leaf", "size", total, "rid")
    return dealt.select("rid", "leaf", F.inline(F.when(F.col("core"), from_core).otherwise(F.concat(among, to_core))), "n", "sign")


def verified(docs: DataFrame, rows: DataFrame, sets: DataFrame, found: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Staged (rid, node, links, root) of all leaves, and (rid, node, links) of the balls."""
    small, large = found.where(F.col("size") <= BLOCK).select("leaf", "rid"), found.where(F.col("size") > BLOCK)
    mine = staged(small.groupBy("rid").agg(F.sort_array(F.collect_list("leaf")).alias("mine")), "jaccard-mine")
    few = needed_leaves(small, rows, mine, threshold).groupBy("rid").agg(F.collect_list("leaf").alias("few"))
    dense = large.limit(1).count() > 0
    homes = homes_of(large) if dense else large.selectExpr("rid", "leaf as home")
    # Exact sets of the records that some block may want, from the texts of their representatives: every text moves once.
    which = few.join(homes.groupBy("rid").agg(F.collect_list("home").alias("homes")), "rid", "full_outer")
    which = which.join(rows.select("rid", "doc_id", "t1", "t2"), "rid").join(sets.select(F.col("rep").alias("rid"), "n_texts"), "rid").join(mine, "rid", "left")
    none = F.array().cast("array<bigint>")
    which = staged(which.select("rid", F.col("n_texts").alias("weight"), "homes", F.coalesce("few", none).alias("few"), F.coalesce("mine", none).alias("mine"), F.col("doc_id").alias("_doc"), "t1", "t2"), "jaccard-which")
    texts = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).withColumn("h1", F.xxhash64("text")).withColumn("h2", F.xxhash64(F.lit(1), "text"))
    same = texts["doc_id"].eqNullSafe(which["_doc"]) & (texts["h1"] == which["t1"]) & (texts["h2"] == which["t2"])
    exact = texts.join(keys_of_rows(which), same).select("rid", "weight", "homes", "few", "mine", F.sort_array(grams(F.col("text"))).alias("set"))
    exact = staged(exact, "jaccard-sets")
    columns = ["leaf", "a", "b", "rid", "chunk", "weight", "node", "mine", "set"]
    zero = [F.lit(0).alias(c) for c in ("a", "b", "chunk")]
    plain = exact.where("homes is null").select(F.explode("few").alias("leaf"), *zero, "rid", "weight", F.col("rid").alias("node"), "mine", "set").select(columns)
    inside = None
    if dense:
        judged = balls(exact, homes, threshold)
        inside = staged(inside_links(judged), "jaccard-inside")
        apart = difference_leaves(judged)
        later = apart.groupBy("rid").agg(F.sort_array(F.collect_list("leaf")).alias("later"))
        both = exact.select("rid", "mine").dropDuplicates(["rid"]).join(later, "rid")
        both = staged(both.select("rid", F.concat("mine", "later").alias("mine")), "jaccard-later")
        again = needed_leaves(apart.where(F.col("size") <= BLOCK).select("leaf", "rid"), rows, both, threshold).select("rid", "leaf", *zero)
        crowded = apart.where(F.col("size") > BLOCK).select("leaf", "rid", F.lit(False).alias("core"))
        crowds = staged(crowded.groupBy("leaf").agg(F.count("*").alias("size"), F.lit(0).cast("long").alias("n_core")), "jaccard-crowds")
        near = judged.where("inside or not far").select(leaf_id(F.lit(HOME_BLOCKS), "home").alias("leaf"), "rid", F.col("inside").alias("core"))
        nears = near.groupBy("leaf").agg(F.count("*").alias("size"), F.count_if("core").alias("n_core")).where("n_core < size")
        nears = staged(nears, "jaccard-nears")
        # Signatures go to every pair of chunks first; a set follows only where its record has a likely pair.
        signs = rows.select("rid", "n", "sign")
        dealt = chunked(crowded.join(signs, "rid"), crowds, apart.count()).unionByName(chunked(near.join(signs, "rid"), nears, judged.count()))
        dealt = dealt.select("leaf", "a", "b", "rid", "chunk", "n", "sign").repartition("leaf", "a", "b").sortWithinPartitions("leaf", "a", "b")
        many = again.unionByName(dealt.mapInArrow(needed_in_blocks(threshold), "rid long, leaf long, a int, b int, chunk int"))
        many = staged(many.groupBy("rid").agg(F.collect_list(F.struct("leaf", "a", "b", "chunk")).alias("many")), "jaccard-many")
        housed = exact.where("homes is not null").drop("mine").join(many, "rid", "left").join(inside.select("rid", "node"), "rid", "left")
        housed = housed.join(exact.select("rid", "mine").dropDuplicates(["rid"]).join(both.withColumnRenamed("mine", "all"), "rid", "left").select("rid", F.coalesce("all", "mine").alias("mine")), "rid")
        of_small = F.transform("few", lambda x: F.struct(x.alias("leaf"), *zero))
        wanted = F.concat(of_small, F.coalesce("many", F.filter(of_small, lambda _: F.lit(False))))
        plain = plain.unionByName(housed.select(F.inline(wanted), "rid", "weight", F.coalesce("node", "rid").alias("node"), "mine", "set").select(columns))
    dealt = plain.repartition("leaf", "a", "b").sortWithinPartitions("leaf", "a", "b")
    links = staged(dealt.mapInArrow(verifier(threshold), LINKS), "jaccard-links")
    return links, links.select("rid", "node", "links").limit(0) if inside is None else inside


def components(edges: DataFrame) -> DataFrame:
    """(v, root) with the least vertex of each connected component: large-star and small-star rounds over (u, v)."""
    edges = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = staged(large, "edges-large")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(down, "u")
        small = linked.select("u", F.col("m").alias("v")).unionByName(linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        edges = staged(small, "edges-small")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("u").alias("v"), F.col("v").alias("root"))
        before = now


def grouped(docs: DataFrame, threshold: float = THRESHOLD, recall: float = TARGET_RECALL) -> tuple[DataFrame, DataFrame]:
    """Staged rows, and staged per set: s1, s2, root, best, class_best (first row of the group), n_links, n_copies."""
    bounded_batches(docs.sparkSession)
    runs = runs_for(recall)
    rows = records(docs, runs)
    sets = staged(distinct_sets(rows), "jaccard-distinct")
    reps = sets.where("n > 0").select(F.col("rep").alias("rid")).join(rows.select("rid", "paths"), "rid")
    found = leaves(reps, runs)
    links, inside = verified(docs, rows, sets, found, threshold)
    roots = components(links.select(F.col("node").alias("u"), F.col("root").alias("v")))
    summed = links.select("rid", "links").unionByName(inside.select("rid", "links")).groupBy(F.col("rid").alias("rep")).agg(F.sum("links").alias("links"))
    named = sets.join(inside.select(F.col("rid").alias("rep"), "node"), "rep", "left").join(summed, "rep", "left")
    named = named.withColumn("v", F.coalesce("node", "rep"))
    n_links = F.when(F.col("n") > 0, F.col("n_texts") - 1 + F.coalesce("links", F.lit(0))).otherwise(0)
    total = sets.count()
    balls = inside.groupBy(F.col("node").alias("v")).agg(F.count("*").alias("held"))
    roots = roots.unionByName(roots.select(F.col("root").alias("v"), "root").distinct())
    roots = roots.join(balls, "v", "full_outer").select("v", F.coalesce("root", "v").alias("root"), F.coalesce("held", F.lit(1)).alias("held"))
    roots = staged(roots, "jaccard-roots")
    lone = named.join(roots.select("v"), "v", "left_anti").withColumn("root", F.col("v"))
    grown = staged(join_hot(named, roots, ["v"], "held", total, "rep").drop("held"), "jaccard-grown")
    first = staged(grown.groupBy("root").agg(F.min("best").alias("class_best"), F.count("*").alias("held")), "jaccard-first")
    columns = ["s1", "s2", "root", "best", "class_best", n_links.cast("long").alias("n_links"), "n_copies"]
    grown = join_hot(grown, first, ["root"], "held", total, "rep").select(columns)
    return rows, staged(grown.unionByName(lone.withColumn("class_best", F.col("best")).select(columns)), "jaccard-named")


def join_report(docs: DataFrame, threshold: float = THRESHOLD, recall: float = TARGET_RECALL) -> DataFrame:
    rows, named = grouped(docs, threshold, recall)
    one = named.select("s1", "s2", F.col("class_best.doc_id").alias("class_id"), "n_links", F.col("best.doc_id").alias("copy_id"), "n_copies")
    joined = join_hot(rows.select("doc_id", "rid", "s1", "s2"), one, ["s1", "s2"], "n_copies", rows.count(), "rid")
    return joined.select("doc_id", "class_id", "n_links", "copy_id", "n_copies")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, recall: float = TARGET_RECALL) -> DataFrame:
    """One row of each group, the first by doc_id (null last), then by text; all columns kept."""
    rows, named = grouped(docs, threshold, recall)
    stays = staged(named.where("best = class_best").select(F.col("best.doc_id").alias("_doc"), F.col("best.t1").alias("_t1"), F.col("best.t2").alias("_t2")), "jaccard-kept")
    body, mark = text_or_empty(), unused(docs, "copies")
    same = docs["doc_id"].eqNullSafe(stays["_doc"]) & (F.xxhash64(body) == stays["_t1"]) & (F.xxhash64(F.lit(1), body) == stays["_t2"])
    kept = docs.join(keys_of_rows(stays), same, "left_semi")
    # Rows that repeat with doc_id and text all match: seldom, so only then one of each is picked.
    if not rows.groupBy("doc_id", "t1", "t2").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        return kept
    one = Window.partitionBy("doc_id", F.xxhash64(body), F.xxhash64(F.lit(1), body)).orderBy(*[F.col(c) for c, kind in docs.dtypes if "map" not in kind and "variant" not in kind])
    return kept.withColumn(mark, F.row_number().over(one)).where(F.col(mark) == 1).drop(mark)
