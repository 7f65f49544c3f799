"""CSV records of files of any size, split into tasks although quoted cells hold line breaks.

Spark hands out a file in blocks of lines. Whether a block begins within a quoted cell depends on all before it, so

1. every block is read twice at once: beginning outside and inside quotes, does it end inside? Two bits a block come out,
   and lines without a quote don't even leave the JVM for it;
2. the driver composes the bits of a file's blocks in order (a row per block, as many as tasks), which tells where each begins;
3. blocks then give their records apart. Only where a block begins inside quotes are the two ends of a record joined.

A quote opens a cell at its begin only and a doubled one stands for itself, so inch signs within a cell are text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK = ["file", "block"]


def ends_inside(line: bytes, inside: bool, sep: bytes) -> bool:
    """Whether a quoted cell is open at the end of a line that begins at a record's begin, or inside such a cell."""
    at, opening = 0, sep + b'"'
    if not inside:
        if not line.startswith(b'"'):
            at = line.find(opening) + 1
            if not at:
                return False
        at += 1
    while True:
        close = line.find(b'"', at)
        if close < 0:
            return True
        if line[close + 1 : close + 2] == b'"':
            at = close + 2
            continue
        at = line.find(opening, close + 1)
        if at < 0:
            return False
        at += len(opening)


def lines_of(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, block (its first byte), line (bytes, without the line feed), in the file's order within a task."""
    text = spark.read.text(path, lineSep="\n")
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"))


def has_quote(line: Column) -> Column:
    return F.contains(line.cast("string"), F.lit('"'))


def block_ends(lines: DataFrame, sep: bytes) -> DataFrame:
    """Of each block with quotes, whether it ends inside if it begins outside, and if it begins inside."""
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("outside", pa.bool_()), ("inside", pa.bool_())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, (False, True)
        for batch in batches:
            for file, block, line in zip(batch.column("file"), batch.column("block"), batch.column("line"), strict=True):
                key, raw = (file.as_py(), block.as_py()), line.as_py()
                if key != held:
                    if held:
                        yield pa.record_batch([[held[0]], [held[1]], [state[0]], [state[1]]], schema=schema)
                    held, state = key, (False, True)
                after = ends_inside(raw, False, sep), ends_inside(raw, True, sep)
                state = after[state[0]], after[state[1]]
        if held:
            yield pa.record_batch([[held[0]], [held[1]], [state[0]], [state[1]]], schema=schema)

    return lines.where(has_quote(F.col("line"))).mapInArrow(scan, "file string, block bigint, outside boolean, inside boolean")


@dataclass
class Begins:
    inside: list[tuple[str, int]]  # blocks that begin inside a quoted cell
    before: list[tuple[str, int]]  # blocks that end inside one


def composed(ends: DataFrame, blocks: DataFrame) -> Begins:
    """Where blocks begin: a row per block reaches the driver, which has as many tasks in its plan."""
    known = {(r["file"], r["block"]): (r["outside"], r["inside"]) for r in ends.collect()}
    out, state, last = Begins([], []), False, None
    if not any(a for a, _ in known.values()):
        return out
    for file, block in sorted((r["file"], r["block"]) for r in blocks.collect()):
        if file != last:
            state, last = False, file
        if state:
            out.inside.append((file, block))
        state = known.get((file, block), (False, True))[state]
        if state:
            out.before.append((file, block))
    return out


def cut(lines: DataFrame, sep: bytes, ends: bool, keyed: bool = False) -> DataFrame:
    """Records of blocks (column ``begins``: inside quotes), with their file and whether they are its first if ``keyed``, else without
    the files' first ones. ``ends``: what is cut by block borders instead, with ``part`` 0 for a block's first lines, 1 for its last ones."""
    kinds = {"file": ("string", pa.string()), "block": ("bigint", pa.int64()), "part": ("int", pa.int32()), "first": ("boolean", pa.bool_()), "record": ("binary", pa.binary())}
    names = [*kinds] if ends else ["file", "first", "record"] if keyed else ["record"]
    schema = pa.schema([(n, kinds[n][1]) for n in names])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, inside, head, first, open_ = None, False, False, False, []
        out: list[dict] = []

        def put(part: int | None, whole: list[bytes]) -> None:
            if ends == (part is not None) and (ends or keyed or not first):
                out.append({"file": held[0], "block": held[1], "part": part, "first": first, "record": b"\n".join(whole)})

        def flush() -> pa.RecordBatch:
            made = pa.record_batch([pa.array([r[n] for r in out], kinds[n][1]) for n in names], schema=schema)
            out.clear()
            return made

        for batch in batches:
            keys = batch.column("file"), batch.column("block")
            single = batch.num_rows and held == (keys[0][0].as_py(), keys[1][0].as_py()) == (keys[0][-1].as_py(), keys[1][-1].as_py())
            plain = single and not inside and not first and not pc.any(pc.match_substring(batch.column("line"), '"')).as_py()
            if plain:
                if not ends:
                    yield pa.record_batch([keys[0], pa.array([False] * batch.num_rows), batch.column("line")] if keyed else [batch.column("line")], schema=schema)
                continue
            for file, block, begins, line in zip(*keys, batch.column("begins"), batch.column("line"), strict=True):
                key, raw = (file.as_py(), block.as_py()), line.as_py()
                if key != held:
                    if open_:
                        put(0 if head else 1, open_)
                    held, inside, open_ = key, begins.as_py(), []
                    head, first = inside, key[1] == 0
                open_.append(raw)
                inside = ends_inside(raw, inside, sep) if b'"' in raw else inside
                if not inside:
                    put(0 if head else None, open_)
                    head, first, open_ = False, False, []
            if out:
                yield flush()
        if open_:
            put(0 if head else 1, open_)
        if out:
            yield flush()

    return lines.select(*BLOCK, "begins", "line").mapInArrow(work, ", ".join(f"{n} {kinds[n][0]}" for n in names))


def listed(spark: SparkSession, blocks: list[tuple[str, int]]) -> DataFrame:
    return F.broadcast(spark.createDataFrame(sorted(set(blocks)), "file string, block bigint"))


def header(lines: DataFrame, sep: bytes) -> bytes:
    """The first record of a first file."""
    count = 1
    while True:
        found = [bytes(r["line"]) for r in lines.where("block = 0").select("line").head(count)]
        inside = False
        for i, line in enumerate(found):
            inside = ends_inside(line, inside, sep)
            if not inside:
                return b"\n".join(found[: i + 1])
        if len(found) < count:
            return b"\n".join(found)
        count *= 2


def records(spark: SparkSession, path: str | list[str], sep: str, keyed: bool = False) -> DataFrame:
    """All records (bytes) but the first of every file, or with ``keyed`` all of them with file and first. A quoted cell that is
    never closed ends with its file."""
    mark = sep.encode()
    lines = lines_of(spark, path)
    begins = composed(block_ends(lines, mark), lines.select(*BLOCK).distinct())
    if not begins.before:
        return cut(lines.withColumn("begins", F.lit(False)), mark, False, keyed)
    inside = listed(spark, begins.inside).withColumn("begins", F.lit(True)) if begins.inside else None
    known = lines.join(inside, BLOCK, "left").withColumn("begins", F.coalesce("begins", F.lit(False))) if inside is not None else lines.withColumn("begins", F.lit(False))
    ends = cut(known.join(listed(spark, begins.inside + begins.before), BLOCK, "left_semi"), mark, True)
    # A record is the last lines of a block and the first ones of the blocks that follow.
    opener = F.max(F.when(F.col("part") == 1, F.col("block"))).over(Window.partitionBy("file").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, 0))
    pieces = ends.withColumn("opener", opener).where("opener is not null").groupBy("file", "opener").agg(
        F.max("first").alias("first"), F.array_sort(F.collect_list(F.struct("block", "part", F.col("record").cast("string").alias("text")))).alias("p")
    )
    joined = pieces.select("file", "first", F.array_join("p.text", "\n").cast("binary").alias("record"))
    whole = cut(known, mark, False, keyed)
    return whole.unionByName(joined if keyed else joined.where("not first").select("record"))
