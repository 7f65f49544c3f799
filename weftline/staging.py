"""Frames written once to the folder that driver and executors share, and joins whose small side is counted."""

from __future__ import annotations

import gc
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of a side that is broadcast (some 200 bytes a row).
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only where a local session has none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="weftline-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


class Passing(threading.local):
    """Folders handed out in a thread within ``passing``, a list for each block that is open."""

    def __init__(self) -> None:
        self.open: list[list[str]] = []


_passing = Passing()


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _passing.open:
        _passing.open[-1].append(path)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Removes a staged folder that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of what is staged by now: it does so once the driver has collected the frames."""
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What is staged within this block is removed at its end, with the shuffles it took. What stays is written to a path taken before."""
    _passing.open.append([])
    try:
        yield
    finally:
        for path in _passing.open.pop():
            discard(spark, path)
        release(spark)


def staged(df: DataFrame, name: str, packing: str = "snappy") -> DataFrame:
    """``df`` written as Parquet and read again, so that its users don't each work it out."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path, compression=packing)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame) -> DataFrame:
    """A staged side: broadcast up to ``BROADCAST_ROWS`` counted rows, beyond left to a shuffled join, where AQE splits skew."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df
