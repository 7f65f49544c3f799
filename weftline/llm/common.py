"""Shared pieces of the text operators: staging in the shared folder, and the word pattern."""

from __future__ import annotations

import gc
import tempfile
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where the setting is absent and the session is local (tests) a temporary folder takes its place.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext.getCheckpointDir()
        if not held:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="weftline-"))
            held = spark.sparkContext.getCheckpointDir()
        found = held
    return found.rstrip("/")


class Folders(threading.local):
    """Folders handed out in a thread, oldest first: who knows that nothing reads them any more may discard them."""

    def __init__(self) -> None:
        self.made: list[str] = []


folders = Folders()


def fresh_path(spark: SparkSession, name: str) -> str:
    folders.made.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return folders.made[-1]


def staged(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = path or fresh_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Removes a staged folder of this run that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of what is staged by now: it does so once the driver has collected the frames."""
    gc.collect()
    spark._jvm.System.gc()


#: Most rows of a table with a row per language, stratum or source that is broadcast (some 100 bytes a row).
BROADCAST_FACTS = 100_000
#: A key with more than this part of all rows is hot: there are at most so many, and their rows are dealt to ``SALTS`` tasks.
HOT_PART = 512
SALTS = 64


def keys_of_rows(df: DataFrame) -> DataFrame:
    """Hint for a table of keys that grows with the rows: the rows stream past a hash of it, at every size the same way."""
    return df.hint("shuffle_hash")


def facts(df: DataFrame) -> DataFrame:
    """Hint for a staged table with a row per language, stratum or source: broadcast up to ``BROADCAST_FACTS`` counted rows."""
    return F.broadcast(df) if df.limit(BROADCAST_FACTS + 1).count() <= BROADCAST_FACTS else df.hint("shuffle_hash")


def join_hot(many: DataFrame, one: DataFrame, keys: list[str], size: str, total: int, by: str) -> DataFrame:
    """Inner join of rows with a table that has one row per key and says in ``size`` how many rows have it.

    Rows of hot keys are spread by ``by``. No more than ``HOT_PART`` keys can be hot, so their list is broadcast.
    """
    is_hot = F.col(size) * HOT_PART > total
    hot = F.broadcast(one.where(is_hot).select(*keys, F.lit(True).alias("_hot")))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(by), F.lit(SALTS))).otherwise(0).cast("int")
    many = many.join(hot, keys, "left").withColumn("_salt", salt).drop("_hot")
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return many.join(one.withColumn("_salt", F.explode(salts)).hint("shuffle_hash"), [*keys, "_salt"]).drop("_salt")


def join_listed(many: DataFrame, one: DataFrame, key: str, size: str, total: int, by: str) -> DataFrame:
    """``join_hot`` for a long key of a staged table whose sizes sum up to ``total`` at most: the hot keys, ``HOT_PART`` at most, are a list in an
    expression, so rows without a partner pass no join but the one that drops them.
    """
    listed = [k for (k,) in one.where(F.col(size) * HOT_PART > total).select(F.col(key).cast("long")).distinct().collect()]
    is_hot = F.coalesce(F.col(key).isin(listed), F.lit(False)) if listed else F.lit(False)
    salt = F.when(is_hot, F.pmod(F.xxhash64(by), F.lit(SALTS))).otherwise(0).cast("int")
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return many.withColumn("_salt", salt).join(one.withColumn("_salt", F.explode(salts)).hint("shuffle_hash"), [key, "_salt"]).drop("_salt")


#: Rows of text in an Arrow batch: bounds the buffers of a task and of its Python worker.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's rows per Arrow batch to ``BATCH_ROWS`` if it is higher."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, as a lambda's variable."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Maximal runs without white space, in order."""
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")
