"""Continuous admission: files that arrive in a folder, each content once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import files
from ..sources.admission import entries, register, registry, unseen

BINARY = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, folder: str, store: str, checkpoint: str) -> StreamingQuery:
    """Registers new contents as ``pending``; a replayed batch adds nothing, as its hashes are known by then."""
    stream = spark.readStream.format("binaryFile").schema(BINARY).load(folder)

    def batch(found: DataFrame, _: int) -> None:
        facts = found.select("path", files.content_hash(F.col("content")).alias("content_hash"), files.file_format(F.col("content")).alias("format"), files.encoding(F.col("content")).alias("encoding"))
        fresh = unseen(facts, registry(spark, store)).join(facts, ["content_hash", "path"]).dropDuplicates(["content_hash"])
        last = entries(spark, store).agg(F.max("seq")).first()[0]
        seq = -1 if last is None else last
        for seq, r in enumerate(fresh.orderBy("path").toLocalIterator(), seq + 1):
            register(spark, store, {"content_hash": r["content_hash"], "filename": r["path"].rsplit("/", 1)[-1], "format": r["format"], "status": "pending", "encoding": r["encoding"], "seq": seq, "columns": []})

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
