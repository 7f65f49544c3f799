"""The corpus pipeline: quality rules, exact dedup, near-duplicate join, mixing, packing.

Each stage takes the documents that its predecessor kept and returns the ones it keeps, with the columns of
``documents``; the mixing stage returns a row as often as it was drawn, and the last returns packed pieces. A stage's result must be
written before the next stage is called, which removes what it had staged.

Null, empty, very long and repeated texts, ties, empty tables and further columns are treated as the operators' modules say.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import exact_dedup, jaccard_join, mixing, packing, quality
from weftline.llm.common import discard, folders, fresh_path, staged
from weftline.llm.queries import table, tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


class Spent(threading.local):
    """Folders that the thread's last stage staged; its result is written before the next stage is called."""

    def __init__(self) -> None:
        self.paths: list[str] = []


_spent = Spent()


def clear(spark: SparkSession) -> None:
    while _spent.paths:
        discard(spark, _spent.paths.pop())


def stage(work: Stage) -> Stage:
    """Removes what the stage before has staged, and notes what this one stages."""

    @wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        clear(spark)
        first = len(folders.made)
        out = work(spark, docs, sf_dir)
        _spent.paths = folders.made[first:]
        return out

    return run_stage


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the certified rules of their stratum."""
    return quality.apply_rules(docs, table(spark, sf_dir, "labels"))


@stage
def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    return exact_dedup.deduplicate(docs)


@stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group connected by word 5-gram Jaccard similarity of 0.8 or more."""
    return jaccard_join.keep_one(docs)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix draws them."""
    return mixing.mix(docs).select(docs.columns)


@stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequence and place."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Certified thresholds, seeded draws and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; a stage's result is removed as soon as that of the next is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, work in STAGES:
        out = work(spark, docs, sf_dir)
        path = fresh_path(spark, name.replace(" ", "-"))
        docs = staged(out, name, path)
        clear(spark)
        if before:
            discard(spark, before)
        before = path
    return docs
