"""The splitting tree and the local shuffle decide what op8 and the mixing stage give."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import mixing


@pytest.fixture(scope="module")
def docs(spark):
    sources = ["a"] * 300 + ["b"] * 60 + ["c"] * 10 + [None] * 90
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(5 + i % 40)), s) for i, s in enumerate(sources)]
    rows += [(1000, "twice the very same row", "b")] * 5
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)


def test_taken_counts_what_the_tree_places(spark, docs, monkeypatch):
    got = mixing.report(docs).collect()
    assert len(got) == docs.count() and len({s for r in got for s in r["shards"].split(",") if s}) > 1
    for r in got:
        shards = [int(s) for s in r["shards"].split(",") if s]
        assert r["taken"] == r["size"] * len(shards) and shards == sorted(shards) and all(0 <= s < mixing.LEAST_SHARDS for s in shards)
    monkeypatch.setattr(mixing, "split_tree", lambda quotas, shards, seed: np.zeros((shards, len(quotas)), np.int64))
    assert all(r["taken"] == 0 for r in mixing.report(docs).collect())


def test_mix_deals_and_orders_rows(spark, docs, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 200)
    want, key = Counter(), defaultdict(set)
    for r in mixing.report(docs).collect():
        for s in filter(None, r["shards"].split(",")):
            want[r["doc_id"], int(s)] += 1
    mixed = mixing.mix(docs).withColumn("part", F.spark_partition_id()).collect()
    assert Counter((r["doc_id"], r["_shard"]) for r in mixed) == want
    places = defaultdict(list)
    for r in mixed:
        key[r["_shard"]].add(r["part"])
        places[r["_shard"]].append(r["_place"])
    assert len(key) > 1 and all(len(parts) == 1 for parts in key.values())
    assert all(own == sorted(own) for own in places.values())


def test_every_pass_has_its_own_blocks(spark):
    rows = spark.range(200).select(F.col("id").alias("doc_id"), F.lit(1).alias("crc"), F.lit(50).alias("blocks"))
    both = rows.select(mixing.in_pass(17, F.lit(0))[1].alias("a"), mixing.in_pass(17, F.lit(1))[1].alias("b")).collect()
    assert sum(r["a"] == r["b"] for r in both) < 30


def test_sums_by_stretches_and_subtrees(spark, docs, monkeypatch):
    """Small stretches and subtrees change where sums are made: the drawn rows are the same, and every drawn block has one shard."""
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 100)
    want = {(r["rid"], r["doc_id"], r["times"]) for r in mixing.draw(docs).collect()}
    monkeypatch.setattr(mixing, "STRETCH", 3)
    monkeypatch.setattr(mixing, "SUBTREE", 2)
    drawn = mixing.staged(mixing.draw(docs), "mix-test")
    assert {(r["rid"], r["doc_id"], r["times"]) for r in drawn.collect()} == want
    got = mixing.placed(drawn, shards=12).collect()
    assert Counter(r["rid"] for r in got) == Counter({rid: n for rid, _, n in want if n})
    assert {r["shard"] for r in got} == set(range(12))


def test_running_sums(spark, monkeypatch):
    monkeypatch.setattr(mixing, "STRETCH", 4)
    rows = [(s, at, (at * 7) % 5) for s in (1, 2) for at in range(0, 40, s)]
    got = mixing.running_sums(spark.createDataFrame(rows, "sid int, at long, n long"), "at", F.col("n"), "before").collect()
    assert {(r["sid"], r["at"], r["before"]) for r in got} == {(s, at, sum(n for s2, a, n in rows if s2 == s and a < at)) for s, at, _ in rows}


def test_many_sources_are_joined_alike(spark, docs, monkeypatch):
    want = Counter(tuple(r) for r in mixing.report(docs).collect())
    monkeypatch.setattr(mixing, "BROADCAST_FACTS", 2)
    assert Counter(tuple(r) for r in mixing.report(docs).collect()) == want
