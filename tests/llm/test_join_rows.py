"""Rows that homes make on their way: tokens for each block of records, differences as many as the recall asks for."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.llm import jaccard_join


def test_middles_take_rows_of_blocks(spark):
    """A home of 1,000 near copies: some 60 tokens for each of its blocks, not for each record; the middle is the copied text."""
    rng = random.Random(3)
    base = list(range(60))
    rows = [(i, 7, [rng.randrange(10**6, 10**9) if rng.random() < 0.05 else x for x in base]) for i in range(1000)]
    own = spark.createDataFrame(rows, "rid long, home long, set array<long>")
    sizes = own.groupBy("home").agg(F.count("*").alias("members"))
    votes = jaccard_join.votes(own, sizes, 1000)
    assert {r["token"]: r["n"] for r in votes.collect()} == dict.fromkeys(base, 1000)
    told = spark.createDataFrame([(7, 0, x) for x in ([1, 2], [1, 3], [1, 2], [5])], "home long, block long, set array<long>").coalesce(1)
    assert [tuple(r) for r in told.mapInArrow(jaccard_join.majorities, "home long, held long, tokens array<long>").collect()] == [(7, 4, [1])]


def test_samples_as_many_as_needed(spark):
    """140 tokens, 130 of them not the middle's: 11 samples. A difference that is small against the set takes all of them."""
    runs = [spark.range(1).select(jaccard_join.difference_runs(F.lit(n), F.lit(d), 0.8)).first()[0] for n, d in ((140, 130), (140, 145), (100, 200), (100, 50), (100, 20), (100, 36), (10, 10**6))]
    assert runs == [11, 10, 7, 20, 32, 32, 2]
    for n, d in ((140, 130), (100, 200), (100, 50)):
        k = spark.range(1).select(jaccard_join.difference_runs(F.lit(n), F.lit(d), 0.8)).first()[0]
        assert (0.25 * n / d) ** k <= 1e-6 * (1 + 1e-6) < (0.25 * n / d) ** (k - 1)


@pytest.mark.parametrize("threshold", [0.6, 0.8, 0.95])
def test_differences_of_linked_records_are_alike(threshold):
    """The bound on which ``difference_runs`` rests, on random sets around random middles."""
    rng = random.Random(9)
    for _ in range(3000):
        middle = set(rng.sample(range(60), rng.randrange(0, 40)))
        a = set(rng.sample(range(60), rng.randrange(5, 50)))
        b = set(a)
        for x in rng.sample(range(60), rng.randrange(0, 12)):
            b ^= {x}
        if not b or len(a & b) < threshold * len(a | b):
            continue
        one, other = a ^ middle, b ^ middle
        if one | other:
            for x, d in ((a, one), (b, other)):
                if d:
                    assert len(one & other) / len(one | other) >= 1 - (1 - threshold) / threshold * len(x) / len(d) - 1e-9


def test_listed_keys_join_like_others(spark):
    """A hot key, others, keys without a partner and null: the rows of a plain join, without an outer join of all rows."""
    many = spark.createDataFrame([(5, i) for i in range(3000)] + [(i, i) for i in range(2000, 2400)] + [(None, 1)], "leaf long, rid long")
    one = many.groupBy("leaf").agg(F.count("*").alias("size")).where("leaf is not null and leaf % 2 = 1")
    got = jaccard_join.join_listed(many, one, "leaf", "size", many.count(), "rid")
    assert sorted(got.select("leaf", "rid", "size").collect()) == sorted(many.join(one, "leaf").select("leaf", "rid", "size").collect())
    assert "LeftOuter" not in got._jdf.queryExecution().toString()
