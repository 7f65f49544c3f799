"""Bucket files split, the directory doubles, and classes stay those of equal texts."""

from collections import defaultdict

from weftline.llm import exact_dedup
from weftline.llm.common import fresh_path

ROWS = [(i, f"text number {i % 40} " + "x" * (i % 40)) for i in range(200)] + [(900, None), (901, "")]


def expected():
    groups = defaultdict(list)
    for i, text in ROWS:
        groups[text or ""].append(i)
    return {i: (max(groups[t or ""]), len(groups[t or ""])) for i, t in ROWS}


def test_buckets_split(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    path = fresh_path(spark, "index")
    pages = docs.selectExpr("doc_id", "xxhash64(coalesce(text, '')) as hash", "'' as text_sha256", "cast(coalesce(text, '') as binary) as text").mapInArrow(exact_dedup.combiner(1 << 20, False), exact_dedup.INDEX)
    index = exact_dedup.Index(pages, path, 0, 400)  # no bytes foreseen: one bucket at first
    found = index.directory().collect()
    assert index.depths[0] == 0 and len(index.depths) > 1
    assert {r["depth"] for r in found} <= set(index.depths) and max(r["generation"] for r in found) > 0
    # The directory's buckets cover every hash once.
    assert sum(2.0 ** -r["depth"] for r in found) <= 1
    got = {r["uid"] for r in index.owned(False, "uid long, keep_id long, group_size long, keep_rid long").collect()}
    assert len(got) == index.generation(0).where("bucket >= 0").count()


def test_classes_over_splits_and_chains(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(4)
    for size, bits in ((400, 64), (100, 2), (1 << 25, 64)):
        got = exact_dedup.classes(docs, hash_bits=bits, bucket_bytes=size).collect()
        assert {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in got} == expected()
        assert {r["doc_id"] for r in got if r["kept"]} == {k for k, _ in expected().values()}


def test_rows_that_stay_are_whole(spark):
    rows = [(i, t, {"a": i}, i % 3 == 0) for i, t in ROWS]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row map<string,long>, none boolean")
    got = exact_dedup.deduplicate(docs, bucket_bytes=400)
    assert got.columns == docs.columns
    want = {r[0]: r for r in rows if r[0] in {k for k, _ in expected().values()}}
    assert {r["doc_id"]: (r["doc_id"], r["text"], r["row"], r["none"]) for r in got.collect()} == want


def test_settings_of_the_session_change_nothing(spark):
    """Files of 5 records, row groups of a few rows and tiny splits would tear buckets apart."""
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(4)
    conf, hadoop = {"spark.sql.files.maxRecordsPerFile": "5", "spark.sql.files.maxPartitionBytes": "2k", "spark.sql.files.openCostInBytes": "1"}, {"parquet.block.size": "600", "parquet.block.row.count.limit": "3"}
    before = {k: spark.conf.get(k) for k in conf}
    held = spark._jsc.hadoopConfiguration()
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        for k, v in hadoop.items():
            held.set(k, v)
        for size in (400, 1 << 25):
            got = exact_dedup.classes(docs, bucket_bytes=size).collect()
            assert {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in got} == expected()
            assert {r["doc_id"] for r in exact_dedup.deduplicate(docs, bucket_bytes=size).collect()} == {k for k, _ in expected().values()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        for k in hadoop:
            held.unset(k)


def test_buckets_in_several_files_are_dealt_by_hash(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "ONE_FILE", {"maxRecordsPerFile": 3})
    got = exact_dedup.classes(spark.createDataFrame(ROWS, "doc_id long, text string").repartition(4)).collect()
    assert {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in got} == expected()
