"""Nulls in any column, empty and long texts, repeated rows, clashing extra columns, empty tables."""

import pytest

from weftline.llm import exact_dedup, jaccard_join, language, line_dedup, mixing, packing, periodic, quality, secrets, sharding, substrings, token_files
from weftline.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kept boolean, h long, stratum string, line_no int, `group` long, times int, shard int"
MORE = (7, True, 5, "x", 1, 2, 3, 4)
LONG = "a very long text with words that go on and on \n" * 4000
CLEAN = " ".join(f"word{i} goes" for i in range(60))
ROWS = [
    (1, None, None, None, None, *MORE),
    (None, CLEAN, "aa", None, 3, *MORE),
    (2, "", "aa", "s", 0, *MORE),
    (2, "", "aa", "s", 0, *MORE),
    (3, LONG, None, "s", 9, *MORE),
    (4, CLEAN, "bb", "t", None, *MORE),
    (4, CLEAN, "bb", "t", None, *MORE),
    (5, "é\U0001f600 \n\n é\U0001f600", "bb", "t", 1, *MORE),
]
LABELS = "doc_id long, quality int, toxic int"


def reports(docs, labels):
    path = tokenizer_path()
    return {
        "secrets": lambda: secrets.report(docs),
        "language": lambda: language.train_and_identify(docs),
        "join": lambda: jaccard_join.join_report(docs),
        "shards": lambda: sharding.assign_shards(docs, 24),
        "dedup": lambda: exact_dedup.classes(docs),
        "packing": lambda: packing.pack(docs, path),
        "quality": lambda: quality.quality_report(docs, labels),
        "mixing": lambda: mixing.report(docs),
        "lines": lambda: line_dedup.line_report(docs),
        "tokens": lambda: token_files.round_trip(docs, path),
        "runs": lambda: periodic.run_digests(periodic.find_runs(docs, ["doc_id"])),
        "substrings": lambda: substrings.kept_digest(substrings.remove_repeats(docs, ["doc_id"])),
    }


NAMES = ["secrets", "language", "join", "shards", "dedup", "packing", "quality", "mixing", "lines", "tokens", "runs", "substrings"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, docs, name):
    labels = spark.createDataFrame([(4, 1, 0), (None, 1, None), (5, None, None)], LABELS)
    got = reports(docs, labels)[name]().collect()
    assert {r["doc_id"] for r in got} == {1, 2, 3, 4, 5, None}
    assert len(got) >= len(ROWS) if name == "packing" else len(got) == len(ROWS)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, name):
    assert reports(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS))[name]().count() == 0


def test_stages_keep_columns(spark, docs):
    labels = spark.createDataFrame([], LABELS)
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns and kept.count() == 4
    assert quality.apply_rules(docs, labels).columns == docs.columns
    assert line_dedup.clean(docs).columns == docs.columns
    near = jaccard_join.keep_one(docs)
    assert near.columns == docs.columns
    mixed = mixing.mix(docs)
    assert mixed.columns[: len(docs.columns)] == docs.columns


def test_ledger_scans_only_what_is_new(spark):
    key = "token=" + "A1" * 5
    first = spark.createDataFrame([(1, key), (2, "nothing")], "doc_id long, text string")
    ledger = secrets.BlobLedger(spark)
    secrets.report(first, ledger).collect()
    before = ledger.entries().count()
    later = first.unionByName(spark.createDataFrame([(3, key), (4, "secret: abcdef1")], first.schema))
    got = {r["doc_id"]: r["n_assign"] for r in secrets.report(later, ledger).collect()}
    assert got == {1: 1, 2: 0, 3: 1, 4: 1} and ledger.entries().count() == before + len(secrets.RULES)


def test_collisions_are_told_apart_by_bytes(spark):
    rows = spark.createDataFrame([(i, f"text {i % 7}") for i in range(70)], "doc_id long, text string").repartition(5)
    got = exact_dedup.classes(rows, hash_bits=1, bucket_bytes=64).collect()
    assert all(r["keep_id"] == 63 + r["doc_id"] % 7 and r["group_size"] == 10 for r in got)


def test_clashing_names_keep_their_values(spark):
    """Columns named as the stages' own stay as they are, value by value."""
    names = ["_rid", "_shard", "_at", "_p", "_place", "judged", "judged_s", "judged_c", "_m", "uid", "row"]
    rows = [(i, f"{CLEAN} number {i}", "aa", "st"[i % 2], *[f"{n} of {i}" for n in names]) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` string" for n in names)).repartition(3)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)], LABELS)
    whole = {r[0]: r for r in rows}
    for kept in (quality.apply_rules(docs, labels), exact_dedup.deduplicate(docs), jaccard_join.keep_one(docs), mixing.mix(docs).select(docs.columns)):
        got = [tuple(r) for r in kept.select(docs.columns).collect()]
        assert got and all(r == whole[r[0]] for r in got)
    assert mixing.mix(docs).columns[-2:] == ["__shard", "__place"]
