"""The queries with SQL against it on the smallest table, and line dedup where rows share a doc_id or a line is long."""

from collections import Counter

import duckdb
import pytest

from weftline.llm import line_dedup
from weftline.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", list(ORACLES))
def test_sql(spark, small, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "labels"):
        con.execute(f"create view {table} as select * from '{small}/{table}.parquet'")
    found = con.execute(ORACLES[name])
    names = [c[0] for c in found.description]
    got = QUERIES[name](spark, small)
    assert sorted(got.columns) == sorted(names)
    assert Counter(map(tuple, got.select(*names).collect())) == Counter(found.fetchall())


def test_rows_that_share_a_doc_id(spark):
    long = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(3000))
    rows = [(1, long), (2, long[:1000] + "?" + long[1001:]), (2, "another line\nsome more words"), (None, "first of null"), (None, "x" * 30 + "\nanother line"), (3, "another line"), (3, "another line"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup.line_report(docs).collect()
    assert len(got) == len(rows) and all(min(r["n_kept"], r["n_exact"], r["n_near"]) >= 0 for r in got)
    counts = Counter((r["doc_id"], r["n_lines"], r["n_kept"], r["n_exact"], r["n_near"]) for r in got)
    # Null comes first, so its line stays and those of 2 and 3 go; the long line of 2 is near that of 1.
    assert counts == Counter({(None, 1, 1, 0, 0): 1, (None, 2, 2, 0, 0): 1, (1, 1, 1, 0, 0): 1, (2, 1, 0, 0, 1): 1, (2, 2, 1, 1, 0): 1, (3, 1, 0, 1, 0): 2, (4, 0, 0, 0, 0): 1})
    cleaned = Counter((r["doc_id"], r["text"]) for r in line_dedup.clean(docs).collect())
    assert cleaned == Counter({(None, rows[3][1]): 1, (None, rows[4][1]): 1, (1, long): 1, (2, ""): 1, (2, "some more words"): 1, (3, ""): 2, (4, None): 1})


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_near_lines_by_edit_distance(spark):
    base = ["abcdefghijkl", "aaaaaaaaaaaa", "é\U0001f600 twelve signs"]
    lines = list(dict.fromkeys(v for b in base for i in range(len(b)) for v in (b, b[:i] + b[i + 1 :], b[:i] + "x" + b[i + 1 :], b[:i] + "xy" + b[i:])))
    got = {r["doc_id"]: r["n_near"] for r in line_dedup.line_report(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()}
    assert got == {i: int(len(a) >= 10 and any(len(b) >= 10 and edits(a, b) <= 1 for b in lines[:i])) for i, a in enumerate(lines)}
