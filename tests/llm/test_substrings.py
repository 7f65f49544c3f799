"""Repeated substrings against a plain search of all windows."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from weftline.llm import substrings


def plain(rows, size):
    """Kept words and whether words went, for each (doc_id, text)."""
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    first = {}
    for d, w in split:
        for i in range(len(w) - size + 1):
            if d is not None:
                key = tuple(w[i : i + size])
                first[key] = min(first.get(key, d), d)
    out = []
    for d, w in split:
        gone = {j for i in range(len(w) - size + 1) if d is not None and first[tuple(w[i : i + size])] < d for j in range(i, i + size)}
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def made(seed, kinds, n_docs):
    rng = np.random.default_rng(seed)
    passages = [" ".join(f"w{x}" for x in rng.integers(0, kinds, rng.integers(3, 90))) for _ in range(12)]
    rows = []
    for d in range(n_docs):
        parts = [passages[x] if rng.random() < 0.6 else " ".join(f"w{x}" for x in rng.integers(0, kinds, rng.integers(1, 40))) for x in rng.integers(0, 12, rng.integers(0, 9))]
        rows.append((int(rng.integers(0, n_docs)), "  \n".join(parts)))
    return rows


@pytest.mark.parametrize(("seed", "kinds", "size"), [(1, 5000, 50), (2, 3, 50), (3, 40, 20), (4, 1, 30)])
def test_all_windows(spark, seed, kinds, size):
    rows = made(seed, kinds, 60)
    rows += [(None, rows[3][1]), (None, None), (5, None), (6, ""), rows[7], rows[7], (1000, rows[7][1]), (1001, rows[7][1]), (-1, rows[9][1]), (1002, "x " * 3000), (1003, "x " * 500)]
    docs = spark.createDataFrame([(*r, 1, "a", 2) for r in rows], "doc_id long, text string, row int, spans string, n_words int").repartition(4)
    found = substrings.remove_repeats(docs, docs.columns, size)
    assert found.columns == [*docs.columns, "_n_words", "n_removed", "kept", "_spans"]
    got = found.collect()
    assert Counter((r["doc_id"], r["_n_words"], r["n_removed"], r["kept"]) for r in got) == Counter(plain(rows, size))
    texts = {}
    for d, t in rows:
        texts.setdefault(d, []).append((t or "").split())
    for r in got:  # every span stands at its source, in a document with a smaller id
        own = (r["text"] or "").split()
        for s in r["_spans"]:
            words = own[s["start"] : s["start"] + s["n_words"]]
            assert s["first_doc"] < r["doc_id"] and len(words) == s["n_words"] >= size
            assert any(t[s["first_start"] : s["first_start"] + s["n_words"]] == words for t in texts[s["first_doc"]])


def test_long_copies_are_one_span(spark):
    text = " ".join(hashlib.md5(str(i).encode()).hexdigest() for i in range(2000))
    other = " ".join(str(i) for i in range(300))
    docs = spark.createDataFrame([(1, text), (2, f"{other} {text} {other}"), (3, text), (4, other)], "doc_id long, text string")
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in substrings.remove_repeats(docs, ["doc_id"]).collect()}
    assert got == {1: [], 2: [(300, 2000, 1, 0)], 3: [(0, 2000, 1, 0)], 4: [(0, 300, 2, 0)]}


def test_empty_table(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string"), ["doc_id"]).count() == 0
