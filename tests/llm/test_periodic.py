"""Runs by the grid of hashes against every period of every stretch; the contract's rows against plain Python."""

import hashlib
import re
import zlib
from itertools import chain, repeat

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import periodic
from weftline.llm.queries import QUERIES


def plain_runs(w, least):
    """Maximal stretches by period; of equal stretches the least period."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        s = 0
        while s + q < len(w):
            e = s
            while e + q < len(w) and w[e] == w[e + q]:
                e += 1
            if e + q - s >= max(least, 2 * q):
                found.setdefault((s, e + q), q)
            s = e + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def grid_runs(texts, least, seeds=None):
    codes = np.array([c for t in texts for c in t], np.int64)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    runs = periodic.runs_of(codes, bounds, least, seeds)
    owner = np.searchsorted(bounds, runs[:, 0], "right") - 1
    out = [[] for _ in texts]
    for i, (s, e, q) in zip(owner.tolist(), runs.tolist()):
        out[i].append((s - int(bounds[i]), e - s, q))
    return [sorted(x) for x in out]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.lists(st.integers(0, 1), max_size=60), st.lists(st.integers(0, 3), max_size=6).map(lambda x: x * 9)), max_size=5), st.sampled_from([3, 6, 12]))
def test_any_texts(texts, least):
    assert grid_runs(texts, least) == [plain_runs(t, least) for t in texts]


def test_portions_and_long_texts(monkeypatch):
    monkeypatch.setattr(periodic, "PAIRS", 50)
    fibonacci = [0], [0, 1]
    while len(fibonacci[1]) < 300:
        fibonacci = fibonacci[1], fibonacci[1] + fibonacci[0]
    texts = [fibonacci[1], [5] * 400, [], [1], list(range(90)) * 4 + [7]]
    assert grid_runs(texts, 12) == [plain_runs(t, 12) for t in texts]


def test_mistaken_hashes_are_done_again(monkeypatch):
    true = periodic.Hashes.equal
    seen = []

    def first_lies(self, a, b, length):
        return np.ones(len(a), bool) if self.lies else true(self, a, b, length)

    make = periodic.Hashes.__init__

    def noted(self, codes, seed):
        make(self, codes, seed)
        seen.append(seed)
        self.lies = seed == 0

    monkeypatch.setattr(periodic.Hashes, "__init__", noted)
    monkeypatch.setattr(periodic.Hashes, "equal", first_lies)
    text = [0, 1, 2, 3, 0, 1, 5, 6, 0, 1, 2] + [8, 9] * 8
    assert grid_runs([text], 12, chain([0, 1], repeat(2))) == [plain_runs(text, 12)] and seen == [0, 1]


def digest(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w, 12)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    listed = "".join(f"{s},{size},{q}\n" for s, size, q in sorted(runs, key=lambda r: (r[0], r[2])))
    return doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2], sha(listed), sha(" ".join(x for i, x in enumerate(w) if i not in gone))


def test_query(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    want = {r["doc_id"]: digest(*r) for r in rows if len(r["text"] or "") < 12000}
    got = {r["doc_id"]: tuple(r) for r in QUERIES["op12_harmonic_runs"](spark, small).collect()}
    assert len(got) == len(rows) and {k: got[k] for k in want} == want
    assert any(x[1] for x in want.values())


def test_text_is_shortened_and_columns_stay(spark):
    rows = [(1, "a b " * 7 + "c", "x", 5), (None, None, "y", None), (1, "a b " * 7 + "c", "x", 5), (2, "no  repeats here", None, 1), (3, "", "z", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words int")
    got = periodic.without_repeats(docs)
    assert got.columns == docs.columns
    want = [(None, None, "y", None), (1, "a b c", "x", 5), (1, "a b c", "x", 5), (2, "no  repeats here", None, 1), (3, "", "z", 2)]
    assert [tuple(r) for r in got.orderBy("doc_id", "runs").collect()] == want


def test_least_below_three():
    with pytest.raises(ValueError):
        periodic.runs_of(np.zeros(4, np.int64), np.array([0, 4]), 2)
