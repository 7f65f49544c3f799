"""The pipeline as a whole on a small corpus, each stage's output against plain Python on its input."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from test_certified_rules import certified
from weftline.llm import mixing
from weftline.llm.common import staged
from weftline.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string"
LABELS = "doc_id long, quality int, toxic int"


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def measured(text):
    """Base rule and rates of a text of ASCII letters."""
    w = words(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    twice = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    chars = max(sum(map(len, w)), 1)
    rates = [sum(c in "#*$%&|<>" for c in text or "") / chars, sum(c.isupper() for c in text or "") / chars, (len(lines) - len(set(lines))) / max(len(lines), 1), len(twice) / max(len(w), 1)]
    return len(w) < 50 or 100 * len(twice) > 50 * len(w), rates


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 8))) for _ in range(n))
    rows, labels = [], []
    for i in range(260):
        rows.append((i, text(rng.randrange(60, 160)), "aa", "rst"[i % 10 // 4]))
        labels.append((i, 1, 0))
    for i in range(260, 340):
        rows.append((i, text(80) + " #### $$$$" * 5, "aa", "s"))
        labels.append((i, 0, 0))
    rows += [(400 + i, rows[i % 5][1], "aa", None) for i in range(40)]  # exact copies
    rows += [(500 + i, " ".join([f"near{i}", *words(rows[20][1])]), "bb", "t") for i in range(6)]
    rows += [(600, None, None, None), (601, "", "aa", "s"), (602, "too short a text", "aa", "s"), (603, "again and " * 60, "bb", "r"), (None, text(70), None, "r"), (604, text(3000), "bb", "r")]
    return rows, labels


@pytest.fixture(scope="module")
def outputs(spark, corpus, tmp_path_factory):
    """Rows of every stage, as ``run`` applies them."""
    folder = tmp_path_factory.mktemp("tables")
    rows, labels = corpus
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, work in corpus_pipeline.STAGES:
        docs = staged(work(spark, docs, str(folder)), name.replace(" ", "-"))
        out[name] = [tuple(r) for r in docs.collect()]
    return out


def test_stages_are_the_dealt_ones(outputs):
    assert list(outputs) == ["quality rules", "exact dedup", "n-gram Jaccard join", "mixing sources to target weights", "best-fit packing"]


def test_quality_rules(corpus, outputs):
    rows, labels = corpus
    judged = [(doc, lang or "(none)", measured(text)[1]) for doc, text, lang, _ in rows]
    cutoffs = certified(judged, labels)
    assert set(cutoffs) == {"aa"}
    want = [r for r in rows if not measured(r[1])[0] and not any(x > c for x, c in zip(measured(r[1])[1], cutoffs.get(r[2], (0, [9.0] * 4))[1], strict=True))]
    assert Counter(outputs["quality rules"]) == Counter(want)
    # Of clean documents next to none goes; those full of symbols go, and what the base rule rejects.
    kept = {r[0] for r in want}
    assert len(kept & set(range(260))) >= 250 and not kept & {*range(260, 340), 600, 601, 602, 603}


def test_exact_dedup(outputs):
    best = {}
    for r in outputs["quality rules"]:
        if r[1] not in best or (r[0] is not None and (best[r[1]][0] is None or r[0] > best[r[1]][0])):
            best[r[1]] = r
    assert Counter(outputs["exact dedup"]) == Counter(best.values())


def test_near_copies(outputs):
    rows = sorted(outputs["exact dedup"], key=lambda r: (r[0] is None, r[0] or 0))
    grams = [frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) for w in map(words, (r[1] for r in rows))]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    want = [r for i, r in enumerate(rows) if find(i) == i]
    assert len(want) < len(rows) and Counter(outputs["n-gram Jaccard join"]) == Counter(want)


def test_mixing(outputs):
    docs, mixed = outputs["n-gram Jaccard join"], Counter(outputs["mixing sources to target weights"])
    assert set(mixed) <= set(docs) and max(mixed.values()) <= 3
    size = defaultdict(int)
    for r in docs:
        size[r[3]] += len(words(r[1]))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    for source, goal in zip(order, mixing.targets([size[s] for s in order]), strict=True):
        taken = sum(n * len(words(r[1])) for r, n in mixed.items() if r[3] == source)
        longest = max(len(words(r[1])) for r in docs if r[3] == source)
        assert abs(taken - goal) <= longest


def test_packing(outputs):
    tokenizer = Tokenizer.from_file(tokenizer_path())
    tokens = {}
    for doc, text, *_ in outputs["n-gram Jaccard join"]:
        tokens[doc] = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
    copies = Counter(r[0] for r in outputs["mixing sources to target weights"])
    pieces, sequences = Counter(), defaultdict(list)
    for doc, _piece, start, length, crc, sequence, offset in outputs["best-fit packing"]:
        ids = tokens[doc][start : start + length]
        assert len(ids) == length and zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)) == crc
        pieces[doc] += length
        sequences[sequence].append((offset, length))
    assert pieces == {doc: n * len(tokens[doc]) for doc, n in copies.items()}
    for inside in sequences.values():
        end = 0
        for offset, length in sorted(inside):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(sequences) <= 1.03 * sum(pieces.values()) / 2048 + 1
