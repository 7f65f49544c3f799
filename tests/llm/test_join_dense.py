"""Dense leaves: balls, differences and chunks give the links of all pairs, with leaves kept small so that every way is taken."""

import itertools
import random

from weftline.llm import jaccard_join


def grams(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def rows():
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**6)}"
    base = [word() for _ in range(120)]
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(60):  # near copies: one or two words changed
        t = base[:]
        for _ in range(rng.choice([0, 1, 1, 2])):
            t[rng.randrange(120)] = word()
        texts.append(t)
    for _ in range(40):  # a passage that many different documents share
        texts.append([word() for _ in range(50)] + passage)
    for t in texts[60:75]:  # some of which have near copies
        texts.append([*t[:20], word(), *t[21:]])
    return [(i, " ".join(t)) for i, t in enumerate(texts)] + [(900, texts[0] and " ".join(texts[0])), (901, None), (902, "")]


def test_links_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    monkeypatch.setattr(jaccard_join, "LIMIT", 8)
    found = rows()
    sets = {i: grams(t or "") for i, t in found}
    texts = {i: t or "" for i, t in found}
    linked = {i: set() for i in sets}
    for a, b in itertools.combinations(sets, 2):
        if texts[a] != texts[b] and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
            linked[a].add(texts[b])
            linked[b].add(texts[a])
    docs = spark.createDataFrame(found, "doc_id long, text string")
    got = {r["doc_id"]: r for r in jaccard_join.join_report(docs).collect()}
    assert sum(map(len, linked.values())) > 400
    assert {i: r["n_links"] for i, r in got.items()} == {i: len(x) for i, x in linked.items()}
    classes = {}
    for i in sorted(sets):
        classes.setdefault(got[i]["class_id"], set()).add(i)
    for members in classes.values():
        assert min(members) in {got[i]["class_id"] for i in members}
    by_text = {}
    for i in sorted(sets):
        by_text.setdefault(texts[i], i)
    for i, others in linked.items():
        assert all(got[by_text[t]]["class_id"] == got[i]["class_id"] for t in others)
    kept = {r["doc_id"] for r in jaccard_join.keep_one(docs).collect()}
    assert kept == set(classes)
