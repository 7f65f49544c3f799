"""Certified cutoffs against plain Python: proposals, holdout, exact tail, correction and choice."""

import math
import random
import zlib
from collections import defaultdict

import pytest

from weftline.llm import quality

SCHEMA = "doc_id long, stratum string, rates array<double>"
LABELS = "doc_id long, quality int, toxic int"


def tail(n: int, k: int, p: float) -> float:
    """P(Bin(n, p) <= k)."""
    chance = lambda i: math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p))
    return math.fsum(map(chance, range(k + 1)))


def quantile(values: list[float], q: float) -> float:
    values, at = sorted(values), q * (len(values) - 1)
    low, high = math.floor(at), math.ceil(at)
    return values[low] if values[low] == values[high] else (high - at) * values[low] + (at - low) * values[high]


def certified(judged: list[tuple], labels: list[tuple], alpha: float = 0.05, delta: float = 0.05) -> dict:
    """Stratum -> (level, cutoffs)."""
    known: dict = {}
    for doc, good, _ in labels:
        if doc is not None:
            known[doc] = good if known.get(doc) is None else max(known[doc], good if good is not None else known[doc])
    parts = defaultdict(lambda: ([], []))
    for doc, stratum, rates in judged:
        if known.get(doc) is not None:
            parts[stratum][zlib.crc32(str(doc).encode()) % 4 != 0].append((rates, known[doc] == 1))
    tested = []
    for stratum, (proposing, holdout) in parts.items():
        good = [[math.ceil(r * 4096) / 4096 for r in rates] for rates, ok in proposing if ok]
        if not good or not holdout:
            continue
        for level, q in enumerate(quality.LEVELS, 1):
            cutoffs = [quantile(list(column), q) for column in zip(*good, strict=True)]
            hits = [(ok, any(r > c for r, c in zip(rates, cutoffs, strict=True))) for rates, ok in holdout]
            n, bad = sum(ok for ok, _ in hits), sum(not ok for ok, _ in hits)
            k, caught = sum(ok and hit for ok, hit in hits), sum(hit and not ok for ok, hit in hits)
            tested.append((stratum, level, cutoffs, n, k, caught / max(bad, 1) - k / max(n, 1)))
    best: dict = {}
    for stratum, level, cutoffs, n, k, gain in tested:
        if gain > 0 and k < n * alpha and tail(n, k, alpha) <= delta / len(tested) and (stratum not in best or gain > best[stratum][0]):
            best[stratum] = (gain, level, cutoffs)
    return {s: b[1:] for s, b in best.items()}


def rows_of(stratum: str, first: int, good: list[float], bad: list[float]) -> tuple[list, list]:
    """Rows whose first rate is given, the others being 0, and their labels."""
    rates = [*good, *bad]
    return [(first + i, stratum, [r, 0.0, 0.0, 0.0]) for i, r in enumerate(rates)], [(first + i, int(i < len(good)), 0) for i in range(len(rates))]


@pytest.fixture(scope="module")
def made():
    rng = random.Random(3)
    low = lambda n: [rng.uniform(0, 0.1) for _ in range(n)]
    strata = {
        # Some 1.2 % of the good lie above the bad: cutoffs that let them all through catch nothing.
        "middle": (low(3952) + [rng.uniform(0.4, 0.6) for _ in range(48)], [0.3] * 300),
        "lenient": (low(2000), [0.9] * 50 + low(50)),
        "few": (low(60), [0.9] * 60),
        "alike": (low(800), low(800)),
        "none good": ([], [0.9] * 50),
    }
    judged, labels = [], []
    for i, (name, (good, bad)) in enumerate(strata.items()):
        rows, marks = rows_of(name, 10_000 * i, good, bad)
        judged, labels = judged + rows, labels + marks
    return judged, labels


def test_levels_equal_plain_python(spark, made):
    judged, labels = made
    labels = [*labels, (None, 1, 0), (99_999, 1, 0), (judged[0][0], 0, 0), (judged[0][0], None, 0)]
    rows = [*judged, (None, "middle", [0.9, 0.9, 0.9, 0.9]), (99_998, "unlabelled", [0.5] * 4)]
    want = certified(judged, labels)
    got = {r["stratum"]: (r["level"], r["cutoffs"]) for r in quality.certify(spark.createDataFrame(rows, SCHEMA).repartition(4), spark.createDataFrame(labels, LABELS)).collect()}
    assert got == {s: (level, pytest.approx(cutoffs, rel=1e-12)) for s, (level, cutoffs) in want.items()}
    assert 1 < got["middle"][0] and got["lenient"][0] < len(quality.LEVELS) and not {"few", "none good", "unlabelled"} & set(got)


def test_no_good_labels_certify_nothing(spark, made):
    judged, _ = made
    for labels in ([], [(r[0], 0, 0) for r in judged[:500]]):
        assert quality.certify(spark.createDataFrame(judged[:2000], SCHEMA), spark.createDataFrame(labels, LABELS)).count() == 0


def test_bound_holds_on_new_documents(spark, made):
    """What certified cutoffs reject among good documents that were never labelled stays below alpha."""
    judged, labels = made
    cutoffs = certified(judged, labels)
    rng = random.Random(4)
    fresh = [rng.uniform(0, 0.1) if rng.random() > 0.012 else rng.uniform(0.4, 0.6) for _ in range(20_000)]
    assert sum(r > cutoffs["middle"][1][0] for r in fresh) / len(fresh) < 0.05
