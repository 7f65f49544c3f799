"""A linked pair among unrelated members is counted in its first common leaf only."""

import numpy as np
import pyarrow as pa

from weftline.llm.jaccard_join import verifier


def links(leaf, members):
    """Of members (rid, leaves, set)."""
    n = len(members)
    rids, mine, sets = zip(*members, strict=True)
    batch = pa.record_batch(
        [pa.array([leaf] * n), pa.array([0] * n), pa.array([0] * n), pa.array(rids), pa.array([0] * n), pa.array([1] * n), pa.array(rids), pa.array(mine, pa.list_(pa.int64())), pa.array(sets, pa.list_(pa.int64()))],
        names=["leaf", "a", "b", "rid", "chunk", "weight", "node", "mine", "set"],
    )
    return [r for b in verifier(0.8)(iter([batch])) for r in b.to_pylist()]


def test_pair_among_unrelated_members():
    a = list(range(100))
    b = list(range(95)) + [1000]
    c, d = [*range(2000, 2100), 5], [*range(3000, 3100), 5]
    members = [(1, [10, 20], a), (2, [10, 20], b), (3, [20], c), (4, [20], d)]
    assert links(20, members) == []
    first = links(10, members[:2])
    assert [(r["rid"], r["links"], r["root"]) for r in first] == [(1, 1, 1), (2, 1, 1)]


def test_new_pair_stays():
    rng = np.random.default_rng(1)
    base = sorted(rng.integers(0, 1 << 40, 50).tolist())
    members = [(1, [10, 20], base), (2, [20], base[:48]), (3, [10, 20], list(range(7)))]
    assert [(r["rid"], r["links"]) for r in links(20, members)] == [(1, 1), (2, 1)]
