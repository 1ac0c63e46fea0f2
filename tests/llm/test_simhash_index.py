"""The near-dedup stage's candidates: SimHash of shingle sets and its index."""

import random
from itertools import combinations

import numpy as np

from lexmill.llm import neardup
from lexmill.llm.components import Forest
from tests.llm.test_neardup import near


def test_similar_sets_differ_within_the_bound():
    rng = np.random.default_rng(3)
    share = neardup._differing(0.8)
    apart = []
    for n in (18, 90, 600):
        for _ in range(60):
            both, a, b = (rng.integers(0, 2**63, k, dtype=np.uint64) for k in (8 * n // 9, n // 9, n // 9))
            x, y = (neardup.fingerprint(np.concatenate((both, own))) for own in (a, b))
            apart.append(int(np.bitwise_count(x ^ y)[: neardup.COMPARED].sum()))
    assert abs(np.mean(apart) / (64 * neardup.COMPARED) - share) < 0.02 and max(apart) <= neardup.bound(0.8)
    a, b = (neardup.fingerprint(rng.integers(0, 2**63, 200, dtype=np.uint64)) for _ in range(2))
    assert np.bitwise_count(a ^ b)[: neardup.COMPARED].sum() > neardup.bound(0.8)
    assert not neardup.fingerprint(np.empty(0, np.uint64)).any()


def test_node_links_are_those_of_all_pairs(monkeypatch):
    monkeypatch.setattr(neardup, "TREE", 40)
    rng = np.random.default_rng(4)
    node = np.sort(np.concatenate((rng.integers(0, 9, 150), np.full(200, 9), [10], rng.integers(11, 400, 200))))
    fps = rng.integers(0, 2**63, (len(node), neardup.COMPARED), dtype=np.uint64)
    for i in range(0, len(node) - 1, 3):
        fps[i + 1] = fps[i] ^ rng.integers(0, 2, neardup.COMPARED, dtype=np.uint64) * np.uint64(2**40 - 1)
    fps[node == 9] = np.where(rng.random((200, 1)) < 0.2, fps[node == 9][0], fps[node == 9])
    want = Forest(len(node))
    for i in range(len(node)):
        j = np.flatnonzero((node == node[i]) & (np.bitwise_count(fps ^ fps[i]).sum(axis=1) <= 73))
        want.link(np.full(len(j), i), j)
    assert np.array_equal(neardup.link_rows(node, fps, 73).label, want.label)


def test_similar_sets_are_in_one_component(spark):
    rng = random.Random(5)
    texts = ["a b c d e f g h", "a b c d e f g h i", "x y", ""]
    for _ in range(60):
        w = [f"w{rng.randrange(9999)}" for _ in range(rng.choice([12, 80, 300]))]
        texts.append(" ".join(w))
        for at in rng.sample(range(len(w)), len(w) // 50):
            w[at] = "z"
        texts.append(" ".join([*w, "end"]))
    rows = [(i, *[int(h) if k == 0 else h for k, h in enumerate([len(s), neardup.fingerprint(s).view(np.int64).tolist(), neardup.short_keys(s)])]) for i, s in enumerate(neardup.shingles(t, 5) for t in texts)]
    links = neardup.link_sets(spark.createDataFrame(rows, "s1 long, n long, fp array<long>, short array<long>"), 0.8).collect()
    forest = Forest(len(texts))
    forest.link(np.array([r.u for r in links]), np.array([r.v for r in links]))
    pairs = [(i, j) for i, j in combinations(range(len(texts)), 2) if near(texts[i], texts[j])]
    assert len(pairs) > 50 and all(forest.label[i] == forest.label[j] for i, j in pairs)
    # unlike texts stay apart
    assert len(set(forest.label.tolist())) > 60
