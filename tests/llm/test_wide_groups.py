"""Near-dedup of groups whose texts share passages but aren't similar: what becomes rows, pairs and moved texts."""

import random

import numpy as np

from lexmill.llm import neardup
from tests.llm.test_neardup import near


def test_a_small_set_of_the_group_makes_no_other_emit_more(spark):
    schema = "g long, s1 long, s2 long, ord struct<doc_id:long>, n long, d array<long>, e double"
    rows = [(1, i, i, {"doc_id": i}, 90, list(range(90)), 80.0) for i in range(3)] + [(1, 9, 9, {"doc_id": 9}, 9, list(range(9)), 8.0)]
    made, write = [], neardup.written
    try:
        neardup.written = lambda df, tag: made.append(df) or write(df, tag)
        neardup._by_difference(spark.createDataFrame(rows, schema)).count()
    finally:
        neardup.written = write
    # a set of 90 differs in 22 shingles at most from a similar one: 23 of its differences tell; of the set of 9 it is 2
    assert made[0].count() == 3 * 23 + 2


def test_parity_never_differs_in_more_bits_than_the_sets_do():
    rng = np.random.default_rng(5)
    for n in (0, 1, 30, 3000):
        both, a, b = (np.unique(rng.integers(0, 2**63, k, dtype=np.uint64)) for k in (n, n // 4, n // 8))
        x, y = (neardup.parity(np.concatenate((both, own))) for own in (a, b))
        assert len(x) == neardup.PARITY and np.bitwise_count(x ^ y).sum() <= len(a) + len(b)
    assert not neardup.parity(np.empty(0, np.uint64)).any()


def test_only_pairs_that_can_be_similar_are_read(spark, monkeypatch):
    rng = random.Random(2)
    passages = [[f"p{k}x{i}" for i in range(40)] for k in range(6)]
    texts = [sum((passages[k] for k in sorted(rng.sample(range(6), 4))), []) + [f"o{rng.randrange(10**6)}" for _ in range(6)] for _ in range(120)]
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    seen, similar = [], neardup._similar
    monkeypatch.setattr(neardup, "_similar", lambda pairs, sets, t: seen.append(pairs.distinct().count()) or similar(pairs, sets, t))
    kept = {r.doc_id for r in neardup.dedup_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = {i: {j for j, b in rows if j != i and near(a, b)} for i, a in rows}
    assert not [i for i in kept if linked[i] & kept] and not [i for i in linked if i not in kept and not any(j < i for j in linked[i])]
    assert seen[0] <= sum(map(len, linked.values())) // 2 + 20


def test_asked_finds_all_rows_and_no_others(spark, monkeypatch):
    rows = spark.createDataFrame([(i if i else None, 7 * i, f"t{i}") for i in range(200)] + [(5, 1, "other")], "doc_id long, th long, text string")
    of = spark.createDataFrame([(None, 0, 1), (5, 35, 2), (199, 1393, 3), (4, 29, 4)], "of_id long, of_th long, s1 long")
    for places in (neardup.PLACES, 64):
        monkeypatch.setattr(neardup, "PLACES", places)
        assert {(r.text, r.s1) for r in neardup._asked(rows, of).collect()} == {("t0", 1), ("t5", 2), ("t199", 3)}
