"""Near-dedup of large buckets: pairs by their differences from a centre, against all pairs."""

import random

import pytest

from lexmill.llm import neardup
from tests.llm.test_neardup import near


def edited(rng, words, k, fresh):
    w = list(words)
    for at in rng.sample(range(len(w)), k):
        w[at] = f"{fresh}{rng.randrange(10**6)}"
    return w


@pytest.mark.parametrize("small", [16, 3])
def test_groups_within_groups_and_common_passages(spark, monkeypatch, small):
    monkeypatch.setattr(neardup, "SMALL", small)
    rng = random.Random(small)
    base = [f"b{k}" for k in range(150)]
    texts = [edited(rng, base, rng.randrange(12), "x") for _ in range(140)]
    # two versions of the base, each with a group of its own: their differences from the base are shared by many
    for v in ("p", "q"):
        version = edited(rng, base, 9, v)
        texts += [edited(rng, version, rng.randrange(6), "y") for _ in range(60)]
    # a passage that is most of many texts, but not 0.8 of them
    texts += [base[:100] + [f"z{rng.randrange(10**6)}" for _ in range(30)] for _ in range(40)]
    texts += [[f"f{rng.randrange(10**6)}" for _ in range(120)] for _ in range(10)]
    rng.shuffle(texts)
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    kept = {r.doc_id for r in neardup.dedup_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = {i: {j for j, b in rows if j != i and near(a, b)} for i, a in rows}
    assert not [i for i in kept if linked[i] & kept]
    assert not [i for i in linked if i not in kept and not any(j < i for j in linked[i])]
    assert len(kept) < len(rows)
