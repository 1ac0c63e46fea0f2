"""The pipeline's near-dedup stage against all pairs."""

import random

import pytest

import corpus_pipeline
from lexmill.llm import neardup


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def near(a, b):
    a, b = shingles(a), shingles(b)
    return a == b or len(a & b) >= 0.8 * len(a | b)


@pytest.mark.parametrize("small", [16, 2])
def test_stage_drops_near_copies_and_nothing_else(spark, monkeypatch, small):
    monkeypatch.setattr(neardup, "SMALL", small)
    rng = random.Random(8)
    rows = []
    for g in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(60, 300))]
        for _ in range(rng.choice([1, 3, 25])):
            w = list(base)
            for _ in range(rng.randint(0, len(w) // 30)):
                w[rng.randrange(len(w))] = f"z{rng.randrange(9999)}"
            rows.append((len(rows), " ".join(w), "en"))
    rows += [(900, "a b", "en"), (901, "a b", "en"), (902, "b a", "en"), (903, "", "en"), (904, None, "en"), (None, rows[0][1], "en"), (None, "x y z", "en")]
    # rows of one id: unrelated texts are two documents, equal ones are one
    rows += [(3, " ".join(f"u{k}" for k in range(80)), "en"), (1, rows[1][1], "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __th string")
    out = corpus_pipeline.dedup_documents(spark, docs, "")
    assert out.columns == docs.columns
    kept = [tuple(r) for r in out.collect()]
    assert len(kept) == len(set(kept)) and set(kept) <= set(rows)
    assert not [1 for i, a in enumerate(kept) for b in kept[:i] if near(a[1], b[1])]
    early = lambda r: (r[0] is None, r[0] or 0)
    for r in set(rows) - set(kept):
        assert any(near(r[1], b[1]) and early(b) <= early(r) for b in rows if b is not r and b != r)
    assert rows[-2] in kept
    assert corpus_pipeline.dedup_documents(spark, docs.where("1 = 0"), "").count() == 0
