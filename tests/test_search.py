"""Pricing on few diagonals, harmony without trying all variants, and word errors by bits: against the plain way."""

import random
import time

from pyspark.sql import functions as F

from lexmill.functions import distance as D
from lexmill.functions import rules as R
from lexmill.operators import candidates as C
from lexmill.operators import evaluation as V


def test_costs_within_a_bound():
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("аҕгөоһсйцу") for _ in range(rng.randint(0, n)))
    pairs = [(word(7), word(7)) for _ in range(3000)]
    pairs += [(w, "".join(c if rng.random() > 0.15 else rng.choice("гоү") for c in w)) for w in (word(40) for _ in range(500))]
    a, b = map(list, zip(*pairs, strict=True))
    for most in (150, 220):
        want, got = D.distances(a, b), D.distances_within(a, b, most)
        assert [g if g <= most else None for g in got.tolist()] == [w if w <= most else None for w in want.tolist()]
        assert sum(want <= most) > 100
    assert D.distances_within([], [], 220).tolist() == [] and D.distances_within(["аб" * 3000], ["аб" * 2999 + "а"], 220).tolist() == [100]


def test_pricing_takes_less_time():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("аҕгөоһсйцу") for _ in range(rng.randint(5, 16)))
    a, b = [word() for _ in range(5000)], [word() for _ in range(5000)]
    D.distances_within(a[:9], b[:9], 220)
    began = time.perf_counter()
    D.distances(a, b)
    middle = time.perf_counter()
    D.distances_within(a, b, 220)
    assert time.perf_counter() - middle < (middle - began) / 2


def test_first_harmonic_variant(spark):
    rng = random.Random(8)
    words = {"".join(rng.choice("оуоуаэиөүыкнгсх-") for _ in range(rng.randint(2, 9))) for _ in range(400)} | {"тyлорo", "кyноy", "нугунунугунэ", "огуогуогуогуогуэ"}
    rows = spark.createDataFrame([(w,) for w in words], "w string").where(~R.is_harmonic(F.col("w")))
    slow = F.get(F.filter(C.restoration_variants(F.col("w")), lambda v: (v != F.col("w")) & R.is_harmonic(v)), F.lit(0))
    got = rows.select("w", C.harmonic_variant(F.col("w")).alias("fast"), slow.alias("slow")).collect()
    assert [(r.w, r.fast, r.slow) for r in got if r.fast != r.slow] == [] and sum(r.slow is not None for r in got) > 20


def test_word_errors():
    rng = random.Random(9)

    def plain(r, h):
        row = list(range(len(h) + 1))
        for i, x in enumerate(r, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(h, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    some = lambda: [rng.choice("абв") for _ in range(rng.randint(0, 90))]
    for _ in range(300):
        r, h = some(), some()
        assert D.word_errors(r, h) == plain(r, h)
    long = [str(rng.randrange(2000)) for _ in range(20_000)]
    began = time.perf_counter()
    assert D.word_errors(long, [w + "x" * (k % 10 == 0) for k, w in enumerate(long)]) == 2000
    assert time.perf_counter() - began < 20


def test_wer_of_missing_texts(spark):
    rows = spark.createDataFrame([("f", None, "а б"), ("f", "а б", None), ("f", None, None), ("f", "а", "а")], "file string, ref string, hyp string")
    assert {r.file: (r.errors, r.words) for r in V.wer(rows).collect()} == {"f": (4, 3), None: (4, 3)}
