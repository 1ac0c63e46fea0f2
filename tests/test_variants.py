"""Restorations of words with many ambiguous letters, against a product in plain Python."""

import itertools

from pyspark.sql import functions as F

from lexmill.functions import rules as R
from lexmill.operators import candidates as C
from lexmill.profile import YAKUT


def by_hand(word, most=4096):
    low, table = word.lower(), dict(zip(*YAKUT.restore, strict=True))
    slots = [(c, table[c]) if c in table else (c,) for c in low]
    if 2 ** sum(len(s) - 1 for s in slots) > most:
        slots = [s if s[0] in "гоу" else s[:1] for s in slots]
    out = {}
    for combo in itertools.islice(itertools.product(*slots), most):
        v = "".join(combo)
        out.setdefault(v, sum(a != b for a, b in zip(v, low, strict=True)))
    if "нг" in low:
        out.setdefault(low.replace("нг", "ҥ"), 1)
    return [v for _, v in sorted((n, v) for v, n in out.items())]


def test_variants_of_many_letters(spark):
    # 9 and 12 letters are within the bound; then г, о, у alone, of the last word the last 12
    words = ["аба", "онгуох", "нусхаганобу", "Оногосуннуга", "хонусхаганобусунна", "огуогуогуогуогу"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", C.restoration_variants(F.col("w")).alias("v")).collect()
    assert {r.w: r.v for r in got} == {w: by_hand(w) for w in words}


def test_harmony_proposes_for_words_of_many_letters(spark):
    words = spark.createDataFrame([("нугунунугунэ",)], "word string")
    none = spark.createDataFrame([], "form string, freq long")
    shadows = spark.createDataFrame([], "shadow string, origin string, demote int")
    found = {r.word: r.form for r in C.candidates(words, none, shadows, fuzzy=False).collect()}
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(by_hand("нугунунугунэ"))], "k int, v string")
    first = rows.where(R.is_harmonic(F.col("v"))).orderBy("k").first()
    assert first and found["нугунунугунэ"] == first.v
