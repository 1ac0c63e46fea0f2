"""Phonotactic rules on words that keep and break them."""

import pytest
from pyspark.sql import functions as F

from lexmill.functions import rules as R


def found(spark, word, rules=R.ALL):
    return [tuple(x) for x in spark.createDataFrame([(word,)], "w string").select(R.violations(F.col("w"), rules).alias("x")).first().x]


@pytest.mark.parametrize(("word", "want"), [("оҕо", ["о", "о"]), ("уоттаах", ["уо", "аа"]), ("биэрэр", ["иэ", "э"]), ("үөрэх", ["үө", "э"]), ("кыыс", ["ыы"]), ("тр", []), ("ыал", ["ыа"])])
def test_nuclei(spark, word, want):
    got = spark.createDataFrame([(word,)], "w string").select(R.nuclei(F.col("w")).alias("x")).first().x
    assert [x.hit for x in got] == want and all(word[x.at :].startswith(x.hit) for x in got)


@pytest.mark.parametrize("word", ["оҕо", "оҕолор", "киһи", "күһүҥҥү", "үлэлээбит", "дьон-сэргэ", "күүс-көмө", "вагон", "тыа"])
def test_harmony_kept(spark, word):
    assert found(spark, word, ("harmony",)) == []
    assert spark.createDataFrame([(word,)], "w string").select(R.is_harmonic(F.col("w"))).first()[0]


@pytest.mark.parametrize(("word", "at", "detail"), [("оҕолар", 4, "о→а"), ("үлалар", 2, "ү→а"), ("кыһи", 3, "ы→и"), ("дьон-сэрга", 9, "э→а")])
def test_harmony_broken(spark, word, at, detail):
    assert found(spark, word, ("harmony",)) == [("harmony", at, detail)]
    assert not spark.createDataFrame([(word,)], "w string").select(R.is_harmonic(F.col("w"))).first()[0]


@pytest.mark.parametrize(
    ("word", "rule", "at"),
    [("ҥоҕо", "initial", 0), ("ат-йох", "initial", 3), ("буоллаҕ", "final", 6), ("барстк", "clusters", 2), ("таһк", "final_cluster", 2), ("уьу", "soft_sign", 1), ("ьу", "soft_sign", 0), ("баааҕа", "triple_letter", 1), ("киоэ", "vowel_pairs", 1)],
)
def test_rules_that_are_broken(spark, word, rule, at):
    assert (rule, at) in [x[:2] for x in found(spark, word)]


@pytest.mark.parametrize("word", ["тыһ", "сылдьар", "аньыы", "барт", "уонна"])
def test_words_without_fault(spark, word):
    assert found(spark, word, R.SAFE) == []


def test_registry(spark):
    assert len(R.RULES) == 8 and set(R.SAFE) < set(R.ALL)
    R.register("none", lambda w, p=None: F.array(F.struct(F.lit("none").alias("rule"), F.lit(0).alias("position"), w.alias("detail"))))
    try:
        assert found(spark, "ат", ("none",)) == [("none", 0, "ат")]
    finally:
        del R.RULES["none"]
