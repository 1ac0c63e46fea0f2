"""What is costly is made once for a row: neither a pushed-down filter nor an inferred one repeats it."""

import re

import pytest
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import corpus as K
from lexmill.operators import lm as M
from lexmill.profile import LATIN, YAKUT


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def docs(spark):
    rows = [(1, "a", "t", "Оҕо 5-а  Саҥа-оҕо\r\n\t \nabc x'y ат\u00a0от"), (2, "a", "t", ""), (3, "b", "t", None), (4, "b", "t", "12 !")]
    return spark.createDataFrame(rows, "doc_id long, source string, tier string, text string")


def test_words_once(docs):
    for df in (M.unigrams(docs), M.bigrams(docs), K.word_rows(docs, "source"), K.filter_sentences(docs)):
        assert optimized(df).count("regexp_extract_all") == 1
    assert optimized(K.filter_sentences(K.line_rows(docs))).count("regexp_replace(text") <= 1 + 4  # the lines, and the shares of letters


def test_words_and_lines(docs):
    assert [r.w for r in docs.select(T.lower_words(F.col("text")).alias("w")).collect()] == [["оҕо", "саҥа-оҕо", "ат", "от"], [], None, []]
    assert {(r.doc_id, r.sent_idx, r.text) for r in K.line_rows(docs).collect()} == {(1, 0, "Оҕо 5-а Саҥа-оҕо"), (1, 2, "abc x'y ат от"), (4, 0, "12 !")}
    assert {(r.word, r.n) for r in M.unigrams(docs).collect()} == {("<s>", 1), ("</s>", 1), ("оҕо", 1), ("саҥа-оҕо", 1), ("ат", 1), ("от", 1)}
    latin = docs.sparkSession.createDataFrame([("Fün d'Or 5-a É",)], "t string").select(T.lower_words(F.col("t"), LATIN).alias("w")).first().w
    assert latin == ["fün", "d'or", "é"]


def test_classes_of_letters_are_ranges():
    found = T._ranges(YAKUT.alphabet)
    assert found.count("-") == 1 and len(re.findall("x", found)) < 10
    assert re.fullmatch("[" + re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), found) + "]+", YAKUT.alphabet)
