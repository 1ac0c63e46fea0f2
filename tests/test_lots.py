"""Python workers hold a few rows as objects at a time; triples of words are scored by their pairs."""

import pyarrow as pa
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import errors as X
from lexmill.operators import lm as M
from tests.test_engine import model


def test_rows_in_lots():
    seen = []
    lots = list(T.in_lots(iter([pa.array(["a"] * 450 + [None]), pa.array([], pa.string())]), lambda t: seen.append(t) or t, pa.string()))
    assert [len(x) for x in lots] == [200, 200, 51] and len(seen) == 451 and lots[-1][-1].as_py() is None
    two = list(T.in_lots(iter([(pa.array([1, 2]), pa.array(["x", "y"]))]), lambda a, b: b * a, pa.string()))
    assert two[0].to_pylist() == ["x", "yy"]


def test_only_texts_that_need_it_are_composed(spark):
    rows = [("éа",), ("оҕо é",), (None,), ("й",), ("",), ("가",)]
    df = spark.createDataFrame(rows, "t string").select("t", T.nfc(F.col("t")).alias("x"))
    assert [r.x for r in df.collect()] == ["éа", "оҕо é", None, "й", "", "가"]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "_composed(CASE WHEN" in plan  # the others are null to Python


def test_tags_and_missing_texts(spark):
    rows = spark.createDataFrame([("оҕо", "оҕо"), ("ого", "оҕо"), (None, "а"), ("а", "б")], "a string, b string")
    assert [r.x for r in rows.select(X.make_tags(F.col("a"), F.col("b")).alias("x")).collect()] == [[0, 0, 0], [0, 1, 0], None, None]


def test_neighbours_are_found_once():
    X._NEAR.clear()
    assert X._near("й", X.YAKUT) is X._near("й", X.YAKUT) and X._near("й", X.YAKUT) == X.neighbours("й")


def test_triples_by_pairs(spark):
    uni, bi = model(spark)
    triples = [("бу", "сайын", "үлэлээбит"), ("бу", "ыйын", "</s>"), ("<s>", "жжж", "бу"), ("бу", "сайын", "үлэлээбит")]
    rows = spark.createDataFrame(triples, "left string, word string, right string")
    pairs = spark.createDataFrame(sorted({p for a, b, c in triples for p in ((a, b), (b, c))}), "w1 string, w2 string")
    fast = M.scored_triples(rows, M.pair_scores(pairs, uni, bi))
    slow = M.scored(rows.distinct(), uni, bi)
    key = lambda df: {(r.left, r.word, r.right): round(r.context, 9) for r in df.collect()}
    assert key(fast) == key(slow) and fast.count() == 3
