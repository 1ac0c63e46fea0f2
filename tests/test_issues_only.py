"""Without a model the words alone decide: token rows aren't moved, only those of issues."""

from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import candidates as C
from lexmill.operators import corpus as K
from lexmill.operators import engine as E
from lexmill.operators import evaluation as V
from lexmill.sources.shared import perhaps_in
from tests.test_engine import engine


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_spliced(spark):
    rows = [("Ого, саҥа!\nкиси 5-а", [(0, "Оҕо"), (6, "киһи")]), ("ого", [(0, "оҕо")]), ("", None), (None, None), ("ат от", None), ("а б", [(2, "г")])]
    df = spark.createDataFrame(rows, "text string, changes array<struct<pos:int,new:string>>")
    got = [r.x for r in df.select(T.spliced(F.col("text"), F.col("changes")).alias("x")).collect()]
    assert got == ["Оҕо, саҥа!\nкиһи 5-а", "оҕо", "", None, "ат от", "а г"]


def test_rows_that_may_be_in_a_table(spark):
    rows = spark.range(3000).select(F.col("id").cast("string").alias("k"))
    few = rows.where("k % 7 = 0")
    for bits in (6, 24):
        kept = {r.k for r in perhaps_in(rows, "k", few, bits).collect()}
        assert kept >= {r.k for r in few.collect()}
    assert len(kept) < 600 and perhaps_in(rows, "k", few.where("false")).count() == 0


def test_token_rows_are_not_sorted_to_correct(spark):
    docs = spark.createDataFrame([(1, "Ого саҥа, киси! Linux 5"), (2, ""), (3, None), (4, "ОГО ого")], "doc_id long, text string")
    e = engine(spark, [("оҕо", 100), ("саҥа", 50), ("киһи", 70)])
    fixed = e.correct(docs)
    assert {r.doc_id: r.text for r in fixed.collect()} == {1: "Оҕо саҥа, киһи! Linux 5", 2: "", 3: "", 4: "ОҔО оҕо"}
    assert "Window" not in plan(fixed) and "Window" not in plan(e.clean(docs))
    assert {(r.doc_id, r.start, r.end, r.word_idx, r.before) for r in e.check(docs).collect()} == {(1, 0, 3, 0, "Ого"), (1, 10, 14, 2, "киси"), (4, 0, 3, 0, "ОГО"), (4, 4, 7, 1, "ого")}


def test_metrics_by_word_are_those_of_occurrences(spark):
    bench = spark.createDataFrame([(1, "t", "Ого киси ат ого жжж", "Оҕо киһи ат оҕо ззз"), (2, "t", "ого", "ого"), (3, "u", "жжж", "жжж")], "id long, task string, src string, tgt string")
    e = engine(spark, [("оҕо", 100), ("киһи", 70), ("ат", 9)], pairs=[("ааа", "ат")])
    e.userdict.add_replacement("ат", "от")
    found = e.check(bench.select(F.col("id").alias("doc_id"), F.col("src").alias("text"))).select(F.col("doc_id").alias("id"), "word_idx", F.get("suggestions", F.lit(0))["form"].alias("suggestion"))
    counts = V.pair_counts(bench)
    advice = e.advice(counts.select(F.lower("before").alias("word")).distinct())
    for flag in ("flagged", "suggested"):
        slow = V.metrics(V.word_pairs(bench), bench.select("id", "task").join(found, "id"), flag)
        fast = V.metrics_by_word(counts, V.items(bench), advice, flag)
        assert fast.columns == slow.columns and sorted(map(tuple, fast.collect())) == sorted(map(tuple, slow.collect()))
    assert C.restore_case is V.restore_case and E.Engine.advice


def test_sorts_of_tokens_are_not_put_together(spark):
    docs = spark.createDataFrame([(k, "ого саҥа " * 3) for k in range(40)], "doc_id long, text string")
    for rows in (K.token_rows(docs), engine(spark, [("оҕо", 9)]).occurrences(docs)):
        assert rows.count() == 240 and rows.rdd.getNumPartitions() == 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
