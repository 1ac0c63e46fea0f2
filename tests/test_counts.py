"""Measures of word pairs that are counted first, and rules as single patterns, against the long way."""

import random

from pyspark.sql import functions as F

from lexmill.functions import rules as R
from lexmill.operators import evaluation as V


def test_hits_agree_with_violations(spark):
    rng = random.Random(3)
    words = {"".join(rng.choice("аыоуэиөүааоокмтрсһьдньҥҕйнт-в") for _ in range(rng.randint(1, 9))) for _ in range(3000)}
    rows = spark.createDataFrame([(w,) for w in words], "w string")
    both = rows.select("w", *[F.struct(R.hits(r, F.col("w")).alias("fast"), (F.size(R.RULES[r](F.col("w"))) > 0).alias("slow")).alias(r) for r in R.ALL]).collect()
    for r in R.ALL:
        assert [x.w for x in both if x[r].fast != x[r].slow] == []
        assert any(x[r].slow for x in both) and not all(x[r].slow for x in both)


def test_a_rule_of_the_callers_own_takes_the_place_of_a_built_in_one(spark):
    kept = R.RULES["initial"]
    R.register("initial", lambda w, p=None: F.array(F.struct(F.lit("initial").alias("rule"), F.lit(0).alias("position"), w.alias("detail"))))
    try:
        assert spark.range(1).select(R.hits("initial", F.lit("ат"))).first()[0]
    finally:
        R.RULES["initial"] = kept


def bench(spark):
    return spark.createDataFrame([(1, "t", "ого киси ат ого", "оҕо киһи ат оҕо"), (2, "t", "а б", "а"), (3, "t", "", ""), (4, "u", "киси", "киһи"), (5, "u", None, "а")], "id long, task string, src string, tgt string")


def test_counts_stand_for_pairs(spark):
    rows = bench(spark)
    pairs, counts = V.word_pairs(rows), V.pair_counts(rows)
    assert "word_idx" not in counts.columns and sorted((r.before, r.n) for r in counts.where("task = 't'").collect()) == [("ат", 1), ("киси", 1), ("ого", 2)]
    verdicts = spark.createDataFrame([("ого", True), ("киси", False)], "form string, ok boolean")
    for measure in (V.rule_catches, lambda x: V.ceiling(x, verdicts)):
        assert sorted(map(tuple, measure(pairs).collect())) == sorted(map(tuple, measure(counts).collect()))
    assert {(r.task, r.wrong, r.accepted) for r in V.ceiling(counts, verdicts).collect()} == {("t", 3, 2), ("u", 1, 0)}


def test_sweep_without_a_join(spark):
    pairs = V.word_pairs(bench(spark))
    made = F.when(F.col("word_idx") != 2, F.col("after"))
    carried = pairs.withColumns({"suggestion": made, "confidence": F.when(made.isNotNull(), (F.col("word_idx") + 1) / 4)})
    apart = carried.where("suggestion is not null").select("id", "task", "word_idx", "suggestion", "confidence")
    short, long = V.sweep(carried, V.items(bench(spark)), [0.2, 0.5, 0.9]), V.threshold_sweep(pairs, apart, [0.2, 0.5, 0.9])
    assert sorted(map(tuple, short.collect())) == sorted(map(tuple, long.collect()))
    assert {r.task: r["items"] for r in short.collect()} == {"t": 1, "u": 1}
