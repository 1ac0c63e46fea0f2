"""Differences from a centre become rows only if they can tell a pair."""

from lexmill.llm import neardup


def test_only_the_rarest_are_exploded(spark):
    rows = [(1, i, i, {"doc_id": i}, 100, list(range(60)), 40.0) for i in range(2)]
    rest = spark.createDataFrame(rows, "g long, s1 long, s2 long, ord struct<doc_id:long>, n long, d array<long>, e double")
    made = []
    write = neardup.written
    try:
        neardup.written = lambda df, tag: made.append(df) or write(df, tag)
        assert neardup._by_difference(rest).count() == 2
    finally:
        neardup.written = write
    # of 60 differences two sets that exceed by 40 each must share 40: the rarest 21 of each tell
    assert made[0].count() == 42
    assert "posexplode(xs" not in made[0]._jdf.queryExecution().optimizedPlan().toString()
