"""The pipeline's line-dedup stage on lines too short for near copies."""

import corpus_pipeline


def test_stage_drops_exact_copies_of_short_lines(spark):
    own = [" ".join(f"w{i}x{k}" for k in range(12)) for i in range(4)]
    rows = [(1, f"Home\n{own[0]}\n\nAll rights reserved"), (2, f"Home\n{own[1]}\n\nAll  rights reserved"), (3, f"Homes\n{own[2]}\nall rights reserved"), (4, f"{own[3]}\nHome\nHome"), (5, " \nHome"), (6, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in corpus_pipeline.dedup_lines(spark, docs, "").collect()}
    # lines without a word stay, near copies under ten words too
    assert got == {1: rows[0][1], 2: f"{own[1]}\n", 3: rows[2][1], 4: own[3], 6: None, 7: ""}
