"""The pipeline's stages take effect one after the other."""

import re
from collections import Counter

import corpus_pipeline
from lexmill.llm import bpe, langid, linededup, mixing, simhash


def test_stages(spark, tmp_path):
    rows = [(i, f"the thing of and to {i} " + " ".join(f"w{(i * 7 + k) % 40}x{i}" for k in range(12)), "en", f"s{i % 3}", 1) for i in range(30)]
    rows += [(90, "123 456", "en", "s0", 1), (91, None, "en", "s0", 1), (92, rows[4][1], "en", "s1", 1), (93, rows[5][1] + " more", "en", "s1", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_dedup", "mixing", "byte_bpe"]
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        out = f(spark, docs, str(tmp_path))
        if name != "byte_bpe":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "language_id":
            assert not ids & {90, 91} and {*range(30), 92, 93} <= ids
        if name == "line_dedup":
            assert not ids & {92, 93} and {*range(30)} <= ids
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.ids_sha256) for r in final) == Counter((r.doc_id, r.ids_sha256) for r in docs.collect())
    assert all(len(r.token_ids) == r.n_tokens for r in final)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_catalogue_names():
    from lexmill.llm import catalogue

    assert [re.match(r"op(\d+)_", k)[1] for k in catalogue.queries()] == [str(n) for n in range(1, 11)]
    assert all(m for m in (bpe, langid, linededup, mixing, simhash))
