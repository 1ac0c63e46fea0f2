"""From raw documents to token ids: language ID, line dedup, near-dedup, mixing to target weights, byte-level BPE.

Each stage takes the documents that the stage before it kept; its decisions take effect. Language ID drops documents
whose language can't be told; line dedup takes out lines that an earlier line copies, and documents of which nothing is
left; near-dedup takes out documents
that share 0.8 of their five-word shingles with an earlier one; mixing drops, repeats and, at a source's exact
budget, cuts documents; BPE returns the ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexmill.llm import bpe, langid, linededup, mixing, neardup
from lexmill.llm.storage import written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.drop_unidentified(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.dedup_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = bpe.encode_documents(docs, with_ids=True)
    return out.select("doc_id", "source", "lang", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash_dedup", dedup_documents),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: Language filters, XXH64 fingerprints and merges by rank are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; between stages the documents are a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
