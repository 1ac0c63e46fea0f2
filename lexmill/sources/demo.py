"""The test tables as a corpus: Latin prose projected to the Yakut alphabet, sources in trust tiers, and known errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.text import denormalize

PROJECT = ("abcdefghijklmnopqrstuvwxyzäöüßéèêñóíçABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÉÈÊÑÓÍÇ", "абцдэфгһийклмноплрстуввхызыөүһэээҥөиҕАБЦДЭФГҺИЙКЛМНОПЛРСТУВВХЫЗЫӨҮЭЭЭҤӨИҔ")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, tier, text, clean: every tenth document without special letters, `clean` as it was."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = F.substring("source", 4, 10).cast("int") % 3
    tier = F.when(n == 0, "edited").when(n == 1, "web").otherwise("ocr")
    clean = F.translate("text", *PROJECT)
    rows = docs.select("doc_id", "source", tier.alias("tier"), clean.alias("clean"))
    return rows.withColumn("text", F.when(F.col("doc_id") % 10 == 0, denormalize(F.col("clean"))).otherwise(F.col("clean")))
