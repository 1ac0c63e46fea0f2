"""Readers and writers of the engine's data sets. Compression follows the file's extension."""

from __future__ import annotations

import os
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators.engine import UserDict
from lexmill.operators.lexicon import front_coded, quantised

LEXICON = "form string, freq long, n_sources int, freq_other long"
PAIRS = "wrong string, right string, cost int, freq_wrong long, freq_right long"
SHADOWS = "shadow string, freq_shadow long, where string, origin string, freq_origin long, ratio double, demote int"


def corpus_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """source, text, bad: JSON lines; a line that is no JSON object is kept, marked bad, with the defaults of missing keys."""
    rows = spark.read.schema("source string, text string, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.select(F.coalesce("source", F.lit("?")).alias("source"), F.coalesce("text", F.lit("")).alias("text"), F.col("_bad").isNotNull().alias("bad"))


def file_stem(name: Column) -> Column:
    return F.regexp_extract(name, r"([^/]+?)(?:\.[A-Za-z0-9]+)*$", 1)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """source, text: lines of plain files, of which the file's name is the source."""
    return spark.read.text(path).select(file_stem(F.col("_metadata.file_name")).alias("source"), F.col("value").alias("text"))


def tsv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """Columns by place; numbers that don't parse are null, quotes mean nothing."""
    return spark.read.schema(schema).option("sep", "\t").option("header", header).option("enforceSchema", True).option("quote", "").csv(path)


def lexicon_tsv(spark: SparkSession, core: str, tail: str | None = None, other: str | None = None) -> DataFrame:
    """The lexicon table from its files; rows without a count are dropped."""
    out = tsv(spark, core, LEXICON).withColumn("kind", F.lit("core"))
    if tail:
        out = out.unionByName(tsv(spark, tail, LEXICON).withColumn("kind", F.lit("tail")))
    if other:
        rows = tsv(spark, other, "form string, freq_other long")
        out = out.unionByName(rows.select("form", F.lit(0).cast("long").alias("freq"), F.lit(0).alias("n_sources"), "freq_other", F.lit("other").alias("kind")))
    return out.where("form is not null and (coalesce(freq, 0) <> 0 or coalesce(freq_other, 0) <> 0)").fillna(0, ["freq", "n_sources", "freq_other"])


def forms_only(spark: SparkSession, path: str) -> DataFrame:
    return tsv(spark, path, "form string").distinct()


def bigrams_tsv(spark: SparkSession, path: str, min_count: int = 1) -> DataFrame:
    return tsv(spark, path, "w1 string, w2 string, n long").where(F.col("n") >= min_count)


def predictions(spark: SparkSession, pattern: str) -> DataFrame:
    """file, ref, hyp of all files that match; broken lines and lines without both are dropped."""
    rows = spark.read.schema("ref string, hyp string").json(pattern)
    return rows.select(F.col("_metadata.file_name").alias("file"), "ref", "hyp").where("ref is not null and hyp is not null")


def write_tsv(df: DataFrame, path: str, *order: Column, gz: bool = False) -> None:
    """Sorted across files by range, so that no task writes it all."""
    df.orderBy(*order).write.option("sep", "\t").option("header", True).option("quote", "").option("compression", "gzip" if gz else "none").mode("overwrite").csv(path)


def write_lexicon(lexicon: DataFrame, path: str) -> None:
    for kind in ("core", "tail"):
        write_tsv(lexicon.where(F.col("kind") == kind).select("form", "freq", "n_sources", "freq_other"), f"{path}/{kind}", F.desc("freq"), F.col("form"))
    write_tsv(lexicon.where("kind = 'other'").select("form", "freq_other"), f"{path}/only_other", F.desc("freq_other"), F.col("form"))


def write_model(unigram: DataFrame, bigram: DataFrame, path: str) -> None:
    write_tsv(unigram, f"{path}/unigrams", F.desc("n"), F.col("word"), gz=True)
    write_tsv(bigram, f"{path}/bigrams", F.col("w1"), F.col("w2"), gz=True)


def write_by_source(sentences: DataFrame, path: str) -> None:
    sentences.select("source", "text").write.partitionBy("source").mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_front_coded(forms: DataFrame, path: str, most: int = 40) -> None:
    """Blocks by first letter: a line is a character for the shared prefix, and the tail; frequencies beside as bytes."""
    coded = front_coded(forms.select("form"), most).join(forms.select("form", "freq"), "form")
    line = F.concat(F.char(F.col("prefix") + 48), "tail", F.lit("\t"), quantised(F.col("freq")).cast("string"))
    coded.select("head", "form", line.alias("value")).repartition("head").sortWithinPartitions("head", "form").select("value").write.mode("overwrite").text(path)


def read_front_coded(spark: SparkSession, path: str) -> DataFrame:
    """form, code. A block starts where nothing is shared; files hold whole blocks, so each decodes by itself."""

    def decode(batches):
        import pandas as pd

        prev = ""
        for b in batches:
            out = []
            for line in b.value:
                body, code = line.rsplit("\t", 1)
                prev = prev[: ord(body[0]) - 48] + body[1:]
                out.append((prev, int(code)))
            yield pd.DataFrame(out, columns=["form", "code"])

    # a file is one partition here, as a block can't be cut: wholetext keeps it in one row
    lines = spark.read.option("wholetext", True).text(path)
    split = lambda it: ({"value": b.value.str.rstrip("\n").str.split("\n").explode().dropna()} for b in it)

    def run(it):
        import pandas as pd

        return decode(pd.DataFrame(x) for x in split(it))

    return lines.where("value <> ''").mapInPandas(run, "form string, code int")


def user_dictionary_path() -> Path:
    """Where a user's dictionary is, unless told otherwise."""
    base = os.environ.get("LEXMILL_USERDICT")
    return Path(base) if base else Path(os.environ.get("XDG_CONFIG_HOME", Path.home() / ".config")) / "lexmill" / "userdict.txt"


def read_user_dictionary(path: str | Path) -> UserDict:
    """Lines `word` or `wrong -> right`; # starts a comment, blank lines are skipped."""
    out = UserDict()
    if not Path(path).exists():
        return out
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        line = line.split("#", 1)[0].strip()
        pair = re.split(r"\s*->\s*", line, maxsplit=1)
        if len(pair) == 2 and all(pair):
            out.add_replacement(*pair)
        elif line:
            out.add(line)
    return out


def write_user_dictionary(words: UserDict, path: str | Path) -> None:
    lines = ["# word, or wrong -> right", *sorted(words.accept), *[f"{a} -> {b}" for a, b in sorted(words.replace.items())]]
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text("\n".join(lines) + "\n", encoding="utf-8")
