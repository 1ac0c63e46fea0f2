"""Bigram model with sentence ends: counts, cuts and scores as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.profile import BACKOFF, BOS, EOS, YAKUT, LanguageProfile


def _sequences(sentences: DataFrame, profile: LanguageProfile) -> DataFrame:
    """Null where there is no word: outer explodes drop the sentence later, as a filter here would make its words again."""
    low = sentences.select(T.lower_words(F.col("text"), profile).alias("w"))
    return low.select(F.when(F.size("w") > 0, F.concat(F.array(F.lit(BOS)), "w", F.array(F.lit(EOS)))).alias("w"))


def unigrams(sentences: DataFrame, profile: LanguageProfile = YAKUT) -> DataFrame:
    """word, n; sentence ends count as words."""
    return _sequences(sentences, profile).select(F.explode_outer("w").alias("word")).where("word is not null").groupBy("word").agg(F.count("*").alias("n"))


def bigrams(sentences: DataFrame, vocabulary: DataFrame | None = None, min_count: int = 1, profile: LanguageProfile = YAKUT) -> DataFrame:
    """w1, w2, n; with a vocabulary (form) only pairs of its words and sentence ends."""
    pairs = F.arrays_zip(F.slice("w", F.lit(1), F.size("w") - 1).alias("w1"), F.slice("w", F.lit(2), F.size("w") - 1).alias("w2"))
    out = _sequences(sentences, profile).select(F.inline_outer(pairs)).where("w1 is not null").groupBy("w1", "w2").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
    if vocabulary is not None:
        ends = vocabulary.sparkSession.createDataFrame([(BOS,), (EOS,)], "form string")
        known = vocabulary.select("form").unionByName(ends)
        for c in ("w1", "w2"):
            out = out.join(known.withColumnRenamed("form", c), c, "left_semi")
    return out.select("w1", "w2", "n")


def total(unigram: DataFrame) -> int:
    return unigram.agg(F.sum("n")).first()[0] or 1


def log_unigram(n: Column, all_: int) -> Column:
    return F.log10((F.coalesce(n, F.lit(0)) + F.lit(0.5)) / F.lit(float(all_)))


def log_bigram(pair: Column, left: Column, word: Column, all_: int) -> Column:
    """log10 P(word | left) from the counts of the pair, of the left word and of the word; a pair never seen backs off."""
    return F.when(pair > 0, F.log10(pair / F.greatest(F.coalesce(left, pair), F.lit(1)))).otherwise(F.log10(F.lit(BACKOFF)) + log_unigram(word, all_))


def scored(rows: DataFrame, unigram: DataFrame, bigram: DataFrame, all_: int | None = None) -> DataFrame:
    """rows (word, left, right, ...) with `context`: log P(word | left) + log P(right | word), the latter if right is set.
    Five left joins on equal keys; their tables are of the size of the vocabulary."""
    all_ = all_ or total(unigram)
    uni = lambda on, name: unigram.select(F.col("word").alias(on), F.col("n").alias(name))
    out = rows.join(uni("word", "__n"), "word", "left").join(uni("left", "__l"), "left", "left").join(uni("right", "__r"), "right", "left")
    out = out.join(bigram.select(F.col("w1").alias("left"), F.col("w2").alias("word"), F.col("n").alias("__lw")), ["left", "word"], "left")
    out = out.join(bigram.select(F.col("w1").alias("word"), F.col("w2").alias("right"), F.col("n").alias("__wr")), ["word", "right"], "left")
    first = log_bigram(F.col("__lw"), F.col("__l"), F.col("__n"), all_)
    second = F.when(F.col("right").isNotNull(), log_bigram(F.col("__wr"), F.col("__n"), F.col("__r"), all_)).otherwise(0.0)
    return out.withColumn("context", first + second).drop("__n", "__l", "__r", "__lw", "__wr")


def pair_scores(pairs: DataFrame, unigram: DataFrame, bigram: DataFrame) -> DataFrame:
    """(w1, w2), distinct -> w1, w2 and `p`, log P(w2 | w1)."""
    uni = lambda on, name: unigram.select(F.col("word").alias(on), F.col("n").alias(name))
    seen = bigram.join(uni("w1", "__l"), "w1", "left").select("w1", "w2", F.col("n").alias("__n"), "__l")
    out = pairs.select("w1", "w2").join(uni("w2", "__w"), "w2", "left").join(seen, ["w1", "w2"], "left")
    return out.select("w1", "w2", log_bigram(F.col("__n"), F.col("__l"), F.col("__w"), total(unigram)).alias("p"))


def scored_triples(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(left, word, right) and pair_scores of all pairs in them -> the distinct ones with `context`, as `scored` has it. They
    are moved twice: to their first pair, where equal ones meet as well, and to their second."""
    first = pairs.select(F.col("w1").alias("left"), F.col("w2").alias("word"), F.col("p").alias("__p"))
    second = pairs.select(F.col("w1").alias("word"), F.col("w2").alias("right"), F.col("p").alias("__q"))
    out = rows.select("left", "word", "right").repartition("left", "word").distinct().join(first, ["left", "word"])
    return out.join(second, ["word", "right"]).select("left", "word", "right", (F.col("__p") + F.col("__q")).alias("context"))


def size(unigram: DataFrame, bigram: DataFrame) -> DataFrame:
    """words, tokens, pairs, pair_tokens."""
    a = unigram.agg(F.count("*").alias("words"), F.sum("n").cast("long").alias("tokens"))
    b = bigram.agg(F.count("*").alias("pairs"), F.sum("n").cast("long").alias("pair_tokens"))
    return a.withColumn("k", F.lit(1)).join(b.withColumn("k", F.lit(1)), "k").drop("k")
