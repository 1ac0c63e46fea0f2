"""Corpus preparation and inventories over documents(doc_id, source, tier, text)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lexmill.functions import text as T
from lexmill.profile import MAX_CHARS, MIN_CHARS, MIN_WORDS, YAKUT, LanguageProfile


def tiers(sources: DataFrame, table: dict[str, str]) -> DataFrame:
    """sources with `tier` by name; unknown ones are `?`."""
    if not table:
        return sources.withColumn("tier", F.lit("?"))
    lookup = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return sources.withColumn("tier", F.coalesce(F.try_element_at(lookup, F.col("source")), F.lit("?")))


def dealt(docs: DataFrame) -> DataFrame:
    """Texts dealt out by document for sorts of their tokens, which take twenty times the room of the compressed texts: so by
    number, as else partitions are put together by what the texts take, and sorts spill."""
    return docs.repartition(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")


def token_rows(docs: DataFrame, profile: LanguageProfile = YAKUT, text_col: str = "text") -> DataFrame:
    """doc_id, pos, piece, start, end, kind of every token. Texts are dealt out by document once, so that neither the
    explode nor the running offset moves token rows."""
    rows = dealt(docs).select("doc_id", F.posexplode_outer(T.pieces(F.col(text_col), profile)).alias("pos", "piece")).where("pos is not null")
    upto = F.sum(F.length("piece")).over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("end", upto.cast("long")).withColumn("start", F.col("end") - F.length("piece"))
    return rows.withColumn("kind", T.kind(F.col("piece"), profile)).where("kind <> 'other'")


def word_rows(docs: DataFrame, *keep: str, profile: LanguageProfile = YAKUT) -> DataFrame:
    """The kept columns and `form`, the lower-cased word, for each word."""
    # an outer explode gets no filter on the array's size, which would make the words a second time
    return docs.select(*keep, F.explode_outer(T.lower_words(F.col("text"), profile)).alias("form")).where("form is not null")


def sentence_rows(docs: DataFrame, profile: LanguageProfile = YAKUT) -> DataFrame:
    """doc_id, source, sent_idx, text of each sentence of the normalised texts."""
    text = T.normalize_for_lexicon(F.col("text"), profile)
    return docs.select("doc_id", "source", F.posexplode(T.sentences(text, profile)).alias("sent_idx", "text"))


def line_rows(docs: DataFrame) -> DataFrame:
    """The same for texts of one sentence a line. Spaces are collapsed in the whole text, so that filters on lines, which
    are pushed down to them, repeat no more than a trim."""
    even = F.regexp_replace("text", r"(?U)[\s&&[^\n ]][\s&&[^\n]]*| [\s&&[^\n]]+", " ")
    rows = docs.select("doc_id", "source", F.posexplode_outer(F.split(even, "\n")).alias("sent_idx", "text"))
    return rows.withColumn("text", F.trim("text")).where("text <> ''")


def filter_sentences(sentences: DataFrame, profile: LanguageProfile = YAKUT) -> DataFrame:
    """Length, number of words, share of the alphabet, share of letters, share of stop words. Cheap tests come first."""
    s = F.col("text")
    rows = sentences.where(F.length(s).between(MIN_CHARS, MAX_CHARS))
    rows = rows.where((T.letter_share(s, profile.alphabet) >= 0.98) & (T.clean_share(s) >= 0.85))
    return rows.where(T.enough_words(s, MIN_WORDS, 0.18, profile))


def dedup_sentences(sentences: DataFrame) -> DataFrame:
    """The first of equal sentences by (doc_id, sent_idx), exactly: a minimum, which combines before the shuffle, so a
    sentence of any frequency costs one row a task."""
    first = F.min(F.struct("doc_id", "sent_idx", "source")).alias("first")
    return sentences.groupBy("text").agg(first).select("first.doc_id", "first.source", "first.sent_idx", "text")


def corpus_counters(raw: DataFrame, kept: DataFrame, unique: DataFrame) -> DataFrame:
    """seen, kept and unique sentences by source."""
    n = lambda df, name: df.groupBy("source").agg(F.count("*").alias(name))
    out = n(raw, "seen").join(n(kept, "kept"), "source", "left").join(n(unique, "uniq"), "source", "left")
    return out.fillna(0, ["kept", "uniq"])


def char_inventory(docs: DataFrame, profile: LanguageProfile = YAKUT) -> DataFrame:
    """ch, source (null for all), n, share among the group's characters, whether it is in the alphabet."""
    rows = docs.select("source", F.explode(F.split("text", "")).alias("ch")).where("ch <> ''")
    by_source = rows.groupBy("source", "ch").agg(F.count("*").alias("n"))
    both = by_source.unionByName(by_source.groupBy("ch").agg(F.sum("n").alias("n")).withColumn("source", F.lit(None).cast("string")))
    total = both.groupBy("source").agg(F.sum("n").alias("total")).withColumnRenamed("source", "of")
    both = both.join(total, F.col("source").eqNullSafe(F.col("of"))).withColumn("share", F.col("n") / F.col("total"))
    return both.select("source", "ch", "n", "share", F.lit(profile.alphabet).contains(F.lower("ch")).cast("int").alias("in_alphabet"))


@F.pandas_udf(StringType())
def _names(chars: pd.Series) -> pd.Series:
    return chars.map(lambda c: unicodedata.name(c[0], "?") if c else "?")


def char_names(inventory: DataFrame) -> DataFrame:
    """The inventory of all sources with code points and Unicode names; Python sees distinct characters only."""
    code = F.format_string("U+%04X", F.ascii("ch"))
    shown = F.when(F.col("ch").rlike(r"\p{Cntrl}"), code).otherwise(F.col("ch"))
    return inventory.where("source is null").select(shown.alias("ch"), code.alias("codepoint"), _names("ch").alias("name"), "n", "share", "in_alphabet")


def source_profile(docs: DataFrame, profile: LanguageProfile = YAKUT) -> DataFrame:
    """docs, chars, letters, share of special letters and of letters beyond the alphabet, by source."""
    low = F.lower(F.col("text"))
    n = lambda pattern: F.sum(F.length(F.regexp_replace(low, pattern, ""))).cast("long")
    out = docs.groupBy("source").agg(F.count("*").alias("docs"), F.sum(F.length("text")).cast("long").alias("chars"), n(r"[^\p{L}]").alias("letters"), n(f"[^{profile.special}]").alias("special"), n(f"[^{profile.alphabet}]").alias("own"))
    share = lambda x: F.when(F.col("letters") > 0, x / F.col("letters")).otherwise(0.0)
    return out.select("source", "docs", "chars", "letters", share(F.col("special")).alias("special_share"), share(F.col("letters") - F.col("own")).alias("foreign_letter_share"))


def char_vocabulary(docs: DataFrame, min_freq: int = 1) -> DataFrame:
    """ch, n and id, by falling count from 2 (0 pads, 1 is unknown). One row a character, so the numbering is small."""
    rows = docs.select(F.explode(F.split("text", "")).alias("ch")).where("ch <> ''").groupBy("ch").agg(F.count("*").alias("n")).where(F.col("n") >= min_freq)
    return rows.withColumn("id", F.row_number().over(Window.orderBy(F.desc("n"), "ch")) + 1)
