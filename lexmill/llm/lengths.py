"""Token counts: an exact length histogram.

Documents are encoded once and pre-aggregated by (group, encoded length). Suffix sums over the histogram then answer, for
every context limit, how many documents and tokens are longer, what is left when texts are cut at the limit, and which
share of documents fits. The sums are taken in two steps, over ranges of `RANGE` lengths and inside each range, so that
no task holds more than a range or the list of ranges.

Defined cases: null or empty text has length 0; a null group is a group of its own; repeated rows count each; an empty
table gives an empty histogram; extra columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.bpe import count_tokens
from lexmill.llm.storage import written

RANGE = 1024


def length_histogram(docs: DataFrame, *, text_col: str = "text", group_col: str = "source", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """group, length, n: how many documents of the group have the length in tokens."""
    rows = docs.select(docs[group_col].alias("group"), docs[text_col].alias("text"))
    counted = count_tokens(rows, path=path, pattern=pattern).groupBy("group", F.col("n_tokens").alias("length")).agg(F.count("*").alias("n"))
    # written, as all that reads it twice would encode twice
    return written(counted, "histogram")


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """The histogram with what each length says as a context limit: n_docs and n_tokens of the group, docs_over and
    tokens_over it, tokens_cut (all tokens when texts are cut there), and share_within (the quantile it is)."""
    h = histogram.withColumn("range", F.expr(f"length div {RANGE}"))
    same, of = Window.partitionBy("group"), {"docs": F.sum("n"), "tokens": F.sum(F.col("n") * F.col("length"))}
    ranges = h.groupBy("group", "range").agg(*[v.alias(k) for k, v in of.items()])
    upto = same.orderBy("range")
    ranges = ranges.select(F.col("group").alias("g"), F.col("range").alias("r"), *[(F.sum(k).over(upto) - F.col(k)).alias(f"{k}_before") for k in of], *[F.sum(k).over(same).alias(f"n_{k}") for k in of])
    inside = Window.partitionBy("group", "range").orderBy("length")
    h = h.withColumns({"docs": F.sum("n").over(inside), "tokens": F.sum(F.col("n") * F.col("length")).over(inside)})
    both = h.join(ranges, F.col("group").eqNullSafe(F.col("g")) & (F.col("range") == F.col("r")))
    docs, tokens = F.col("docs") + F.col("docs_before"), F.col("tokens") + F.col("tokens_before")
    over = F.col("n_docs") - docs
    return both.select("group", "length", "n", "n_docs", "n_tokens", over.alias("docs_over"), (F.col("n_tokens") - tokens).alias("tokens_over"), (tokens + over * F.col("length")).alias("tokens_cut"), (docs / F.col("n_docs")).alias("share_within"))


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """group, limit, tokens_cut, docs_over for any limits, also those that no document has as its length."""
    # of the lengths up to a limit the largest: beyond it only its docs_over documents go on
    within = lambda x: F.max_by(F.struct("docs_over", "tokens_cut", "length"), F.when(F.col("length") <= x, F.col("length")))
    picked = F.array(*[F.struct(F.lit(x).cast("long").alias("limit"), within(x).alias("at")) for x in limits])
    rows = sums.groupBy("group").agg(F.max("n_docs").alias("n_docs"), picked.alias("p")).select("group", "n_docs", F.explode("p").alias("p"))
    over, limit = F.coalesce("p.at.docs_over", "n_docs"), F.col("p.limit")
    cut = F.coalesce(F.col("p.at.tokens_cut") + over * (limit - F.col("p.at.length")), over * limit)
    return rows.select("group", limit.alias("limit"), cut.alias("tokens_cut"), over.alias("docs_over"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """group, share, length: the smallest length that at least the share of the group's documents fit."""
    pick = F.array(*[F.struct(F.lit(s).alias("share"), F.min(F.when(F.col("share_within") >= s, F.col("length"))).alias("length")) for s in shares])
    return sums.groupBy("group").agg(pick.alias("q")).select("group", F.explode("q").alias("q")).select("group", "q.share", "q.length")
