"""Mixing sources to target weights.

Each document gets a hash-random key, and the keys are range-sorted within each source: sizes by key, keys only, are dealt
out to ranges, so that a source of any size is spread. The prefix sums of sizes are taken in two steps, over the ranges of
a source, then inside the one range where its budget runs out. The budget then is one position in that order: documents
before it get one epoch more than documents after it, and the document at it is cut at the exact word.

Defined cases: null text has size 0; null is a source of its own, ranked last; a repeated row (equal id and text) is
a tie: its repeats share the words left at the cut, and what can't be shared evenly goes a word each to the first of them
in the order of a hash of all their columns; an empty table gives an empty mix; extra columns stay and never clash, as
helper columns get free names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.storage import column_named, shuffle_partitions, written

#: Words are what is between ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"
#: Splits a text so that each piece ends with a word, and white space stays in front of it.
_AFTER_WORD = "(?<=[^\\x20\\x09-\\x0D])(?=[\\x20\\x09-\\x0D])"


@dataclass(frozen=True)
class MixSpec:
    weights: tuple[int, ...] = (1, 2, 3)
    cap: float = 3.0
    share: float = 1.0
    seed: int = 20_011


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix_key(spec: MixSpec, doc_id: Column, text: Column) -> tuple[Column, Column]:
    """Two 63-bit keys; equal only for rows of equal id and text."""
    first = F.shiftrightunsigned(F.xxhash64(F.lit(spec.seed), doc_id, text), 1)
    return first, F.shiftrightunsigned(F.xxhash64(F.lit(spec.seed + 1), text, doc_id), 1)


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """df with `rank` from 1 in the given order, without gathering the rows: range partitions are written, counted,
    and numbered from the sum of the counts before them."""
    dealt = df.repartitionByRange(shuffle_partitions(df.sparkSession), *order).withColumn("part", F.spark_partition_id())
    dealt = written(dealt, "ranked")
    before = dealt.groupBy("part").count().withColumn("before", F.sum("count").over(Window.orderBy("part")) - F.col("count"))
    at = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return dealt.withColumn("at", at).join(before.select("part", "before"), "part").withColumn("rank", F.col("at") + F.col("before")).drop("part", "at", "before")


def targets(sources: DataFrame, spec: MixSpec) -> DataFrame:
    """(source, source_size) -> with weight and target. Shares above a source's cap stop there and the excess is dealt
    out again by weight; every round is one aggregate with one row, whatever the number of sources."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in spec.weights]), ((F.col("rank") - 1) % len(spec.weights) + 1).cast("int"))
    table = ranked(sources, F.col("source").isNull(), F.col("source")).withColumn("weight", w).withColumn("most", F.col("source_size") * F.lit(float(spec.cap)))
    table = written(table, "weights")
    total = table.agg(F.sum("source_size") * F.lit(spec.share), F.sum("weight")).first()
    level, stopped = (total[0] or 0.0) / (total[1] or 1.0), -1
    while True:
        above = F.col("weight") * F.lit(level) > F.col("most")
        n, fixed, open_weight = table.agg(F.count_if(above), F.sum(F.when(above, F.col("most"))), F.sum(F.when(~above, F.col("weight")))).first()
        if n == stopped or not n or not open_weight:
            break
        level, stopped = ((total[0] or 0.0) - (fixed or 0.0)) / open_weight, n
    return table.withColumn("target", F.least(F.col("weight") * F.lit(float(level)), F.col("most"))).drop("most", "rank")


def plan_mix(docs: DataFrame, spec: MixSpec = MixSpec(), *, id_col="doc_id", text_col="text", source_col="source") -> tuple[DataFrame, DataFrame]:
    """(sized, cuts). sized: doc_id, source, size, k1, k2 for each document. cuts: for each source its size, target,
    full epochs, and the position (c1, c2) up to which documents get one epoch more; at it, cut_words of each."""
    k1, k2 = mix_key(spec, docs[id_col], docs[text_col])
    sized = docs.select(docs[id_col].alias("doc_id"), docs[source_col].alias("source"), word_count(docs[text_col]).alias("size"), k1.alias("k1"), k2.alias("k2"))
    sized = written(sized, "sized")
    sources = written(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    budget = F.floor(F.col("target") + 0.5).cast("long")
    plan = targets(sources, spec).withColumn("full", F.when(F.col("source_size") > 0, F.expr("floor(target + 0.5) div source_size")).otherwise(0).cast("long"))
    plan = written(plan.withColumn("rest", budget - F.col("full") * F.col("source_size")), "plan")

    # repeated rows are summed up first, so that no key has more than a row
    keys = sized.where("size > 0").groupBy("source", "k1", "k2").agg(F.sum("size").alias("words"), F.count("*").alias("ties"))
    dealt = keys.repartitionByRange(shuffle_partitions(docs.sparkSession), "source", "k1", "k2").withColumn("part", F.spark_partition_id())
    dealt = written(dealt, "ranges")
    sums = dealt.groupBy("source", "part").agg(F.sum("words").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("part"))
    sums = sums.select(F.col("source").alias("of"), F.col("part").alias("at_part"), "words", (upto - F.col("words")).alias("before"))
    at = sums.join(plan.where("rest > 0"), F.col("of").eqNullSafe(F.col("source"))).where("before < rest and rest <= before + words").select("of", "at_part", "before", "rest")
    inside = dealt.join(at, F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("at_part")))
    run = F.sum("words").over(Window.partitionBy("source").orderBy("k1", "k2")) + F.col("before")
    cut = inside.withColumn("upto", run).where("upto >= rest and upto - words < rest")
    left = F.expr("rest - upto + words")
    cut = cut.select(F.col("source").alias("of"), F.col("k1").alias("c1"), F.col("k2").alias("c2"), F.expr("(rest - upto + words) div ties").alias("cut_words"), (left % F.col("ties")).alias("spare"))
    cuts = plan.join(cut, F.col("source").eqNullSafe(F.col("of")), "left").drop("of", "rest", "weight")
    return sized, written(cuts, "cuts")


def _with_spare(rows: DataFrame, at: Column, source: Column, cut_words: str, spare: str) -> DataFrame:
    """rows with `cut_words` of their own: those at a cut (`at`) that come first get one more, up to the number in `spare`.
    They are numbered over range partitions, as any number of rows may be one document's."""
    tied = at & F.coalesce(F.col(spare) > 0, F.lit(False))
    some = rows.where(tied)
    kept = [c for c in rows.columns if c not in (cut_words, spare)]
    hash_, id_, src = (column_named(rows, x) for x in ("hash", "row", "src"))
    some = ranked(some.withColumns({hash_: F.xxhash64(*rows.columns), id_: F.monotonically_increasing_id(), src: source}), F.col(src), F.col(hash_), F.col(id_))
    first = some.groupBy(src).agg(F.min("rank").alias("first")).withColumnRenamed(src, "of")
    some = some.join(first, F.col(src).eqNullSafe(F.col("of")))
    one = F.when(F.col("rank") - F.col("first") < F.col(spare), 1).otherwise(0)
    return rows.where(~F.coalesce(tied, F.lit(False))).unionByName(some.select(*kept, (F.col(cut_words) + one).alias(cut_words), spare))


def _at(k1: Column, k2: Column, c1: Column, c2: Column) -> Column:
    return F.coalesce((k1 == c1) & (k2 == c2), F.lit(False))


def _before(k1: Column, k2: Column, c1: Column, c2: Column) -> Column:
    return F.coalesce((k1 < c1) | ((k1 == c1) & (k2 < c2)), F.lit(False))


def mix_decisions(docs: DataFrame, spec: MixSpec = MixSpec(), **columns) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: what the mix takes of each document."""
    sized, cuts = plan_mix(docs, spec, **columns)
    both = sized.join(cuts.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    place = [F.col(x) for x in ("k1", "k2", "c1", "c2")]
    if not cuts.where("spare > 0").isEmpty():
        both = _with_spare(both, _at(*place), F.col("source"), "cut_words", "spare")
    extra = F.when(_before(*place), F.col("size")).when(_at(*place), F.least("size", "cut_words")).otherwise(0)
    taken = F.col("full") * F.col("size") + extra
    return both.select("doc_id", "source", "size", "source_size", F.col("target").cast("double").alias("target"), taken.cast("long").alias("taken"))


def mix_documents(docs: DataFrame, spec: MixSpec = MixSpec(), *, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """The mix itself, with the columns of docs: a row for each epoch of a document; the one at the cut ends with its
    last word taken. Only keys are compared with the per-source cuts, so texts are never shuffled."""
    _, cuts = plan_mix(docs, spec, id_col=id_col, text_col=text_col, source_col=source_col)
    keyed, made = docs, {}
    for name, value in zip(("k1", "k2"), mix_key(spec, docs[id_col], docs[text_col]), strict=True):
        made[name] = column_named(keyed, name)
        keyed = keyed.withColumn(made[name], value)
    for c in ("source_size", "target", "full", "c1", "c2", "cut_words", "spare", "source"):
        made[c] = column_named(keyed, f"mix_{c}")
        cuts = cuts.withColumnRenamed(c, made[c])
    both = keyed.join(cuts, F.col(source_col).eqNullSafe(F.col(made["source"])))
    place = [F.col(made[x]) for x in ("k1", "k2", "c1", "c2")]
    at, before = _at(*place), _before(*place)
    if not cuts.where(F.col(made["spare"]) > 0).isEmpty():
        both = _with_spare(both, at, F.col(source_col), made["cut_words"], made["spare"])
    times = F.col(made["full"]) + F.when(before | (at & (F.col(made["cut_words"]) > 0)), 1).otherwise(0)
    epoch = column_named(both, "epoch")
    rows = both.withColumn(epoch, F.explode(F.when(times > 0, F.sequence(F.lit(1).cast("long"), times))))
    pieces = F.split(F.col(text_col), _AFTER_WORD)
    short = F.array_join(F.slice(pieces, F.lit(1), F.col(made["cut_words"]).cast("int")), "")
    text = F.when(at & (F.col(epoch) > F.col(made["full"])), short).otherwise(F.col(text_col))
    return rows.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns])
