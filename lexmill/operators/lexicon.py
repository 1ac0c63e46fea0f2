"""Trust-tiered lexicon: counts, classes, shadows, verdicts and coverage.

The lexicon is one table (form, freq, n_sources, freq_other, kind) with kind core, tail or other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import rules as R
from lexmill.functions import text as T
from lexmill.operators.corpus import word_rows
from lexmill.profile import CORROBORATION, HELDOUT_EVERY, MIN_FREQ, MIN_SOURCES, SHADOW_RATIO, SHADOW_VARIANTS, SOLO_FREQ, YAKUT, LanguageProfile
from lexmill.sources.shared import written


def word_counts(docs: DataFrame, profile: LanguageProfile = YAKUT) -> DataFrame:
    """source, tier, form, n. The one shuffle of the build; counts are combined before it."""
    return word_rows(docs, "source", "tier", profile=profile).groupBy("source", "tier", "form").agg(F.count("*").alias("n"))


def build_lexicon(counts: DataFrame) -> DataFrame:
    """Edited sources count for freq and n_sources; web and OCR ones only corroborate. A form is core if it is frequent in
    several edited sources, or very frequent in one; else tail; forms of no edited source are `other`."""
    edited = F.col("tier") == "edited"
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    out = counts.groupBy("form").agg(total(F.when(edited, F.col("n"))).alias("freq"), F.count_if(edited).alias("n_sources"), total(F.when(~edited, F.col("n"))).alias("freq_other"))
    f, s = F.col("freq"), F.col("n_sources")
    core = ((f >= MIN_FREQ) & (s >= MIN_SOURCES)) | (f >= SOLO_FREQ)
    return out.withColumn("kind", F.when(core, "core").when(f > 0, "tail").otherwise("other"))


def lexicon_summary(counts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """For each source and tier, and for both in all (nulls): forms, tokens, and the share of tokens that core covers."""
    rows = counts.join(lexicon.select("form", "kind"), "form")
    out = rows.rollup("tier", "source").agg(F.count_distinct("form").alias("forms"), F.sum("n").cast("long").alias("tokens"), F.sum(F.when(F.col("kind") == "core", F.col("n")).otherwise(0)).cast("long").alias("core_tokens"))
    return out.withColumn("core_share", F.col("core_tokens") / F.col("tokens"))


def heldout(sentences: DataFrame, every: int = HELDOUT_EVERY) -> DataFrame:
    """Each source's sentences 0, every, 2*every, ... by (doc_id, sent_idx). Numbers come from counts of sentences before a
    document, summed over ranges of documents first and inside each range then, so that no task has a whole source."""
    parts = int(sentences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    per_doc = sentences.groupBy("source", "doc_id").agg(F.count("*").alias("n"))
    dealt = written(per_doc.repartitionByRange(parts, "source", "doc_id").withColumn("part", F.spark_partition_id()), "ranges")
    ranges = dealt.groupBy("source", "part").agg(F.sum("n").alias("words"))
    earlier = F.sum("words").over(Window.partitionBy("source").orderBy("part")) - F.col("words")
    run = F.sum("n").over(Window.partitionBy("source", "part").orderBy("doc_id")) - F.col("n")
    before = dealt.withColumn("run", run).join(ranges.withColumn("earlier", earlier).drop("words"), ["source", "part"])
    before = before.select("source", "doc_id", (F.col("earlier") + F.col("run")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("source", "doc_id").orderBy("sent_idx")) - 1
    placed = sentences.withColumn("inside", inside).join(before, ["source", "doc_id"])
    return placed.where((F.col("before") + F.col("inside")) % every == 0).drop("before", "inside")


def distortions(form: Column, profile: LanguageProfile = YAKUT, limit: int = SHADOW_VARIANTS) -> Column:
    """All ways to write the form without some of its special letters; none at all if there are over `limit`. A listing of
    one form's: the search for shadows makes no variants."""
    chars = F.split(F.lower(form), "")
    choices = F.create_map(*[x for k, v in profile.shadows.items() for x in (F.lit(k), F.array(*[F.lit(c) for c in (k, *v)]))])
    options = F.transform(chars, lambda c: F.coalesce(F.try_element_at(choices, c), F.array(c)))
    size = F.aggregate(options, F.lit(1).cast("long"), lambda n, o: F.when(n <= limit, n * F.size(o)).otherwise(n))
    grown = F.aggregate(options, F.array(F.lit("")), lambda acc, o: F.flatten(F.transform(acc, lambda a: F.transform(o, lambda x: F.concat(a, x)))))
    return F.when((size > 1) & (size <= limit), F.filter(grown, lambda v: v != form))


def _plain_key(form: Column, profile: LanguageProfile) -> Column:
    """What a form shares with all its distortions: one letter for each special letter and its stand-ins. A stand-in of two
    letters adds its second one, so that is left out wherever it follows; where this doesn't fit the profile's stand-ins,
    their letters are left out everywhere."""
    group: dict[str, str] = {}
    for special, stand_ins in profile.shadows.items():
        for x in stand_ins:
            if len(x) == 1:
                keep, drop = sorted((group.get(special, special), group.get(x, x)))
                group |= {special: keep, x: keep} | {k: keep for k, v in group.items() if v == drop}
    of = lambda c: group.get(c, c)
    longer = [(special, x) for special, stand_ins in profile.shadows.items() for x in stand_ins if len(x) > 1]
    heads, tails = {of(x[0]) for _, x in longer}, {of(c) for _, x in longer for c in x[1:]}
    pairs = [(a, b) for a, b in sorted(group.items()) if a != b]
    key = F.translate(form, "".join(a for a, _ in pairs), "".join(b for _, b in pairs))
    if not longer:
        return key
    if not heads & tails and all(len(x) == 2 and of(special) == of(x[0]) for special, x in longer):
        for head in sorted(heads):
            after = "".join(sorted({of(x[1]) for _, x in longer if of(x[0]) == head}))
            key = F.regexp_replace(key, f"(?<={head})[{after}]+", "")
        return key
    gone = "".join(sorted(heads | tails | {of(special) for special, _ in longer}))
    return F.regexp_replace(key, f"[{gone}]", "")


def _distorted_pattern(form: Column, profile: LanguageProfile) -> Column:
    """A regex that matches exactly the form and its distortions."""
    either = F.create_map(*[F.lit(x) for k, v in profile.shadows.items() for x in (k, f"(?:{'|'.join((k, *v))})")])
    return F.array_join(F.transform(F.split(form, ""), lambda c: F.coalesce(F.try_element_at(either, c), c)), "")


def _n_distortions(form: Column, profile: LanguageProfile, limit: int) -> Column:
    """How many ways to write the form there are, itself included; counted no further than beyond the limit."""
    size = F.create_map(*[F.lit(x) for k, v in profile.shadows.items() for x in (k, len(v) + 1)])
    return F.aggregate(F.split(form, ""), F.lit(1).cast("long"), lambda n, c: F.when(n <= limit, n * F.coalesce(F.try_element_at(size, c), F.lit(1))).otherwise(n))


def find_shadows(lexicon: DataFrame, profile: LanguageProfile = YAKUT, limit: int | None = None) -> DataFrame:
    """Known forms that are distortions of a core form: with the most frequent such origin, and whether it is so much
    more frequent that the shadow must be an error. Forms meet by a key that distortion leaves alone and are then matched
    exactly, so a form of any number of special letters is looked at. limit: leave out origins of more distortions."""
    origins = lexicon.where((F.col("kind") == "core") & F.col("form").rlike(f"[{profile.special}]"))
    if limit is not None:
        origins = origins.where(_n_distortions(F.col("form"), profile, limit) <= limit)
    variants = origins.select(F.col("form").alias("origin"), F.col("freq").alias("freq_origin"), _plain_key(F.col("form"), profile).alias("k"), F.concat(F.lit("^(?:"), _distorted_pattern(F.col("form"), profile), F.lit(")$")).alias("like"))
    known = lexicon.where((F.col("kind") == "core") | ((F.col("kind") == "tail") & (F.col("freq_other") >= CORROBORATION)))
    known = known.select(F.col("form").alias("shadow"), F.col("freq").alias("freq_shadow"), F.col("kind").alias("where"), _plain_key(F.col("form"), profile).alias("k"))
    met = variants.join(known, "k").where((F.col("shadow") != F.col("origin")) & F.rlike("shadow", F.col("like")))
    best = met.groupBy("shadow", "freq_shadow", "where").agg(F.min(F.struct((-F.col("freq_origin")).alias("rank"), "origin", "freq_origin")).alias("best"))
    out = best.select("shadow", "freq_shadow", "where", "best.origin", "best.freq_origin")
    out = out.withColumn("ratio", F.col("freq_origin") / F.greatest("freq_shadow", F.lit(1)))
    return out.withColumn("demote", (F.col("ratio") >= SHADOW_RATIO).cast("int"))


def active(lexicon: DataFrame, shadows: DataFrame) -> DataFrame:
    """The lexicon without the demoted shadows."""
    return lexicon.join(shadows.where("demote = 1").select(F.col("shadow").alias("form")), "form", "left_anti")


def verdicts(forms: DataFrame, lexicon: DataFrame, shadows: DataFrame, *, use_tail=True, use_hyphen=True, use_grammar=False, profile: LanguageProfile = YAKUT) -> DataFrame:
    """Distinct forms (form) -> form, ok, reason, freq. In order: shadow, core, all parts accepted, tail. Forms and parts
    are looked up in one equi-join; only compounds have parts."""
    low = forms.select(F.lower("form").alias("form")).distinct()
    alive = active(lexicon, shadows).select("form", "freq", "freq_other", "kind")
    dark = shadows.where("demote = 1").select(F.col("shadow").alias("form"), F.lit(True).alias("dark"))
    known = alive.join(dark, "form", "full")

    def judged(rows: DataFrame) -> DataFrame:
        tail = F.lit(use_tail) & (F.col("kind") == "tail")
        sure = F.col("freq_other") >= CORROBORATION
        discord = (~R.is_harmonic(F.col("form"), profile)) if use_grammar else F.lit(False)
        reason = F.when(F.col("dark"), "shadow").when(F.col("kind") == "core", "core").when(tail & sure & discord, "tail-disharmonic").when(tail & sure, "tail-corroborated").when(tail, "tail-unconfirmed").otherwise("unknown")
        return rows.join(known, "form", "left").withColumn("reason", reason)

    alone = judged(low)
    ok = F.col("reason").isin("core", "tail-corroborated")
    freq = F.when(F.col("reason").isin("shadow", "unknown"), 0).otherwise(F.col("freq")).cast("long")
    if not use_hyphen:
        return alone.select("form", ok.alias("ok"), "reason", freq.alias("freq"))
    split = F.filter(F.split(F.translate("form", "’'", "--"), "-"), lambda p: p != "")
    compound = low.withColumn("parts", split).where(F.size("parts") > 1)
    pairs = compound.select(F.col("form").alias("whole"), F.explode("parts").alias("form"))
    sound = judged(pairs.select("form").distinct()).select("form", ok.alias("ok"))
    joined = pairs.join(sound, "form").groupBy("whole").agg(F.bool_and("ok").alias("parts_ok")).where("parts_ok")
    both = alone.join(joined, alone.form == joined.whole, "left")
    by_parts = F.coalesce("parts_ok", F.lit(False)) & ~F.col("reason").isin("shadow", "core")
    both = both.withColumn("freq", F.when(by_parts, 0).otherwise(freq).cast("long")).withColumn("reason", F.when(by_parts, "hyphen-parts").otherwise(F.col("reason")))
    return both.select("form", F.col("reason").isin("core", "hyphen-parts", "tail-corroborated").alias("ok"), "reason", "freq")


def coverage(counts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Shares of tokens in core, in tail, and in neither, by source and by tier (source null). `miss` ignores verdicts."""
    kind = F.coalesce("kind", F.lit("other"))
    rows = counts.join(lexicon.select("form", "kind"), "form", "left")
    n = lambda k: F.sum(F.when(kind == k, F.col("n")).otherwise(0)).cast("long")
    out = rows.groupingSets([["tier", "source"], ["tier"]], "tier", "source").agg(F.sum("n").cast("long").alias("tokens"), n("core").alias("core"), n("tail").alias("tail"), n("other").alias("miss"))
    return out.withColumn("miss_share", F.col("miss") / F.col("tokens"))


def top_missing(counts: DataFrame, lexicon: DataFrame, tier: str = "edited", n: int = 300) -> DataFrame:
    """The most frequent forms of a tier that core lacks: a top-k report."""
    miss = counts.where(F.col("tier") == tier).join(lexicon.where("kind = 'core'").select("form"), "form", "left_anti")
    return miss.groupBy("form").agg(F.sum("n").cast("long").alias("n")).orderBy(F.desc("n"), "form").limit(n)


def unknown_by_tier(counts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """tier, form, n of forms that aren't core; shadows that are in core count as known here."""
    miss = counts.join(lexicon.where("kind = 'core'").select("form"), "form", "left_anti")
    return miss.groupBy("tier", "form").agg(F.sum("n").cast("long").alias("n"))


def acceptor_ablation(counts: DataFrame, lexicon: DataFrame, shadows: DataFrame, profile: LanguageProfile = YAKUT) -> DataFrame:
    """Share of tokens that each configuration rejects, by tier: core only, with compounds, with the tail as well."""
    forms = counts.select("form").distinct()
    out = None
    for name, options in (("core", {"use_tail": False, "use_hyphen": False}), ("hyphen", {"use_tail": False}), ("tail", {})):
        v = verdicts(forms, lexicon, shadows, profile=profile, **options).select("form", "ok")
        rows = counts.join(v, "form").groupBy("tier").agg(F.sum("n").cast("long").alias("tokens"), F.sum(F.when(~F.col("ok"), F.col("n")).otherwise(0)).cast("long").alias("rejected"))
        rows = rows.select(F.lit(name).alias("config"), "tier", "tokens", "rejected", (F.col("rejected") / F.col("tokens")).alias("share"))
        out = rows if out is None else out.unionByName(rows)
    return out


def rule_agreement(counts: DataFrame, lexicon: DataFrame, profile: LanguageProfile = YAKUT) -> DataFrame:
    """Share of core types and tokens that each rule objects to."""
    core = counts.join(lexicon.where("kind = 'core'").select("form"), "form").groupBy("form").agg(F.sum("n").cast("long").alias("n"))
    hits = core.select("form", "n", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), R.hits(r, F.col("form"), profile).alias("hit")) for r in R.ALL])).alias("r"))
    out = hits.groupBy("r.rule").agg(F.count("*").alias("types"), F.sum("n").cast("long").alias("tokens"), F.count_if("r.hit").alias("types_hit"), F.sum(F.when(F.col("r.hit"), F.col("n")).otherwise(0)).cast("long").alias("tokens_hit"))
    return out.withColumns({"types_share": F.col("types_hit") / F.col("types"), "tokens_share": F.col("tokens_hit") / F.col("tokens")})


def front_coded(forms: DataFrame, most: int = 40) -> DataFrame:
    """Forms in order as (head, prefix, tail): how many letters each shares with the form before it among those of equal
    first letter, where a new block starts. Blocks by first letter are what keeps the coding parallel."""
    head = F.substring("form", 1, 1)
    w = Window.partitionBy("head").orderBy("form")
    rows = forms.select("form", head.alias("head")).withColumn("prev", F.coalesce(F.lag("form").over(w), F.lit("")))
    same = F.filter(F.sequence(F.lit(0), F.least(F.length("form"), F.length("prev"), F.lit(most))), lambda i: F.substring("form", F.lit(1), i) == F.substring("prev", F.lit(1), i))
    rows = rows.withColumn("prefix", F.array_max(same))
    return rows.select("head", "form", "prefix", F.substring("form", F.col("prefix") + 1, F.length("form")).alias("tail"))


def quantised(freq: Column) -> Column:
    """A frequency as a byte: sixteenths of its base-2 logarithm."""
    return F.least(F.lit(255), F.floor(F.log2(freq + 1) * 16)).cast("int")


def dequantised(code: Column) -> Column:
    return F.pow(F.lit(2.0), code / 16)
