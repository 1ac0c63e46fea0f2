"""Candidates for words that the lexicon rejects: restoration, weighted edit distance, shadows; ranking.

Everything here works on distinct lower-cased words. Neither search compares all words with all forms: restoration is an
equi-join on a folded key, the edit-distance search one on hashed deletion variants and blocks, whose pairs are then
priced exactly.
"""

from __future__ import annotations

import re
from itertools import combinations, product

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import rules as R
from lexmill.functions.distance import distance_column
from lexmill.operators import lm as L
from lexmill.profile import CHEAP_COST, CHEAP_ENOUGH, FREQ_RATIO, FREQ_WEIGHT, GRAMMAR_PENALTY, LM_WEIGHT, MAX_MINE_COST, MAX_SEARCH_COST, MAX_VARIANTS, MIN_WRONG_FREQ, NEIGHBOUR_COST, YAKUT, LanguageProfile


def folded(word: Column, profile: LanguageProfile = YAKUT) -> Column:
    """The word with every stand-in letter restored: what words that differ by restoration share."""
    return F.translate(word, *profile.restore)


def _changes(word: Column, form: Column) -> Column:
    """Places, over the shorter length, at which the two differ."""
    n = F.least(F.length(word), F.length(form))
    return F.size(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & (F.substring(word, i, F.lit(1)) != F.substring(form, i, F.lit(1)))))


def _within_cap(word: Column, form: Column, profile: LanguageProfile) -> Column:
    """A word with over 12 ambiguous letters restores г, о, у only, and of these the last 12 at most."""
    bits = MAX_VARIANTS.bit_length() - 1
    stand_in = f"[^{profile.restore[0]}]"
    many = F.length(F.regexp_replace(word, stand_in, "")) > bits
    changed = F.filter(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(word, i, F.lit(1)) != F.substring(form, i, F.lit(1)))
    late = lambda i: F.length(F.regexp_replace(F.substring(word, i, F.length(word)), "[^гоу]", "")) <= bits
    return ~many | F.forall(changed, lambda i: F.substring(word, i, F.lit(1)).isin("г", "о", "у") & late(i))


def restore_candidates(words: DataFrame, forms: DataFrame, profile: LanguageProfile = YAKUT) -> DataFrame:
    """(word) x (form, freq) -> word, form, freq, cost of every restoration of a word that is a form."""
    w = words.select("word").distinct().withColumn("key", folded(F.col("word"), profile))
    f = forms.select("form", "freq")
    alike = w.join(f.withColumn("key", folded(F.col("form"), profile)), "key").where("word <> form")
    fits = F.forall(F.sequence(F.lit(1), F.length("word")), lambda i: F.substring("form", i, F.lit(1)).isin(F.substring("word", i, F.lit(1)), F.substring("key", i, F.lit(1))))
    out = alike.where((F.length("word") == F.length("form")) & fits & _within_cap(F.col("word"), F.col("form"), profile)).select("word", "form", "freq")
    if profile.digraph:
        pair, letter = profile.digraph
        whole = w.where(F.col("word").contains(pair)).select("word", F.replace("word", F.lit(pair), F.lit(letter)).alias("form"))
        out = out.unionByName(whole.join(f, "form").select("word", "form", "freq"))
    cost = CHEAP_COST * F.greatest(F.lit(1), _changes(F.col("word"), F.col("form")))
    return out.withColumn("cost", cost.cast("int"))


def ambiguous_letters(word: Column, profile: LanguageProfile = YAKUT) -> Column:
    return F.length(F.regexp_replace(F.lower(word), f"[^{profile.restore[0]}]", ""))


def restoration_variants(word: Column, profile: LanguageProfile = YAKUT, most: int = MAX_VARIANTS) -> Column:
    """The word's restorations as an array, fewest changes first, then by letters. A word of over `most` variants restores
    г, о, у only, and of these the last that make up `most`."""
    low, bits = F.lower(word), most.bit_length() - 1
    table = F.create_map(*[F.lit(x) for kv in zip(*profile.restore, strict=True) for x in kv])
    late = lambda i: F.length(F.regexp_replace(F.substring(low, i + 1, F.length(low)), "[^гоу]", "")) <= bits
    few = ambiguous_letters(word, profile) <= bits
    options = F.transform(F.split(low, ""), lambda c, i: F.array_compact(F.array(c, F.when(few | c.isin("г", "о", "у") & late(i), F.try_element_at(table, c)))))
    grown = F.aggregate(options, F.array(F.lit("")), lambda acc, o: F.flatten(F.transform(acc, lambda a: F.transform(o, lambda x: F.concat(a, x)))))
    if profile.digraph:
        pair, letter = profile.digraph
        grown = F.array_distinct(F.concat(grown, F.array(F.replace(low, F.lit(pair), F.lit(letter)))))
    ranked = F.array_sort(F.transform(grown, lambda v: F.struct(F.when(F.length(v) == F.length(low), _changes(low, v)).otherwise(1).alias("n"), v.alias("v"))))
    return F.transform(ranked, lambda x: x["v"])


def first_harmonic(word: str, profile: LanguageProfile = YAKUT, most: int = MAX_VARIANTS) -> str | None:
    """The first of the word's restoration variants that is harmonic; the word is lower-cased, no loanword and not harmonic.
    Only vowels matter to harmony, so the first one restores vowels alone, as few as it can: found letter by letter, with the
    best way to each of the few states that the rest depends on, in place of trying all variants."""
    table, bits = dict(zip(*profile.restore, strict=True)), most.bit_length() - 1
    few = sum(c in table for c in word) <= bits
    open_ = [few or (c in "гоу" and sum(x in "гоу" for x in word[i:]) <= bits) for i, c in enumerate(word)]
    vowels, double = set(profile.short_vowels), {*profile.long_vowels, *profile.diphthongs}
    allowed = set(profile.follows)
    if any(c in table and (c in vowels) != (table[c] in vowels) for c in word):  # a letter that becomes a vowel
        nucleus = re.compile(profile.nuclei)
        slots = [(c, table[c]) if c in table and (few or open_[i]) else (c,) for i, c in enumerate(word)]
        fits = lambda v: all(f"{p}→{q}" in allowed for x in v.split("-") for n in [nucleus.findall(x)] for p, q in zip(n, n[1:], strict=False))
        every = sorted((sum(map(str.__ne__, v, word)), "".join(v)) for v in product(*slots))
        return next((v for n, v in every if n and (fits(v) or set(v) & set(profile.loan_letters))), None)
    choices = [[c, table[c]] if c in vowels and open_[i] and table.get(c) in vowels else [c] for i, c in enumerate(word)]
    # for each place: (nucleus before, letter already chosen or None) -> the fewest changes and the first text that lead there
    ways: list[dict[tuple, tuple[int, str]]] = [{} for _ in range(len(word) + 2)]
    ways[0][None, None] = (0, "")

    def reach(place, state, made):
        if state not in ways[place] or made < ways[place][state]:
            ways[place][state] = made

    for i in range(len(word)):
        for (before, chosen), (paid, text) in ways[i].items():
            for c in [chosen] if chosen else choices[i]:
                cost, longer = paid + (not chosen and c != word[i]), text + c
                if c not in vowels:
                    reach(i + 1, (None if c == "-" else before, None), (cost, longer))
                elif i + 1 < len(word) and word[i + 1] in vowels:
                    for d in choices[i + 1]:
                        pair, more = c + d in double, cost + (d != word[i + 1])
                        if before is None or f"{before}→{c + d if pair else c}" in allowed:
                            reach(i + 2 if pair else i + 1, (c + d, None) if pair else (c, d), (more, longer + d if pair else longer))
                elif before is None or f"{before}→{c}" in allowed:
                    reach(i + 1, (c, None), (cost, longer))
    found = min(ways[len(word)].values(), default=(0, ""))
    return found[1] if found[0] else None


def harmonic_variant(word: Column, profile: LanguageProfile = YAKUT) -> Column:
    """first_harmonic as a column, and by trying all variants for a profile in which other letters than vowels matter."""
    targets, vowels = profile.restore[1], set(profile.short_vowels)
    turned = [a for a, b in zip(*profile.restore, strict=True) if (a in vowels) != (b in vowels) and a not in profile.loan_letters and not a.isascii()]
    if profile.name != "yakut" or turned or set(targets) & set(profile.loan_letters):
        return F.get(F.filter(restoration_variants(word, profile), lambda v: (v != word) & R.is_harmonic(v, profile)), F.lit(0))

    @F.pandas_udf("string")
    def of(words: pd.Series) -> pd.Series:
        return words.map(lambda w: first_harmonic(w, profile))

    return of.asNondeterministic()(word)  # else a filter on it is pushed below joins and it is made twice


def skeleton(word: Column, profile: LanguageProfile = YAKUT) -> Column:
    """The word with one letter for each class of letters that cheap substitutions connect."""
    group: dict[str, str] = {}
    for a, b in profile.cheap.split():
        keep, drop = sorted((group.get(a, a), group.get(b, b)))
        group |= {a: keep, b: keep} | {k: keep for k, v in group.items() if v == drop}
    pairs = [(a, b) for a, b in sorted(group.items()) if a != b]
    return F.translate(word, "".join(a for a, _ in pairs), "".join(b for _, b in pairs))


def _without(s: Column, i: Column) -> Column:
    return F.concat(F.substring(s, F.lit(1), i), F.substring(s, i + 2, F.length(s)))


def deletion_rows(rows: DataFrame, s: Column, edits: int) -> DataFrame:
    """The rows, each with `k`: hashes of the string without up to `edits` letters, one or two. By explodes of places, as
    code for them is generated; of equal letters side by side the first alone is left out."""
    out = rows.withColumn("__v", s)
    for step in range(edits):
        # a place beyond the end leaves the string alone; the second letter left out comes after the first
        first = F.col("__at") if step else F.lit(0)
        out = out.withColumn("__at", F.explode_outer(F.sequence(first, F.greatest(F.length("__v"), first))))
        at, from_ = F.col("__at"), F.col("__from") if step else F.lit(0)
        twin = (at > from_) & (at < F.length("__v")) & (F.substring("__v", at, F.lit(1)) == F.substring("__v", at + 1, F.lit(1)))
        out = out.where(~twin).withColumn("__v", F.when(at < F.length("__v"), _without(F.col("__v"), at)).otherwise(F.col("__v"))).withColumn("__from", at)
    return out.withColumn("k", F.xxhash64("__v")).drop("__v", "__at", "__from")


def _sixths(word: Column) -> Column:
    """Hashes of (length, which, letters) of any three of six parts: three substitutions leave three parts alone. Half of a
    word's letters make a key that few words share."""
    n = F.length(word)
    cut = lambda k: F.floor(n * k / 6).cast("int")
    part = [F.substring(word, cut(k) + 1, cut(k + 1) - cut(k)) for k in range(6)]
    return F.array(*[F.xxhash64(n, F.lit(i), F.concat(*[part[k] for k in some])) for i, some in enumerate(combinations(range(6), 3))])


def edit_candidates(words: DataFrame, forms: DataFrame, max_cost: int = MAX_SEARCH_COST, profile: LanguageProfile = YAKUT) -> DataFrame:
    """word, form, freq, cost of every form within max_cost, itself excepted. Cheap substitutions vanish in skeletons; any
    other edit costs 70 at least, so skeletons are two edits apart, or three substitutions of keyboard neighbours are
    all there is. Both cases are equi-joins; pairs are made distinct, then priced."""
    # few bytes but much work a row: by number, as else these would be put together into a few tasks
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    w = words.select("word").distinct().repartition(parts, "word")
    f = forms.select("form", "freq").distinct().repartition(parts, "form")
    edits = 2
    left = deletion_rows(w, skeleton(F.col("word"), profile), edits)
    right = deletion_rows(f, skeleton(F.col("form"), profile), edits)
    near = lambda d: F.abs(F.length("word") - F.length("form")) <= d
    pairs = left.join(right, "k").where(near(max_cost // 100)).select("word", "form", "freq")
    if max_cost >= 210:
        q = w.select("word", F.explode(_sixths(F.col("word"))).alias("k"))
        few = F.levenshtein("word", "form", max_cost // NEIGHBOUR_COST) >= 0
        pairs = pairs.unionByName(q.join(f.select("form", "freq", F.explode(_sixths(F.col("form"))).alias("k")), "k").where(near(0) & few).select("word", "form", "freq"))
    pairs = pairs.where("word <> form").distinct()
    priced = pairs.withColumn("cost", distance_column(F.col("word"), F.col("form"), profile, max_cost)).where(F.col("cost") <= max_cost)
    return priced.select("word", "form", "freq", "cost")


def mine_errors(unknown: DataFrame, forms: DataFrame, profile: LanguageProfile = YAKUT) -> DataFrame:
    """(tier, form, n) -> tier, wrong, right, cost, freq_wrong, freq_right: of the eight cheapest forms near an unknown
    one the first that is twenty times as frequent."""
    often = unknown.where(F.col("n") >= MIN_WRONG_FREQ)
    near = edit_candidates(often.select(F.col("form").alias("word")), forms, MAX_MINE_COST, profile)
    top = Window.partitionBy("word").orderBy("cost", F.desc("freq"), "form")
    near = near.withColumn("rank", F.row_number().over(top)).where("rank <= 8").withColumnsRenamed({"form": "right", "freq": "freq_right"})
    found = often.select("tier", F.col("form").alias("word"), F.col("n").alias("freq_wrong")).join(near, "word").where(F.col("freq_right") >= F.col("freq_wrong") * FREQ_RATIO)
    best = found.groupBy("tier", "word", "freq_wrong").agg(F.min(F.struct("rank", "right", "cost", "freq_right")).alias("b"))
    return best.select("tier", F.col("word").alias("wrong"), "b.right", "b.cost", "freq_wrong", "b.freq_right")


def candidates(words: DataFrame, core: DataFrame, shadows: DataFrame, *, fuzzy: bool = True, grammar: bool = True, out_of_lexicon: bool = True, penalty: int = GRAMMAR_PENALTY, keep: int = 30, profile: LanguageProfile = YAKUT) -> DataFrame:
    """(word) -> word, form, cost, freq, kind, penalty, all stages merged: restoration wins over a shadow's origin; the
    edit search runs only for words without a cheap candidate, and replaces one only if it is cheaper; harmony proposes a
    form of its own only where nothing else was found."""
    w = words.select("word").distinct()
    alive = core.select("form", "freq")
    restored = restore_candidates(w, alive, profile).withColumn("kind", F.lit("restore"))
    dark = w.join(shadows.where("demote = 1").select(F.col("shadow").alias("word"), F.col("origin").alias("form")), "word").join(alive, "form", "left")
    dark = dark.select("word", "form", F.coalesce("freq", F.lit(1)).cast("long").alias("freq"), F.lit(1).alias("cost"), F.lit("shadow").alias("kind"))
    dark = dark.join(restored.select("word", "form"), ["word", "form"], "left_anti")
    found = restored.unionByName(dark)
    if fuzzy:
        cheap = found.where(F.col("cost") <= CHEAP_ENOUGH).select("word").distinct()
        near = edit_candidates(w.join(cheap, "word", "left_anti"), alive, MAX_SEARCH_COST, profile)
        rank = F.row_number().over(Window.partitionBy("word").orderBy("cost", F.desc("freq"), "form"))
        near = near.withColumn("r", rank).where(F.col("r") <= keep).drop("r").withColumn("kind", F.lit("fuzzy"))
        stage = F.when(F.col("kind") == "fuzzy", 1).otherwise(0)
        both = found.unionByName(near).groupBy("word", "form").agg(F.min(F.struct("cost", stage.alias("stage"), "kind", "freq")).alias("b"))
        found = both.select("word", "form", "b.freq", "b.cost", "b.kind")
    if grammar and out_of_lexicon:
        none = w.join(found.select("word").distinct(), "word", "left_anti").where(~R.is_harmonic(F.col("word"), profile))
        own = none.withColumn("form", harmonic_variant(F.col("word"), profile)).where("form is not null")
        cost = CHEAP_COST * F.greatest(F.lit(1), _changes(F.col("word"), F.col("form")))
        found = found.unionByName(own.select("word", "form", F.lit(1).cast("long").alias("freq"), cost.cast("int").alias("cost"), F.lit("grammar").alias("kind")))
    fine = R.is_harmonic(F.col("form"), profile) if grammar and penalty else F.lit(True)
    return found.withColumn("penalty", F.when(fine, 0).otherwise(penalty))


def score(found: DataFrame) -> Column:
    """Lower is better: cost and penalty, less the weight of the context if there is one, else of the frequency."""
    base = F.col("cost") + F.col("penalty")
    alone = base - FREQ_WEIGHT * F.log10(F.greatest("freq", F.lit(1)))
    return F.when(F.col("context").isNotNull(), base - LM_WEIGHT * F.col("context")).otherwise(alone) if "context" in found.columns else alone


def restore_case(source: Column, form: Column) -> Column:
    """The form in the case of the word it replaces: as it is, all capitals, or a capital first letter only."""
    upper = (source == F.upper(source)) & (source != F.lower(source))
    first = F.substring(source, 1, 1)
    capital = (first == F.upper(first)) & (first != F.lower(first))
    low = source == F.lower(source)
    return F.when(low, form).when(upper, F.upper(form)).when(capital, F.concat(F.upper(F.substring(form, 1, 1)), F.lower(F.substring(form, F.lit(2), F.length(form))))).otherwise(form)


def suggest(occurrences: DataFrame, found: DataFrame, model: tuple[DataFrame, DataFrame] | None = None, top: int = 5) -> DataFrame:
    """Occurrences (key columns, word, left, right) with candidates -> the same with form, cost, freq, kind, penalty,
    context, score and rank up to `top`. Context re-scores occurrences; with no model frequency decides."""
    keys = occurrences.columns
    rows = occurrences.join(found, "word")
    if model is not None:
        rows = L.scored(rows.withColumnsRenamed({"word": "__w", "form": "word"}), *model).withColumnsRenamed({"word": "form", "__w": "word"})
        rows = rows.withColumn("context", F.when(F.col("left").isNotNull() | F.col("right").isNotNull(), F.col("context")))
    return ranked(rows, keys, top)


def ranked(rows: DataFrame, keys: list[str], top: int = 5) -> DataFrame:
    """Candidates (form, cost, freq, kind, penalty, perhaps context) with score and rank up to `top` among those of equal
    keys."""
    rows = rows if "context" in rows.columns else rows.withColumn("context", F.lit(None).cast("double"))
    stage = F.element_at(F.create_map(*[F.lit(x) for kv in {"userdict": -1, "shadow": 0, "restore": 1, "fuzzy": 2, "grammar": 3}.items() for x in kv]), F.col("kind"))
    rows = rows.withColumn("score", score(rows))
    w = Window.partitionBy(*keys).orderBy("score", stage, "cost", F.desc("freq"), "form")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
