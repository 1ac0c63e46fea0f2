"""The spelling engine: verdicts, suggestions and corrections of whole corpora in one plan.

Candidates depend on a word's lower-cased form alone, so they are searched once for each distinct rejected form; only
the context scores belong to occurrences.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions import rules as R
from lexmill.functions import text as T
from lexmill.operators import candidates as C
from lexmill.operators import lexicon as X
from lexmill.operators import lm as L
from lexmill.operators.corpus import dealt
from lexmill.operators.errors import diff_words
from lexmill.profile import BOS, EOS, GRAMMAR_PENALTY, YAKUT, LanguageProfile
from lexmill.sources.shared import perhaps_in, written


@dataclass
class UserDict:
    """Words that a user accepts, and replacements that a user asks for; keys are lower-cased."""

    accept: set[str] = field(default_factory=set)
    replace: dict[str, str] = field(default_factory=dict)

    def add(self, *words: str) -> None:
        self.accept |= {w.lower() for w in words if w}

    def remove(self, *words: str) -> None:
        for w in words:
            self.accept.discard(w.lower())
            self.replace.pop(w.lower(), None)

    def add_replacement(self, wrong: str, right: str) -> None:
        self.replace[wrong.lower()] = right

    def __len__(self) -> int:
        return len(self.accept) + len(self.replace)

    def accepts(self, word: str) -> bool:
        """A word with a replacement isn't accepted; a compound is if all its parts are."""
        low = word.lower()
        if low in self.replace:
            return False
        pieces = [p for p in low.split("-") if p]
        return low in self.accept or (len(pieces) > 1 and all(p in self.accept for p in pieces))

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        return spark.createDataFrame([(w,) for w in sorted(self.accept)], "form string"), spark.createDataFrame(sorted(self.replace.items()), "form string, replacement string")


def user_accepted(forms: DataFrame, accept: DataFrame, replace: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """Forms that the user's words accept: whole, or part by part, where at least one part is the user's and the lexicon's
    verdicts (form, ok), if given, may stand in for the others."""
    low = forms.select("form").distinct().join(replace.select("form"), "form", "left_anti")
    mine = accept.select("form", F.lit(True).alias("mine"))
    whole = low.join(accept.select("form"), "form", "left_semi")
    pieces = low.withColumn("parts", F.filter(F.split("form", "-"), lambda p: p != "")).where((F.size("parts") > 1))
    rows = pieces.select(F.col("form").alias("whole"), F.explode("parts").alias("form")).join(mine, "form", "left")
    rows = rows.join(verdicts.select("form", "ok"), "form", "left") if verdicts is not None else rows.withColumn("ok", F.lit(False))
    good = rows.groupBy("whole").agg(F.bool_or(F.coalesce("mine", F.lit(False))).alias("any_mine"), F.bool_and(F.coalesce("mine", F.lit(False)) | F.coalesce("ok", F.lit(False))).alias("all_ok"))
    return whole.unionByName(good.where("any_mine and all_ok").select(F.col("whole").alias("form"))).distinct()


_SUGGESTIONS = "array<struct<rank:int,form:string,cost:int,freq:bigint,kind:string,score:double>>"


def _sorted_suggestions():
    return F.array_sort(F.collect_list(F.struct("rank", "form", "cost", "freq", "kind", "score"))).alias("suggestions")


@dataclass
class Engine:
    lexicon: DataFrame
    shadows: DataFrame
    model: tuple[DataFrame, DataFrame] | None = None
    userdict: UserDict = field(default_factory=UserDict)
    profile: LanguageProfile = YAKUT
    use_tail: bool = True
    grammar: bool = True
    grammar_penalty: int = GRAMMAR_PENALTY
    out_of_lexicon: bool = True
    tail_grammar: bool = False
    fuzzy: bool = True
    flag_rules: tuple[str, ...] = ()
    max_suggestions: int = 5

    @property
    def core(self) -> DataFrame:
        return X.active(self.lexicon, self.shadows).where("kind = 'core'").select("form", "freq")

    def occurrences(self, docs: DataFrame) -> DataFrame:
        """doc_id, pos, piece, word, start, word_idx, left, right of each word. One shuffle, of the texts by document, and
        one sort; neighbours are those of the rows of words."""
        p = self.profile
        rows = dealt(docs).select("doc_id", F.posexplode_outer(T.pieces(F.col("text"), p)).alias("pos", "piece")).where("pos is not null")
        order = Window.partitionBy("doc_id").orderBy("pos")
        start = F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.length("piece")
        words = rows.withColumn("start", start).where(T.is_word(F.col("piece"), p)).withColumn("word", F.lower("piece"))
        words = words.withColumn("word_idx", F.row_number().over(order) - 1)
        return words.withColumns({"left": F.coalesce(F.lag("word").over(order), F.lit(BOS)), "right": F.coalesce(F.lead("word").over(order), F.lit(EOS))})

    def places(self, docs: DataFrame) -> DataFrame:
        """doc_id, pos, piece, word of each word, with no shuffle."""
        rows = docs.select("doc_id", F.posexplode_outer(T.pieces(F.col("text"), self.profile)).alias("pos", "piece"))
        return rows.where(T.is_word(F.col("piece"), self.profile)).withColumn("word", F.lower("piece"))

    def words(self, docs: DataFrame) -> DataFrame:
        """word: each distinct one in lower case. Written, as verdicts read them several times."""
        rows = docs.select(F.explode_outer(T.lower_words(F.col("text"), self.profile)).alias("word")).where("word is not null")
        return written(rows.distinct(), "words")

    def judged(self, words: DataFrame) -> DataFrame:
        """(word), distinct and in lower case -> word, reason and the user's replacement of those that are issues."""
        spark, forms = words.sparkSession, words.select(F.col("word").alias("form"))
        verdicts = X.verdicts(forms, self.lexicon, self.shadows, use_tail=self.use_tail, use_grammar=self.tail_grammar, profile=self.profile)
        reason = F.when(~F.col("ok"), F.col("reason"))
        if self.flag_rules:
            reason = reason.when(~R.is_wellformed(F.col("form"), self.flag_rules, self.profile), "grammar")
        verdicts = verdicts.select(F.col("form").alias("word"), reason.alias("reason"), F.lit(None).cast("string").alias("replacement"))
        if len(self.userdict):
            accept, replace = self.userdict.tables(spark)
            parts = forms.select(F.explode(F.split("form", "-")).alias("form")).where("form <> ''").distinct()
            known = X.verdicts(parts, self.lexicon, self.shadows, use_tail=self.use_tail, use_hyphen=False, profile=self.profile)
            fine = user_accepted(forms, accept, replace, known).select(F.col("form").alias("word"))
            forced = replace.select(F.col("form").alias("word"), F.col("replacement").alias("r"))
            verdicts = verdicts.join(fine, "word", "left_anti").join(forced, "word", "left")
            verdicts = verdicts.select("word", F.when(F.col("r").isNotNull(), "userdict").otherwise(F.col("reason")).alias("reason"), F.col("r").alias("replacement"))
        return verdicts.where("reason is not null")

    def found(self, words: DataFrame) -> DataFrame:
        """Candidates of words, by this engine's options."""
        return C.candidates(words, self.core, self.shadows, fuzzy=self.fuzzy, grammar=self.grammar, out_of_lexicon=self.out_of_lexicon, penalty=self.grammar_penalty if self.grammar else 0, profile=self.profile)

    def advice(self, words: DataFrame) -> DataFrame:
        """(word), distinct and in lower case -> word, reason, suggestions (null: none) of those that are issues: all that a
        check without a model needs to know, as then no occurrence has a say. Forms are in lower case."""
        judged = written(self.judged(words), "rejected")
        ranked = C.ranked(self.found(judged.where("replacement is null").select("word")), ["word"], self.max_suggestions)
        best = ranked.groupBy("word").agg(_sorted_suggestions())
        forced = F.array(F.struct(F.lit(1), F.col("replacement"), F.lit(0), F.lit(10**9), F.lit("userdict"), F.lit(0.0))).cast(_SUGGESTIONS)
        return judged.join(best, "word", "left").select("word", "reason", F.when(F.col("replacement").isNotNull(), forced).otherwise(F.col("suggestions").cast(_SUGGESTIONS)).alias("suggestions"))

    def suggestions(self, issues: DataFrame) -> DataFrame:
        """Issues with their best candidates by the model: form in the word's case, cost, freq, kind, score, rank."""
        asked = issues.where("replacement is null")
        found = written(self.found(asked.select("word")), "candidates")
        keys = ["doc_id", "pos", "piece", "word", "left", "right"]
        rows = C.suggest(asked.select(*keys), found, self.model, self.max_suggestions)
        rows = rows.select("doc_id", "pos", "piece", "form", "cost", "freq", "kind", "score", "rank")
        forced = issues.where("replacement is not null").select("doc_id", "pos", "piece", F.col("replacement").alias("form"), F.lit(0).alias("cost"), F.lit(10**9).cast("long").alias("freq"), F.lit("userdict").alias("kind"), F.lit(0.0).alias("score"), F.lit(1).alias("rank"))
        return rows.unionByName(forced).withColumn("form", C.restore_case(F.col("piece"), F.col("form")))

    def _issues(self, docs: DataFrame) -> DataFrame:
        """Occurrences that are issues, for a check by the model. Written, as they are read several times."""
        judged = written(self.judged(self.words(docs)), "rejected")
        return written(perhaps_in(self.occurrences(docs), "word", judged).join(judged, "word"), "issues")

    def check(self, docs: DataFrame, wanted: str = "true") -> DataFrame:
        """doc_id, start, end, word_idx, before, reason and the array of suggestions of each issue. wanted: a condition on
        reason and suggestions that issues have to meet."""
        if self.model is None:
            advice = written(self.advice(self.words(docs)).where(wanted), "advice")
            rows = perhaps_in(self.occurrences(docs).drop("left", "right"), "word", advice).join(advice, "word")
            cased = lambda s: F.struct(s["rank"].alias("rank"), C.restore_case(F.col("piece"), s["form"]).alias("form"), *[s[c].alias(c) for c in ("cost", "freq", "kind", "score")])
            rows = rows.withColumn("suggestions", F.transform("suggestions", cased))
        else:
            issues = self._issues(docs)
            rows = issues.join(self.suggestions(issues).groupBy("doc_id", "pos").agg(_sorted_suggestions()), ["doc_id", "pos"], "left").where(wanted)
        return rows.select("doc_id", F.col("start").cast("long").alias("start"), (F.col("start") + F.length("piece")).cast("long").alias("end"), F.col("word_idx").cast("long").alias("word_idx"), F.col("piece").alias("before"), "reason", "suggestions")

    def corrections(self, docs: DataFrame) -> DataFrame:
        """Issues that have a suggestion: doc_id, start, end, before, after, source, alternatives."""
        rows = self.check(docs, "suggestions is not null")
        return rows.select("doc_id", "start", "end", "before", F.get("suggestions", F.lit(0))["form"].alias("after"), F.col("reason").alias("source"), F.transform("suggestions", lambda s: s["form"]).alias("alternatives"))

    def correct(self, docs: DataFrame) -> DataFrame:
        """doc_id, text with the first suggestion of each issue put in."""
        if self.model is None:
            first = F.get("suggestions", F.lit(0))["form"].alias("form")
            new = written(self.advice(self.words(docs)).where("suggestions is not null").select("word", first), "advice")
            changes = perhaps_in(self.places(docs), "word", new).join(new, "word").withColumn("new", C.restore_case(F.col("piece"), F.col("form")))
        else:
            changes = self.suggestions(self._issues(docs)).where("rank = 1").withColumnRenamed("form", "new")
        return self._changed(docs, changes)

    def _changed(self, docs: DataFrame, changes: DataFrame) -> DataFrame:
        """Documents with changes (doc_id, pos, new) put in: of the token rows only these are moved."""
        per = changes.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "new"))).alias("changes"))
        made = docs.select("doc_id", "text").join(per, "doc_id", "left")
        return made.select("doc_id", F.coalesce(T.spliced(F.col("text"), F.col("changes"), self.profile), F.lit("")).alias("text"))

    def merge_tagger(self, docs: DataFrame) -> DataFrame:
        """docs (doc_id, text, restored by a tagger) -> corrections of both: the tagger's by word number, unless it changed
        how many words there are; the checker's on the restored text; where both speak the checker has the last word."""
        p = self.profile
        same = F.size(T.words(F.col("text"), p)) == F.size(T.words(F.col("restored"), p))
        used = docs.withColumn("staged", F.when(same, F.col("restored")).otherwise(F.col("text")))
        moved = used.select("doc_id", F.inline(diff_words(F.col("text"), F.col("staged"), p))).select("doc_id", F.col("pos").cast("long").alias("word_idx"), F.col("before").alias("t_before"), F.col("after").alias("t_after"))
        checked = self.check(used.select("doc_id", F.col("staged").alias("text"))).where("suggestions is not null")
        checked = checked.select("doc_id", "word_idx", "before", "reason", F.transform("suggestions", lambda s: s["form"]).alias("alternatives"))
        places = self.occurrences(docs).select("doc_id", F.col("word_idx").cast("long").alias("word_idx"), F.col("piece").alias("original"), F.col("start").cast("long").alias("start"))
        both = moved.join(checked, ["doc_id", "word_idx"], "full").join(places, ["doc_id", "word_idx"])
        source = F.when(F.col("t_after").isNull(), F.col("reason")).when(F.col("reason").isNull(), "tagger").otherwise("tagger+lexicon")
        return both.select("doc_id", "start", (F.col("start") + F.length("original")).alias("end"), F.col("original").alias("before"), F.coalesce(F.get("alternatives", F.lit(0)), "t_after").alias("after"), source.alias("source"), F.coalesce("alternatives", F.array("t_after")).alias("alternatives"))

    def spell(self, words: DataFrame) -> DataFrame:
        """(word) -> form, ok, reason, freq of each distinct word."""
        return X.verdicts(words.select(F.col("word").alias("form")), self.lexicon, self.shadows, use_tail=self.use_tail, use_grammar=self.tail_grammar, profile=self.profile)

    def suggest(self, words: DataFrame) -> DataFrame:
        """(word[, left, right]) -> word, form, cost, freq, kind, score, rank, whatever the verdict."""
        rows = words.withColumn("piece", F.col("word")).withColumn("word", F.lower("word"))
        for c in ("left", "right"):
            rows = rows if c in rows.columns else rows.withColumn(c, F.lit(None).cast("string"))
        found = self.found(rows.select("word"))
        out = C.suggest(rows.select("piece", "word", "left", "right").distinct(), found, self.model, self.max_suggestions)
        return out.select(F.col("piece").alias("word"), C.restore_case(F.col("piece"), F.col("form")).alias("form"), "cost", "freq", "kind", "score", "rank")

    def clean(self, docs: DataFrame) -> DataFrame:
        """doc_id, text with known shadows put right and nothing else: lower-case words take the origin as it is, others with
        a capital first letter."""
        dark = self.shadows.where("demote = 1").select(F.col("shadow").alias("word"), "origin")
        rows = perhaps_in(self.places(docs), "word", dark).join(dark, "word")
        new = F.when(F.col("piece") == F.col("word"), F.col("origin")).otherwise(F.concat(F.upper(F.substring("origin", 1, 1)), F.substring("origin", F.lit(2), F.length("origin"))))
        return self._changed(docs, rows.withColumn("new", new))


def build(docs: DataFrame, profile: LanguageProfile = YAKUT, with_model: bool = True, shadow_limit: int | None = None, **options) -> Engine:
    """An engine from documents (doc_id, source, tier, text). Its tables are written once, as each check reads them often.
    shadow_limit: find_shadows' limit; none by default."""
    lexicon = written(X.build_lexicon(X.word_counts(docs, profile)), "lexicon")
    model = None
    if with_model:
        model = (written(L.unigrams(docs, profile), "unigrams"), written(L.bigrams(docs, lexicon.where("kind = 'core'"), 3, profile), "bigrams"))
    return Engine(lexicon, written(X.find_shadows(lexicon, profile, shadow_limit), "shadows"), model, profile=profile, **options)
