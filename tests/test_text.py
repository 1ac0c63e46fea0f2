"""Tokens, normalisation, sentences, shares and plain spellings on fixtures."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import corpus as K
from lexmill.operators import errors as X


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first().x


def token_table(spark, text):
    rows = K.token_rows(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("start").collect()
    return [(r.piece, r.start, r.end, r.kind) for r in rows]


def test_offsets_point_at_tokens(spark):
    text = "Оҕо, үөрэҕэ — киһиэхэ! 😀 1990-с Linux"
    rows = token_table(spark, text)
    assert [r[0] for r in rows] == ["Оҕо", "үөрэҕэ", "киһиэхэ", "1990-с", "Linux"]
    assert all(text[a:b] == piece for piece, a, b, _ in rows)
    assert [r[3] for r in rows] == ["word", "word", "word", "number", "latin"]


def test_compound_is_one_token(spark):
    assert [r[0] for r in token_table(spark, "сайыҥҥыттан-күһүҥҥүттэн")] == ["сайыҥҥыттан-күһүҥҥүттэн"]


def test_mixed_scripts_fall_apart(spark):
    assert [r[0] for r in token_table(spark, "киhи")] == ["ки", "h", "и"]


def test_pieces_cover_any_text(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("аҕb1 -.'’\n😀é") for _ in range(rng.randint(0, 40))) for _ in range(200)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.array_join(T.pieces(F.col("t")), "").alias("x")).collect()
    assert all(r.t == r.x for r in rows)


@pytest.mark.parametrize(("bad", "good"), [("ѳс", "өс"), ("саңа", "саҥа"), ("аға", "аҕа"), ("ұс", "үс"), ("ӊ", "ҥ"), ("Ѳс", "Өс")])
def test_confusables(spark, bad, good):
    assert one(spark, bad, T.fix_confusables) == good


def test_invisible_characters(spark):
    assert one(spark, "оҕо­лор​", T.strip_invisible) == "оҕолор"
    assert one(spark, "оҕо­лор", T.visible_positions) == [0, 1, 2, 4, 5, 6]


def test_homoglyphs_only_in_words_of_the_script(spark):
    assert one(spark, "Cаха", T.fix_mixed_script) == "Саха"
    assert one(spark, "CD-ROM", T.fix_mixed_script) == "CD-ROM"
    assert one(spark, "Cаха CD", lambda c: T.normalize(c, mixed_script="run")) == "Саха CD"
    assert one(spark, "Cаха CD", T.normalize) == "Cаха CD"


def test_normalise_is_idempotent_and_composes(spark):
    text = unicodedata.normalize("NFD", "йөрүү é") + "​ саңа"
    once = one(spark, text, T.normalize)
    assert once == one(spark, once, T.normalize) == unicodedata.normalize("NFC", "йөрүү é") + " саҥа"
    assert one(spark, "  a  b\n", T.normalize_for_lexicon) == "a b"


def test_sentences():
    spans = lambda t: [t[a:b] for a, b in T.sentence_spans(t)]
    assert spans("Ол 1990 с. буолбута. Иккис этии.") == ["Ол 1990 с. буолбута.", "Иккис этии."]
    assert spans("А. Иванов кэллэ. Барда?! Дьэ") == ["А. Иванов кэллэ.", "Барда?", "Дьэ"]
    assert spans("") == [] and spans("  ") == []


def test_shares(spark):
    assert one(spark, "оҕо", lambda c: T.letter_share(c, "ҕҥөһү")) == pytest.approx(1 / 3)
    assert one(spark, "123", lambda c: T.letter_share(c, "ҕҥөһү")) == 0.0


def test_plain_spellings(spark):
    plain = one(spark, "Оҕо үөрэҕэ саҥа киһи Ҥ", T.denormalize)
    assert not set(plain.lower()) & set("ҕҥөүһ") and plain == "Ого уорэгэ сана киси Н"
    assert one(spark, "саҥа", lambda c: T.denormalize(c, digraph=True)) == "санга"
    assert one(spark, "киһи", lambda c: T.denormalize(c, "lat")) == "киhи"


@pytest.mark.parametrize(("src", "tgt"), [("ого", "оҕо"), ("Ого", "Оҕо"), ("санга", "саҥа"), ("киhи", "киһи"), ("уьу", "уһу"), ("кор", "көр"), ("оҕо", "оҕо")])
def test_tags_round_trip(spark, src, tgt):
    df = spark.createDataFrame([(src, tgt)], "s string, t string").withColumn("tags", X.make_tags(F.col("s"), F.col("t")))
    row = df.select("tags", X.apply_tags(F.col("s"), F.col("tags")).alias("x")).first()
    assert row.x == tgt and len(row.tags) == len(src)


def test_incompatible_tags_are_null():
    assert X.tags_of("оҕо", "биэрэр") is None and X.tags_of("оҕо", "оҕ") is None


def test_corruption_is_seeded_by_row(spark):
    df = spark.createDataFrame([(i, "саҥа оҕолор күһүҥҥү үөрэхтэрэ") for i in range(20)], "id long, t string")
    for task in ("denorm_mixed", "typo", "mixed", "denorm_full", "clean"):
        a, b = ({r.id: r.x for r in d.select("id", X.corrupted(F.col("id"), F.col("t"), task).alias("x")).collect()} for d in (df, df.repartition(5)))
        assert a == b and (task == "clean" or any(v != "саҥа оҕолор күһүҥҥү үөрэхтэрэ" for v in a.values()))
    assert X.typo("ab", random.Random(1)) == "ab"


def test_word_differences(spark):
    diff = lambda a, b: [tuple(x) for x in spark.createDataFrame([(a, b)], "a string, b string").select(X.diff_words(F.col("a"), F.col("b")).alias("x")).first().x]
    assert diff("а б в", "а г в") == [(1, "б", "г")]
    assert diff("а б", "а в б") == [(1, "", "в")]
