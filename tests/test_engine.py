"""Lexicon, candidates, ranking, user words, model and corrections on toy lexicons; searches against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from lexmill.functions import distance as D
from lexmill.operators import candidates as C
from lexmill.operators import engine as E
from lexmill.operators import evaluation as V
from lexmill.operators import lexicon as L
from lexmill.operators import lm as M
from lexmill.profile import YAKUT
from lexmill.sources import readers as S

SHADOWS = "shadow string, freq_shadow long, where string, origin string, freq_origin long, ratio double, demote int"


def lexicon(spark, core=(), tail=()):
    rows = [(f, n, 2, 0, "core") for f, n in core] + [(f, n, 1, o, "tail") for f, n, o in tail]
    return spark.createDataFrame(rows, "form string, freq long, n_sources long, freq_other long, kind string")


def dark(spark, *pairs):
    return spark.createDataFrame([(s, 1, "core", o, 100, 100.0, 1) for s, o in pairs], SHADOWS)


def judged(spark, words, core=(), tail=(), pairs=(), **options):
    forms = spark.createDataFrame([(w,) for w in words], "form string")
    return {r.form: (r.ok, r.reason) for r in L.verdicts(forms, lexicon(spark, core, tail), dark(spark, *pairs), **options).collect()}


def test_verdicts(spark):
    got = judged(spark, ["оҕо", "оҕо-уруу", "оҕо-ххх", "сана", "сибэкки", "үчүгэй", "киһи'оҕо"], [("оҕо", 10), ("уруу", 10), ("саҥа", 100), ("киһи", 5)], [("сибэкки", 1, 5), ("үчүгэй", 1, 0)], [("сана", "саҥа")])
    assert got == {"оҕо": (True, "core"), "оҕо-уруу": (True, "hyphen-parts"), "оҕо-ххх": (False, "unknown"), "сана": (False, "shadow"), "сибэкки": (True, "tail-corroborated"), "үчүгэй": (False, "tail-unconfirmed"), "киһи'оҕо": (True, "hyphen-parts")}
    assert judged(spark, ["оҕолар"], tail=[("оҕолар", 1, 5)], use_grammar=True) == {"оҕолар": (False, "tail-disharmonic")}
    assert judged(spark, ["оҕо-оҕо"], [("оҕо", 3)], use_hyphen=False) == {"оҕо-оҕо": (False, "unknown")}


def test_lexicon_classes_and_shadows(spark):
    docs = spark.createDataFrame([(1, "a", "edited", "саҥа " * 40 + "оҕо"), (2, "b", "edited", "саҥа оҕо оҕо сана"), (3, "c", "web", "сана сана сана куорат")], "doc_id long, source string, tier string, text string")
    lex = L.build_lexicon(L.word_counts(docs))
    assert {r.form: (r.freq, r.n_sources, r.freq_other, r.kind) for r in lex.collect()} == {"саҥа": (41, 2, 0, "core"), "оҕо": (3, 2, 0, "core"), "сана": (1, 1, 3, "tail"), "куорат": (0, 0, 1, "other")}
    [s] = L.find_shadows(lex).collect()
    assert (s.shadow, s.origin, s["where"], s.demote) == ("сана", "саҥа", "tail", 1)


def test_distortions(spark):
    of = lambda w: spark.createDataFrame([(w,)], "w string").select(L.distortions(F.col("w")).alias("x")).first().x
    assert sorted(of("саҥа")) == ["сана", "санга", "саца"] and of("ат") is None and of("ҕҕҕҕҕҕҕ") is None and len(of("ҕҕҕҕҕҕ")) == 63


@pytest.mark.parametrize(("wrong", "right", "cost"), [("ого", "оҕо", 35), ("киhи", "киһи", 35), ("уьу", "уһу", 35), ("сана", "саҥа", 35), ("хацалас", "хаҥалас", 35), ("кор", "көр", 35), ("санга", "саҥа", 70)])
def test_restoration(spark, wrong, right, cost):
    words, forms = spark.createDataFrame([(wrong,)], "word string"), spark.createDataFrame([(right, 9)], "form string, freq long")
    assert [(r.form, r.cost) for r in C.restore_candidates(words, forms).collect()] == [(right, cost)]
    assert right in spark.createDataFrame([(wrong,)], "w string").select(C.restoration_variants(F.col("w")).alias("x")).first().x


def brute_distance(a, b):
    inf = 10**9
    d = {(-1, -1): inf}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            best = 0 if i == j == 0 else inf
            if i:
                best = min(best, d[i - 1, j] + 100)
            if j:
                best = min(best, d[i, j - 1] + 100)
            if i and j:
                best = min(best, d[i - 1, j - 1] + D.substitution(a[i - 1], b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                best = min(best, d[i - 2, j - 2] + 100)
            d[i, j] = best
    return d[len(a), len(b)]


def test_distance():
    assert (D.distance("икһи", "киһи"), D.distance("ого", "оҕо"), D.distance("оҕо", "оҕо"), D.distance("", "аб")) == (100, 35, 0, 200)
    assert D.substitution("й", "ц") == 70 and D.substitution("а", "ь") == 100 and D.substitution("ҕ", "г") == D.substitution("г", "ҕ") == 35
    rng = random.Random(1)
    pairs = [["".join(rng.choice("аҕгөоһсй") for _ in range(rng.randint(0, 6))) for _ in range(2)] for _ in range(300)]
    assert D.distances([a for a, _ in pairs], [b for _, b in pairs]).tolist() == [brute_distance(a, b) for a, b in pairs]


@pytest.mark.parametrize("limit", [220, 150])
def test_edit_search_misses_nothing(spark, limit):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("аоуйцгһсҕ") for _ in range(rng.randint(1, 7)))
    forms = {word(): rng.randint(1, 50) for _ in range(150)}
    words = {word() for _ in range(120)} | {f[:-1] + "й" for f in list(forms)[:40]}
    got = C.edit_candidates(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame(list(forms.items()), "form string, freq long"), limit).collect()
    want = {(w, f): c for w in words for f in forms if w != f and (c := brute_distance(w, f)) <= limit}
    assert {(r.word, r.form): r.cost for r in got} == want and len(got) == len(want)


def engine(spark, core, **options):
    return E.Engine(lexicon(spark, core, options.pop("tail", ())), dark(spark, *options.pop("pairs", ())), **options)


def best(spark, e, *rows):
    asked = spark.createDataFrame(list(rows), "word string, left string, right string")
    out = {}
    for r in e.suggest(asked).orderBy("word", "rank").collect():
        out.setdefault(r.word, []).append(r.form)
    return out


def model(spark):
    uni = spark.createDataFrame([("бу", 100), ("сайын", 30), ("ыйын", 60), ("үлэлээбит", 20)], "word string, n long")
    bi = spark.createDataFrame([("бу", "сайын", 25), ("сайын", "үлэлээбит", 15)], "w1 string, w2 string, n long")
    return uni, bi


def test_model_prefers_seen_pairs_and_backs_off(spark):
    rows = spark.createDataFrame([("сайын", "бу", None), ("ыйын", "бу", None), ("сайын", None, "үлэлээбит"), ("ыйын", None, "үлэлээбит"), ("жжж", "бу", None)], "word string, left string, right string")
    got = {(r.word, r.left): r.context for r in M.scored(rows, *model(spark)).collect()}
    assert got["сайын", "бу"] > got["ыйын", "бу"] > got["жжж", "бу"] and got["сайын", None] > got["ыйын", None]


def test_ranking_by_frequency_and_by_context(spark):
    core = [("сайын", 30), ("тайын", 60)]
    assert best(spark, engine(spark, core), ("байын", None, None))["байын"][0] == "тайын"
    assert best(spark, engine(spark, core, model=model(spark)), ("байын", "бу", None))["байын"][0] == "сайын"
    assert best(spark, engine(spark, [("сайын", 30), ("ыйын", 60)], model=model(spark)), ("сйын", "бу", None))["сйын"][0] == "ыйын"


def test_fast_path_case_and_shadow(spark):
    e = engine(spark, [("оҕо", 100), ("оһо", 5), ("саҥа", 50)], pairs=[("сана", "саҥа")])
    got = best(spark, e, ("ОГО", None, None), ("Ого", None, None), ("ого", None, None), ("сана", None, None))
    assert got["ОГО"] == ["ОҔО"] and got["Ого"] == ["Оҕо"] and got["ого"] == ["оҕо"] and got["сана"] == ["саҥа"]


def test_form_beyond_the_lexicon_by_harmony(spark):
    e = engine(spark, [("абвгд", 5)])
    rows = C.candidates(spark.createDataFrame([("өлоро",), ("олоро",)], "word string"), e.core, e.shadows).collect()
    assert [(r.word, r.form, r.kind, r.cost, r.penalty) for r in rows] == [("өлоро", "өлөрө", "grammar", 70, 0)]


def test_check_correct_and_user_words(spark):
    docs = spark.createDataFrame([(1, "Ого саҥа, киси! Linux 5"), (2, ""), (3, "скайран ого")], "doc_id long, text string")
    core = [("оҕо", 100), ("саҥа", 50), ("киһи", 70)]
    e = engine(spark, core)
    fixed = {r.doc_id: r.text for r in e.correct(docs).collect()}
    assert fixed[1] == "Оҕо саҥа, киһи! Linux 5" and fixed[2] == ""
    found = {(r.doc_id, r.start, r.before, r.after) for r in e.corrections(docs).collect()}
    assert {(1, 0, "Ого", "Оҕо"), (1, 10, "киси", "киһи"), (3, 8, "ого", "оҕо")} <= found
    e.userdict.add("скайран")
    e.userdict.add_replacement("ого", "оҕом")
    rows = {(r.doc_id, r.before): (r.reason, r.suggestions[0].form) for r in e.check(docs).collect()}
    assert (3, "скайран") not in rows and rows[1, "Ого"] == ("userdict", "Оҕом")
    e.userdict.remove("ого")
    assert len(e.userdict) == 1 and e.userdict.accepts("скайран-скайран") and not e.userdict.accepts("скайран-ххх")


def test_flagged_rules(spark):
    docs = spark.createDataFrame([(1, "уьу оҕо")], "doc_id long, text string")
    assert engine(spark, [("уьу", 9), ("оҕо", 9)]).check(docs).count() == 0
    [row] = engine(spark, [("уьу", 9), ("оҕо", 9)], flag_rules=("soft_sign",)).check(docs).collect()
    assert (row.before, row.reason) == ("уьу", "grammar")


def test_tagger_and_checker_merge(spark):
    docs = spark.createDataFrame([(1, "ого киси", "оҕо киси"), (2, "ого киси", "оҕо")], "doc_id long, text string, restored string")
    got = {(r.doc_id, r.before): (r.after, r.source) for r in engine(spark, [("оҕо", 9), ("киһи", 9)]).merge_tagger(docs).collect()}
    assert got == {(1, "ого"): ("оҕо", "tagger"), (1, "киси"): ("киһи", "unknown"), (2, "ого"): ("оҕо", "unknown"), (2, "киси"): ("киһи", "unknown")}


def test_metrics_and_wer(spark):
    bench = spark.createDataFrame([(1, "t", "ого киси ат", "оҕо киһи ат"), (2, "t", "а б", "а")], "id long, task string, src string, tgt string")
    issues = spark.createDataFrame([(1, "t", 0, "Оҕо"), (1, "t", 2, "от"), (1, "t", 1, None)], "id long, task string, word_idx int, suggestion string")
    m = V.metrics(V.word_pairs(bench), issues).first()
    assert (m.items, m.words, m.tp, m.fp, m.fn, m.found, m.missed, m.false_flags, m.clean) == (1, 3, 1, 1, 1, 2, 0, 1, 1)
    assert m.precision == m.recall == 0.5 and m.fpr == 1.0
    rows = spark.createDataFrame([("f", "а б в г", "а в г"), ("g", "", "а")], "file string, ref string, hyp string")
    assert {r.file: (r.errors, r.words) for r in V.wer(rows).collect()} == {"f": (1, 4), "g": (1, 0), None: (2, 4)}


def test_tag_metrics_thresholds_and_latency(spark):
    rows = spark.createDataFrame([([0, 1, 2], [0, 1, 0]), ([1], [2])], "gold array<int>, made array<int>")
    assert {r.tag: (r.tp, r.fp, r.fn) for r in V.tag_metrics(rows).collect()} == {1: (1, 0, 1), 2: (0, 1, 1)}
    runs = spark.createDataFrame([("t", 0.5, 0.9, 0.05), ("t", 0.9, 0.8, 0.01), ("t", 0.99, 0.7, 0.0)], "task string, threshold double, f1 double, fpr double")
    assert V.best_threshold(runs, 0.02).first().threshold == 0.9
    assert V.latency(spark.createDataFrame([("x", float(i)) for i in range(11)], "what string, ms double")).first().median_ms == 5.0


def test_user_dictionary_file(tmp_path):
    d = E.UserDict()
    d.add("Скайран")
    d.add_replacement("Ого", "Оҕо")
    S.write_user_dictionary(d, tmp_path / "d.txt")
    back = S.read_user_dictionary(tmp_path / "d.txt")
    assert back.accept == {"скайран"} and back.replace == {"ого": "Оҕо"}
    (tmp_path / "e.txt").write_text("# c\n\nat # x\n", encoding="utf-8")
    assert S.read_user_dictionary(tmp_path / "e.txt").accept == {"at"} and len(S.read_user_dictionary(tmp_path / "none")) == 0


def test_files_round_trip(spark, tmp_path):
    lex = lexicon(spark, [("оҕо", 100), ("оҕолор", 50), ("киһи", 90)], [("үчүгэй", 1, 4)])
    S.write_lexicon(lex, f"{tmp_path}/lex")
    back = S.lexicon_tsv(spark, f"{tmp_path}/lex/core", f"{tmp_path}/lex/tail")
    assert {(r.form, r.freq, r.kind) for r in back.collect()} == {(r.form, r.freq, r.kind) for r in lex.collect()}
    S.write_front_coded(lex.where("kind = 'core'"), f"{tmp_path}/fc")
    assert {r.form: r.code for r in S.read_front_coded(spark, f"{tmp_path}/fc").collect()} == {r.form: r.c for r in lex.where("kind = 'core'").select("form", L.quantised(F.col("freq")).alias("c")).collect()}
    (tmp_path / "c.jsonl").write_text('{"source": "a", "text": "оҕо"}\nnot json\n{"text": "x"}\n', encoding="utf-8")
    assert sorted((r.source, r.text, r.bad) for r in S.corpus_jsonl(spark, f"{tmp_path}/c.jsonl").collect()) == [("?", "", True), ("?", "x", False), ("a", "оҕо", False)]
    S.write_model(*model(spark), f"{tmp_path}/lm")
    assert S.bigrams_tsv(spark, f"{tmp_path}/lm/bigrams", 20).count() == 1


def test_latin_profile(spark):
    from lexmill.profile import LATIN

    words, forms = spark.createDataFrame([("fur",)], "word string"), spark.createDataFrame([("für", 9)], "form string, freq long")
    assert [r.form for r in C.restore_candidates(words, forms, LATIN).collect()] == ["für"]
    assert YAKUT.name == "yakut"
