"""Shadows of forms with any number of special letters, against all variants in plain Python."""

import itertools
import random

from lexmill.operators import lexicon as L
from lexmill.profile import LATIN, YAKUT


def by_hand(forms, profile, limit=None):
    out = {}
    for origin, (freq, kind) in forms.items():
        slots = [(c, *profile.shadows.get(c, ())) for c in origin]
        size = 1
        for s in slots:
            size *= len(s)
        if kind != "core" or size == 1 or (limit and size > limit):
            continue
        for v in {"".join(x) for x in itertools.product(*slots)} - {origin}:
            if v in forms:
                out[v] = min(out.get(v, (0, "")), (-freq, origin))
    return {k: (o, -f) for k, (f, o) in out.items()}


def found(spark, forms, profile, **options):
    rows = spark.createDataFrame([(f, n, 2, 9, kind) for f, (n, kind) in forms.items()], "form string, freq long, n_sources long, freq_other long, kind string")
    return {r.shadow: (r.origin, r.freq_origin) for r in L.find_shadows(rows, profile, **options).collect()}


def test_a_form_of_many_special_letters_has_shadows(spark):
    forms = {"һүһүһүһүө": (90, "core"), "һүсусуьуо": (2, "core"), "ҕҕҕҕҕҕҕҕҕҕҕҕҕҕҕҕҕҕҕҕҕҕ": (50, "core"), "г" * 22: (1, "tail")}
    got = found(spark, forms, YAKUT)
    assert got == {"һүсусуьуо": ("һүһүһүһүө", 90), "г" * 22: ("ҕ" * 22, 50)}
    assert found(spark, forms, YAKUT, limit=64) == {}


def test_shadows_against_all_variants(spark):
    for profile, letters in ((YAKUT, "аҕгҥнцөоүуһсь"), (LATIN, "aeoäöuüñné")):
        rng = random.Random(4)
        word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(2, 5)))
        forms = {word(): (rng.randint(1, 99), rng.choice(["core", "core", "tail"])) for _ in range(600)}
        for origin in list(forms)[:200]:
            v = "".join(rng.choice((c, *profile.shadows.get(c, ()))) for c in origin)
            forms.setdefault(v, (rng.randint(1, 9), "tail"))
        for limit in (None, 8):
            want = by_hand(forms, profile, limit)
            assert found(spark, forms, profile, limit=limit) == want and len(want) > 20
