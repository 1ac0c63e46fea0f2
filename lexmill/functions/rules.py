"""Phonotactic rules as a registry of Column builders. Each gives the violations of a word as array<struct<rule, position,
detail>>; positions count from the word's start, hyphens included."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.profile import YAKUT, LanguageProfile


def _found(rule: str, position: Column, detail: Column) -> Column:
    return F.struct(F.lit(rule).alias("rule"), position.cast("int").alias("position"), detail.alias("detail"))


def _none() -> Column:
    return F.lit(None).cast("array<struct<rule:string,position:int,detail:string>>")


def is_loanword(word: Column, profile: LanguageProfile = YAKUT) -> Column:
    return F.lower(word).rlike(f"[{profile.loan_letters}]")


def parts(word: Column) -> Column:
    """Hyphen parts that aren't empty, with their places."""
    pieces = F.split(F.lower(word), "-")
    placed = F.transform(pieces, lambda p, i: F.struct(F.aggregate(F.slice(pieces, F.lit(1), i), F.lit(0), lambda n, x: n + F.length(x) + 1).alias("at"), p.alias("part")))
    return F.filter(placed, lambda x: x["part"] != "")


def _located(text: Column, pattern: str) -> Column:
    """Matches of the pattern from left to right, with their places."""
    cover = F.regexp_extract_all(text, F.lit(f"(?s:(?:{pattern})|.)"), F.lit(0))
    placed = F.transform(cover, lambda p, i: F.struct(F.length(F.array_join(F.slice(cover, F.lit(1), i), "")).alias("at"), p.alias("hit")))
    return F.filter(placed, lambda x: x["hit"].rlike(f"^(?:{pattern})$"))


def nuclei(word: Column, profile: LanguageProfile = YAKUT) -> Column:
    """Vowel nuclei with their places."""
    return _located(F.lower(word), profile.nuclei)


def _per_part(word: Column, one: Callable[[Column], Column]) -> Column:
    return F.flatten(F.transform(parts(word), one))


def _native(word: Column, profile: LanguageProfile, found: Column) -> Column:
    """Loanwords follow other rules."""
    return F.when(~is_loanword(word, profile), found).otherwise(F.array().cast("array<struct<rule:string,position:int,detail:string>>"))


def harmony(word: Column, profile: LanguageProfile = YAKUT) -> Column:
    allowed = F.array(*[F.lit(x) for x in profile.follows])

    def one(p):
        n = _located(p["part"], profile.nuclei)
        later = F.slice(n, F.lit(2), F.greatest(F.size(n) - 1, F.lit(0)))
        pair = F.transform(later, lambda x, i: _found("harmony", p["at"] + x["at"], F.concat(F.get(n, i)["hit"], F.lit("→"), x["hit"])))
        return F.filter(pair, lambda x: ~F.array_contains(allowed, x["detail"]))

    return _native(word, profile, _per_part(word, one))


def is_harmonic(word: Column, profile: LanguageProfile = YAKUT) -> Column:
    """Whether harmony() finds nothing, in one pass over the nuclei and without places."""
    allowed = F.array(*[F.lit(x) for x in profile.follows])

    def bad(p):
        n = F.regexp_extract_all(p, F.lit(profile.nuclei), F.lit(0))
        later = F.slice(n, F.lit(2), F.greatest(F.size(n) - 1, F.lit(0)))
        return F.exists(F.transform(later, lambda x, i: F.concat(F.get(n, i), F.lit("→"), x)), lambda x: ~F.array_contains(allowed, x))

    return is_loanword(word, profile) | ~F.exists(F.split(F.lower(word), "-"), bad)


def vowel_pairs(word: Column, profile: LanguageProfile = YAKUT) -> Column:
    allowed = [*profile.long_vowels, *profile.diphthongs]
    two = f"[{profile.short_vowels}][{profile.short_vowels}]"
    return _native(word, profile, _per_part(word, lambda p: F.transform(F.filter(_located(p["part"], two), lambda x: ~x["hit"].isin(allowed)), lambda x: _found("vowel_pairs", p["at"] + x["at"], x["hit"]))))


def initial(word: Column, profile: LanguageProfile = YAKUT) -> Column:
    hit = F.filter(parts(word), lambda p: p["part"].rlike(f"^[{profile.no_initial}]"))
    return F.transform(hit, lambda p: _found("initial", p["at"], F.substring(p["part"], 1, 1)))


def final(word: Column, profile: LanguageProfile = YAKUT) -> Column:
    hit = F.filter(parts(word), lambda p: p["part"].rlike(f"[{profile.no_final}]$"))
    return _native(word, profile, F.transform(hit, lambda p: _found("final", p["at"] + F.length(p["part"]) - 1, F.right(p["part"], F.lit(1)))))


def _collapsed(part: Column, profile: LanguageProfile) -> Column:
    for pair in profile.soft_digraphs:
        part = F.replace(part, F.lit(pair), F.lit(pair[0]))
    return part


def clusters(word: Column, profile: LanguageProfile = YAKUT, most: int = 2) -> Column:
    run = f"[{profile.consonants}]{{{most + 1},}}"
    return _native(word, profile, _per_part(word, lambda p: F.transform(_located(_collapsed(p["part"], profile), run), lambda x: _found("clusters", p["at"] + x["at"], x["hit"]))))


def final_cluster(word: Column, profile: LanguageProfile = YAKUT) -> Column:
    def one(p):
        c = _collapsed(p["part"], profile)
        tail = F.regexp_extract(c, f"[{profile.consonants}]{{2,}}$", 0)
        bad = (F.length(tail) >= 2) & ~F.right(tail, F.lit(2)).isin(*profile.final_clusters)
        return F.when(bad, F.array(_found("final_cluster", p["at"] + F.length(c) - F.length(tail), tail)))

    return _native(word, profile, F.flatten(F.array_compact(F.transform(parts(word), one))))


def soft_sign(word: Column, profile: LanguageProfile = YAKUT) -> Column:
    # one more letter in front, so that the first place is like the others
    low = F.concat(F.lit(" "), F.lower(word))
    places = F.filter(F.sequence(F.lit(2), F.greatest(F.length(low), F.lit(2))), lambda i: (F.substring(low, i, F.lit(1)) == "ь") & ~F.substring(low, i - 1, F.lit(1)).isin("д", "н"))
    return _native(word, profile, F.transform(places, lambda i: _found("soft_sign", i - 2, F.lit("ь"))))


def triple_letter(word: Column, profile: LanguageProfile = YAKUT) -> Column:
    low = F.lower(word)
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.length(low), F.lit(1))), lambda i: F.substring(low, i, F.lit(3)).isin(*[v * 3 for v in profile.short_vowels]))
    return F.transform(places, lambda i: _found("triple_letter", i - 1, F.substring(low, i, F.lit(3))))


def _hits(profile: LanguageProfile) -> dict[str, Callable[[Column], Column]]:
    """Whether a rule finds anything, as one pattern on the lower-cased word, without places. Parts end at a hyphen, which
    no class has; loanwords are told apart by the caller."""
    fine = "|".join([*profile.long_vowels, *profile.diphthongs])
    v, c, ends = profile.short_vowels, profile.consonants, "|".join(profile.final_clusters)
    plain = lambda pattern: lambda low: low.rlike(pattern)
    return {
        # pairs are taken from a run's start, two letters at a time
        "vowel_pairs": plain(rf"(?<![{v}])(?:{fine})*+[{v}]{{2}}"),
        "initial": plain(rf"(?:^|-)[{profile.no_initial}]"),
        "final": plain(rf"[{profile.no_final}](?:-|\z)"),
        "clusters": lambda low: _collapsed(low, profile).rlike(f"[{c}]{{3}}"),
        "final_cluster": lambda low: _collapsed(low, profile).rlike(rf"(?!(?:{ends})(?:-|\z))[{c}]{{2}}(?:-|\z)"),
        "soft_sign": plain("(?:^|[^дн])ь"),
        "triple_letter": plain("|".join(x * 3 for x in v)),
    }


#: Rules that hold for loanwords as well.
ANY_WORD = ("initial", "triple_letter")


def hits(name: str, word: Column, profile: LanguageProfile = YAKUT) -> Column:
    """Whether the rule finds anything in the word: by one pattern for the built-in rules, else by its violations."""
    if RULES[name] is not BUILT_IN.get(name) or profile.name != "yakut":
        return F.size(RULES[name](word, profile)) > 0
    if name == "harmony":
        return ~is_harmonic(word, profile)
    hit = _hits(profile)[name](F.lower(word))
    return hit if name in ANY_WORD else hit & ~is_loanword(word, profile)


RULES: dict[str, Callable[..., Column]] = {"harmony": harmony, "vowel_pairs": vowel_pairs, "initial": initial, "final": final, "clusters": clusters, "final_cluster": final_cluster, "soft_sign": soft_sign, "triple_letter": triple_letter}
BUILT_IN = dict(RULES)
#: Rules that rarely hit a right word.
SAFE = ("initial", "final", "soft_sign", "triple_letter", "final_cluster")
ALL = tuple(RULES)


def register(name: str, rule: Callable[..., Column]) -> None:
    """A rule of the caller's own: word -> array<struct<rule, position, detail>>."""
    RULES[name] = rule


def violations(word: Column, rules: tuple[str, ...] = ALL, profile: LanguageProfile = YAKUT) -> Column:
    return F.concat(*[RULES[r](word, profile) for r in rules])


def is_wellformed(word: Column, rules: tuple[str, ...] = ALL, profile: LanguageProfile = YAKUT) -> Column:
    out = F.lit(True)
    for r in rules:
        out = out & ~hits(r, word, profile)
    return out
