"""Error model: seeded corruption of texts, word differences, tags. Each row has a seed of its own, made from its key, so
results don't depend on partitions or order."""

from __future__ import annotations

import difflib
import random
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.functions.distance import neighbours
from lexmill.profile import YAKUT, LanguageProfile

TYPO_RATE, REAL_RATE = 0.08, 0.15
#: Tags: keep, one for each special letter, delete.
KEEP, DELETE = 0, 6


@lru_cache(maxsize=8)
def _compiled(word: str) -> re.Pattern:
    return re.compile(re.sub(r"\\x\{([0-9A-F]{4})\}", lambda m: chr(int(m[1], 16)), word))


def _word_regex(profile: LanguageProfile) -> re.Pattern:
    return _compiled(profile.word)


_NEAR: dict[tuple[str, tuple[str, ...]], list[str]] = {}


def _near(letter: str, profile: LanguageProfile) -> list[str]:
    """neighbours, kept: to find them takes longer than all else about a slip."""
    key = (letter, profile.keyboard)
    if key not in _NEAR:
        _NEAR[key] = neighbours(letter, profile)
    return _NEAR[key]


def typo(word: str, rng: random.Random, profile: LanguageProfile = YAKUT) -> str:
    """One mechanical slip: a letter lost, added, replaced by a neighbour on the keyboard, or swapped with the next. The
    last letter has no next and is replaced instead; words under three letters stay."""
    if len(word) < 3:
        return word
    how, at = rng.choice(["del", "ins", "sub", "swap"]), rng.randrange(len(word))
    head, tail = word[:at], word[at + 1 :]
    if how == "del":
        return head + tail
    if how == "swap" and tail:
        return head + tail[0] + word[at] + tail[1:]
    other = rng.choice(_near(word[at].lower(), profile) or list(profile.short_vowels or "aeiou")[:5])
    return head + other + (word[at:] if how == "ins" else tail)


def mixed_plain(text: str, rng: random.Random, profile: LanguageProfile = YAKUT, survive: float = 0.15, digraph: float = 0.3) -> str:
    """As people write: most special letters replaced, some left, the letter with two stand-ins by one of them in all."""
    own = {k: v[0] for k, v in profile.shadows.items()}
    if "һ" in own:
        own["һ"] = rng.choice(["h", "с"])

    def letter(m: re.Match) -> str:
        c = m.group()
        if rng.random() < survive:
            return c
        new = own[c.lower()]
        if profile.digraph and c.lower() == profile.digraph[1] and rng.random() < digraph:
            new = profile.digraph[0]
        return new.upper() if c.isupper() else new

    return re.sub(f"[{profile.special}{profile.special.upper()}]", letter, text)


def corrupt_words(text: str, rng: random.Random, rate: float, fn: Callable[[str, random.Random], str | None], profile: LanguageProfile = YAKUT) -> str:
    """Words of four letters or more replaced at a rate, one at least; all else stays."""
    found = [m for m in _word_regex(profile).finditer(text) if len(m.group()) >= 4]
    chosen = [m for m in found if rng.random() < rate] or ([rng.choice(found)] if found else [])
    out, at = [], 0
    for m in chosen:
        new = fn(m.group(), rng)
        out += [text[at : m.start()], m.group() if new is None else new]
        at = m.end()
    return "".join([*out, text[at:]])


def corrupted(key: Column, text: Column, task: str, known: Column | None = None, profile: LanguageProfile = YAKUT) -> Column:
    """The text as a task corrupts it: clean, denorm_full, denorm_mixed, typo, mixed, real. key seeds the row. known: for
    `real`, a map from a lower-cased word to the errors mined for it."""
    if task == "clean":
        return text
    if task == "denorm_full":
        return T.denormalize(text, "ru", profile)

    def one(key, text, errors):
        if text is None:
            return None
        rng = random.Random(f"{task}/{key}")
        slip = lambda w, r: typo(w, r, profile)
        if task == "denorm_mixed":
            return mixed_plain(text, rng, profile)
        if task == "typo":
            return corrupt_words(text, rng, TYPO_RATE, slip, profile)
        if task == "mixed":
            return corrupt_words(mixed_plain(text, rng, profile), rng, TYPO_RATE, slip, profile)
        errors = dict(errors or {})

        def real(word, r):
            some = errors.get(word.lower())
            new = r.choice(sorted(some)) if some is not None and len(some) else None
            return new and (new.capitalize() if word[:1].isupper() else new)

        return corrupt_words(text, rng, REAL_RATE, real, profile)

    @F.arrow_udf("string")
    def of(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        yield from T.in_lots(batches, one, pa.string())

    return of(key.cast("string"), text, known if known is not None else F.lit(None).cast("map<string,array<string>>"))


def with_mined_errors(sentences: DataFrame, pairs: DataFrame, profile: LanguageProfile = YAKUT) -> DataFrame:
    """sentences (doc_id, sent_idx, text) with `known`: for each of their words the errors mined for it."""
    words = sentences.select("doc_id", "sent_idx", F.explode(F.array_distinct(F.transform(T.words(F.col("text"), profile), F.lower))).alias("right"))
    wrong = pairs.groupBy("right").agg(F.sort_array(F.collect_set("wrong")).alias("wrong"))
    known = words.join(wrong, "right").groupBy("doc_id", "sent_idx").agg(F.map_from_entries(F.collect_list(F.struct("right", "wrong"))).alias("known"))
    return sentences.join(known, ["doc_id", "sent_idx"], "left")


def _opcodes(a: list[str], b: list[str]) -> list[tuple[int, str, str]]:
    if len(a) == len(b):
        return [(i, x, y) for i, (x, y) in enumerate(zip(a, b, strict=True)) if x != y]
    out = []
    for how, i, j, k, n in difflib.SequenceMatcher(a=a, b=b, autojunk=False).get_opcodes():
        if how != "equal":
            left, right = a[i:j], b[k:n]
            width = max(len(left), len(right))
            out += [(i + d, x, y) for d, (x, y) in enumerate(zip(left + [""] * (width - len(left)), right + [""] * (width - len(right)), strict=True))]
    return out


def diff_words(src: Column, tgt: Column, profile: LanguageProfile = YAKUT) -> Column:
    """(pos, before, after) of words that differ: by place if both have as many, else by alignment."""
    a, b = T.words(src, profile), T.words(tgt, profile)

    @F.pandas_udf("array<struct<pos:int,before:string,after:string>>")
    def aligned(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([[{"pos": i, "before": p, "after": q} for i, p, q in _opcodes(list(u), list(v))] for u, v in zip(x, y, strict=True)])

    placed = F.zip_with(a, b, lambda x, y: F.struct(x.alias("before"), y.alias("after")))
    placed = F.transform(placed, lambda p, i: F.struct(i.alias("pos"), p["before"].alias("before"), p["after"].alias("after")))
    same = F.filter(placed, lambda p: p["before"] != p["after"])
    empty = F.array().cast("array<string>")
    equal = F.size(a) == F.size(b)
    return F.when(equal, same).otherwise(aligned(F.when(equal, empty).otherwise(a), F.when(equal, empty).otherwise(b)))


def apply_tags(text: Column, tags: Column, profile: LanguageProfile = YAKUT) -> Column:
    """Tag 0 keeps a letter, 6 deletes it, 1 to 5 put the profile's special letters in its case; the rest is copied."""
    special = F.array(*[F.lit(c) for c in profile.special])
    def one(c, t):
        new = F.get(special, t - 1)
        return F.when(c.isNull() | (t == DELETE), "").when(t.isNull() | (t == KEEP), c).when((c == F.upper(c)) & (c != F.lower(c)), F.upper(new)).otherwise(new)

    return F.array_join(F.zip_with(F.split(text, ""), tags, one), "")


def tags_of(src: str, tgt: str, profile: LanguageProfile = YAKUT) -> list[int] | None:
    """Tags that turn src into tgt, or None if letters differ by more than restoration."""
    stand_ins = {c: {x for x in v if len(x) == 1} | ({"o"} if c == "ө" else {"y"} if c == "ү" else {"х"} if c == "һ" else {"n"} if c == "ҥ" else {"g"} if c == "ҕ" else set()) for c, v in profile.shadows.items()}
    pair, letter = profile.digraph or ("", "")
    out, i, j = [], 0, 0
    while i < len(src) and j < len(tgt):
        x, y = src[i].lower(), tgt[j].lower()
        if src[i] == tgt[j]:
            out.append(KEEP)
        elif pair and y == letter and src[i : i + 2].lower() == pair and tgt[j + 1 : j + 2].lower() != pair[1]:
            out += [profile.special.index(y) + 1, DELETE]
            i += 1
        elif x in stand_ins.get(y, ()):
            out.append(profile.special.index(y) + 1)
        else:
            return None
        i, j = i + 1, j + 1
    return out if i == len(src) and j == len(tgt) else None


def make_tags(src: Column, tgt: Column, profile: LanguageProfile = YAKUT) -> Column:
    def one(a, b):
        if a is None or b is None:
            return None
        return np.zeros(len(a), np.int32) if a == b else tags_of(a, b, profile)

    @F.arrow_udf("array<int>")
    def of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        yield from T.in_lots(batches, one, pa.list_(pa.int32()))

    return of(src, tgt)
