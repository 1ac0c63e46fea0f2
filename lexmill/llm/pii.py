"""PII surrogates: detected entities get keyed replacements of the same type, format, script and gender.

Numbers and codes take a keyed permutation of the strings of their shape: digits stay digits, vowels and consonants stay
such in their script and case, hexadecimal secrets stay hexadecimal, and what lies between stays as it is. Card numbers and
IBANs are those whose check digits hold, and their surrogates' hold too; country codes stay. A phone number's surrogate is
that of its national digits, so that it is the same with and without country code and in any grouping. Names take a name
made of syllables, with an ending of their gender and in their script: a name's gender is that of the titles before it as
a given name anywhere in the corpus, else that of a known given name, else that of its ending.

A name is found behind a title, as a known given name before another name, and wherever else in the same text a part of
a name so found is written. Each part of a name is an entity of its own, the same with and without title or given name.

All distinct entities of the corpus are checked, names included: an entity whose surrogate is taken, by a smaller entity's
surrogate or by an original (its own too), draws again until none is. So different entities keep different surrogates, the
same one has one everywhere, and no surrogate names anybody else. Only entities that drew again, or whose gender isn't what
they show, are kept as a table; documents that hold one are found by a join, and read it from there. Replacements can be
undone by whoever has the key, which is the caller's.

Defined cases: null text stays null; empty texts stay; repeated rows are changed alike; ties (an entity of two types) go
to the type named first in `TYPES`; texts of any length are read whole; an empty table gives no rows; extra columns
stay and never clash.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.storage import give_back, written

#: Rounds of drawing again after which the space of an entity's shape must be full.
ROUNDS = 200

#: Given names by gender and script, which tell a person and a gender. Surrogates aren't drawn from them.
GIVEN = {
    ("f", "latin"): "Alice Anna Barbara Carmen Catherine Claire Elena Elizabeth Emma Eva Isabel Jane Julia Laura Lucia Maria Marie Martha Mary Nina Olga Patricia Rosa Sarah Sofia Sophie Susan Teresa Ursula Vera".split(),
    ("m", "latin"): "Albert Anton Carlos Charles Daniel David Diego Edward Emil Frank George Hans Henri James Jean John Jorge Karl Louis Luis Mark Martin Michael Oscar Paul Peter Pierre Robert Thomas William".split(),
    ("f", "cyrillic"): "Айаана Алла Анна Вера Дарья Елена Ирина Кюннэй Лена Мария Надежда Наталья Нюргуйаана Ольга Саргылана Светлана Татьяна Туйаара".split(),
    ("m", "cyrillic"): "Айаал Алексей Андрей Антон Василий Дмитрий Егор Иван Михаил Николай Ньургун Олег Пётр Семён Сергей Степан Туймаада Эрчим".split(),
}
_GENDER = {n.lower(): g for (g, _), names in GIVEN.items() for n in names}
_HONORIFIC = r"Mrs?|Ms|Miss|Dr|Prof|Herrn?|Frau|Monsieur|Madame|Mme|Mlle|Señora?|Sra?|Don|Doña|Господин|Госпожа"
_TITLES = {**dict.fromkeys(["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Doña", "Госпожа"], "f"), **dict.fromkeys(["Mr", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Don", "Господин"], "m")}
_NAME = r"[A-ZÀ-ÖØ-ÞА-ЯЁҔҤӨҮҺ][\w'’-]*[\w]"

TYPES = {
    "email": r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,63})@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "secret": r"(?<=[\"'=: ])(?=[0-9a-zA-Z_-]*\d)[0-9a-fA-F]{32,128}(?![0-9A-Za-z])|\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,64}|sk-[A-Za-z0-9]{20,64})\b",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d+-])\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,7}(?![\d-])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?)\d{2,4}(?:[ .-]\d{2,4}){1,3}(?!\d|\.\d)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d|\.\d)|(?<![\w.+-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])",
    "name": rf"\b(?:{_HONORIFIC})\.? {_NAME}(?: {_NAME}){{0,2}}|\b(?:{'|'.join(sorted({n for v in GIVEN.values() for n in v}))})(?: {_NAME}){{1,2}}",
}
_ENTITY = re.compile("|".join(f"(?P<{k}>{p})" for k, p in TYPES.items()))
#: A text without any of these has no entity.
_HINT = re.compile(rf"[@\d]|\b(?:{_HONORIFIC})\.? |\b(?:{'|'.join(sorted({n for v in GIVEN.values() for n in v}))}) ")
_PART = re.compile(r"[^\W\d_]{2,}")
_CALLED = re.compile(rf"(?:{_HONORIFIC})\.? ")

_CLASSES = ["0123456789", "aeiouy", "bcdfghjklmnpqrstvwxz", "аеёиоуыэюяөү", "бвгджзйклмнпрстфхцчшщъьҕҥһ", "àáâäãåèéêëìíîïòóôöõùúûüýÿæœ", "çñß"]
_PLACE = {c: (k, i) for k, letters in enumerate(_CLASSES) for i, c in enumerate(letters)}
_HEX = "0123456789abcdef"
_HEX_PLACE = {c: (0, i) for i, c in enumerate(_HEX)}

#: Syllables and endings of made names, by script and gender.
_SYLLABLES = {"latin": [a + b for a in "b br d dr f g gr h k l m n p r s st t tr v z".split() for b in "aeiou"], "cyrillic": [a + b for a in "б бр в г д др з к кр л м н п р с ст т тр ф х".split() for b in "аеиоу"]}
_ENDINGS = {("latin", "f"): ["lina", "ra", "nelia", "tessa"], ("latin", "m"): ["lo", "nen", "mard", "tus"], ("cyrillic", "f"): ["лина", "ра", "нова", "тина"], ("cyrillic", "m"): ["лов", "нин", "мар", "тен"]}

#: Country calling codes of two digits; those that start with 1 or 7 have one digit, the others three.
_TWO_DIGITS = set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def _permuted(key: bytes, x: int, size: int, tweak: bytes) -> int:
    """A keyed permutation of 0..size-1: a Feistel network over as many bits, walked until it lands inside."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    n = (half + 7) // 8
    while True:
        a, b = x >> half, x & mask
        for r in range(6):
            h = hmac.digest(key, tweak + bytes([r]) + b.to_bytes(n, "big"), "sha256")
            while len(h) < n:
                h += hmac.digest(key, h + bytes([r]), "sha256")
            a, b = b, a ^ (int.from_bytes(h[:n], "big") & mask)
        x = a << half | b
        if x < size:
            return x


def _shaped(key: bytes, text: str, tweak: bytes, classes=None) -> str:
    """text with its letters and digits permuted among all strings of its shape."""
    at = [(k, c, (classes or _PLACE).get(c.lower())) for k, c in enumerate(text)]
    at = [(k, c, p) for k, c, p in at if p is not None]
    if not at:
        return text
    alphabets = [_HEX if classes else _CLASSES[p[0]] for _, _, p in at]
    value, size = 0, 1
    for letters, (_, _, p) in zip(alphabets, at, strict=True):
        value, size = value * len(letters) + p[1], size * len(letters)
    shape = hashlib.sha256("".join(x[0] for x in alphabets).encode()).digest()[:8]
    value = _permuted(key, value, size, tweak + shape)
    out = list(text)
    for letters, (k, c, _) in zip(reversed(alphabets), reversed(at), strict=True):
        value, i = divmod(value, len(letters))
        out[k] = letters[i].upper() if c.isupper() and len(letters[i].upper()) == 1 else letters[i]
    return "".join(out)


def _fill(pattern: str, letters: str) -> str:
    """The pattern with its letters and digits replaced, one after the other."""
    it = iter(letters)
    return "".join(next(it) if c.isalnum() else c for c in pattern)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _rest_97(country: str, check: str, account: str) -> int:
    return int("".join(str(int(c, 36)) for c in account + country + check)) % 97


def _country(phone: str) -> str:
    """The calling code, with its plus sign, that a number starts with."""
    d = re.sub(r"\D", "", phone)
    if not phone.startswith("+"):
        return ""
    return "+" + d[: 1 if d[0] in "17" else 2 if d[:2] in _TWO_DIGITS else 3]


def _national(phone: str) -> str:
    return re.sub(r"\D", "", phone)[max(0, len(_country(phone)) - 1) :]


def canonical(kind: str, text: str) -> str:
    """What makes two mentions one entity, whatever their format."""
    if kind in ("card", "ssn"):
        return re.sub(r"\D", "", text)
    if kind == "phone":
        return _national(text)
    if kind == "iban":
        return (text[:2] + text.replace(" ", "")[4:]).lower()
    return text.lower()


def _script(word: str) -> str:
    return "cyrillic" if "Ѐ" <= word[:1] <= "ԯ" else "latin"


def shown_gender(name: str) -> str:
    """Of a known given name its own, of others that of the ending."""
    return _GENDER.get(name.lower()) or ("f" if name[-1:].lower() in ("a", "а", "я") else "m")


def made_name(key: bytes, name: str, draw: int, gender: str) -> str:
    script = _script(name)
    h = int.from_bytes(hmac.digest(key, f"name/{draw}/{gender}/{name.lower()}".encode(), "sha256"), "big")
    h, e = divmod(h, 4)
    out = _ENDINGS[script, gender][e]
    for _ in range(2 + draw // 4):
        h, i = divmod(h, len(_SYLLABLES[script]))
        out = _SYLLABLES[script][i] + out
    return out.upper() if name.isupper() else out.capitalize() if name[:1].isupper() else out


@lru_cache(maxsize=100_000)
def surrogate(key: bytes, kind: str, text: str, draw: int = 0, gender: str | None = None) -> str:
    tweak = f"{kind}/{draw}/".encode()
    if kind == "name":
        return made_name(key, text, draw, gender or shown_gender(text))
    if kind == "card":
        digits = canonical(kind, text)
        body = digits[0] + _shaped(key, digits[1:-1], tweak)
        return _fill(text, body + next(c for c in "0123456789" if luhn(body + c)))
    if kind == "ssn":
        return _fill(text, _shaped(key, canonical(kind, text), tweak))
    if kind == "phone":
        head = _country(text)
        return head + _fill(text[len(head) :], _shaped(key, _national(text), tweak))
    if kind == "iban":
        whole = text.replace(" ", "")
        account = _shaped(key, whole[4:], tweak + whole[:2].encode())
        return _fill(text, f"{whole[:2]}{98 - _rest_97(whole[:2], '00', account):02d}{account}")
    if kind == "ip":
        a, b, c, d = map(int, text.split("."))
        x = _permuted(key, a << 24 | b << 16 | c << 8 | d, 1 << 32, tweak)
        return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))
    if kind == "email":
        local, _, domain = text.rpartition("@")
        name, _, top = domain.rpartition(".")
        return f"{_shaped(key, local, tweak)}@{_shaped(key, name, tweak + b'domain')}.{top}"
    if kind == "secret" and all(c in _HEX_PLACE for c in text.lower()):
        return _shaped(key, text, tweak + b"hex", _HEX_PLACE)
    return _shaped(key, text, tweak)


def _sound(kind: str, text: str) -> bool:
    """Whether the check digits of a number hold."""
    if kind == "card":
        digits = re.sub(r"\D", "", text)
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "iban":
        whole = text.replace(" ", "")
        return _rest_97(whole[:2], whole[2:4], whole[4:]) == 1
    return True


def entities(text: str | None) -> list[tuple[int, int, str, str, str]]:
    """(start, end, type, canonical form, gender of a title before a given name or "") of each entity, from left to right."""
    if not text or not _HINT.search(text):
        return []
    out, names = [], set()
    for m in _ENTITY.finditer(text):
        kind = m.lastgroup
        if kind != "name":
            if _sound(kind, m.group()):
                out.append((m.start(), m.end(), kind, canonical(kind, m.group()), ""))
            continue
        called = _CALLED.match(m.group())
        first = called.end() if called else 0
        # behind a title the first of several names is the given one
        told = _TITLES.get(called.group().rstrip(". "), "") if called and " " in m.group()[first:] else ""
        for p in _PART.finditer(text, m.start() + first, m.end()):
            out.append((p.start(), p.end(), kind, p.group().lower(), told))
            names |= {p.group(), p.group().upper()}
            told = ""
    if names:
        held = [(s, e) for s, e, *_ in out]
        k = 0
        for p in _PART.finditer(text):
            while k < len(held) and held[k][1] <= p.start():
                k += 1
            if p.group() in names and (k == len(held) or held[k][0] >= p.end()):
                out.append((p.start(), p.end(), "name", p.group().lower(), ""))
        out.sort()
    return out


Draws = dict[tuple[str, str], tuple[int, str | None]]


def replace(key: bytes, text: str | None, draws: Draws) -> tuple[str | None, int, str]:
    """(text with surrogates, their number, their types with counts). draws: of entities that drew again, or have another
    gender than they show."""
    found = entities(text)
    if not found:
        return text, 0, ""
    out, at = [], 0
    for start, end, kind, name, _ in found:
        out += [text[at:start], surrogate(key, kind, text[start:end], *draws.get((kind, name), (0, None)))]
        at = end
    kinds = Counter(kind for _, _, kind, _, _ in found)
    return "".join([*out, text[at:]]), len(found), ",".join(f"{k}:{kinds[k]}" for k in sorted(kinds))


def _mentions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(th, text) -> th, kind, name, mention, f and m: how often titles of a gender go before the name in the text."""
    for b in batches:
        rows: dict[tuple, list] = {}
        for h, t in zip(b.th, b.text, strict=True):
            for s, e, kind, name, told in entities(t):
                row = rows.setdefault((h, kind, name), [t[s:e], 0, 0])
                row[1] += told == "f"
                row[2] += told == "m"
        yield pd.DataFrame([(*k, *v) for k, v in rows.items()], columns=["th", "kind", "name", "mention", "f", "m"])
        b = rows = None
    give_back()


def redrawn(mentions: DataFrame, key: bytes) -> DataFrame:
    """(kind, name, draw, gender) of the entities whose first surrogate is taken, or whose gender isn't what they show."""

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            genders = [None if g is None or pd.isna(g) else g for g in b.gender]
            yield b.assign(made=[canonical(k, surrogate(key, k, m, d, g)) for k, m, d, g in zip(b.kind, b.mention, b.draw, genders, strict=True)])
            b = genders = None
        give_back()

    schema = "kind string, name string, mention string, gender string, draw int, made string"
    table = mentions.groupBy("kind", "name").agg(F.min("mention").alias("mention"), F.sum("f").alias("f"), F.sum("m").alias("m"))
    table = written(table, "entities")
    told = F.when(F.col("f") > F.col("m"), "f").when(F.col("m") > F.col("f"), "m")
    originals = table.select("kind", F.col("name").alias("made"))
    state = written(table.select("kind", "name", "mention", told.alias("gender"), F.lit(0).alias("draw")).mapInPandas(drawn, schema), "drawn")
    for _ in range(ROUNDS):
        first = state.groupBy("kind", "made").agg(F.min("name").alias("first"), F.count("*").alias("c")).where("c > 1")
        meets = state.join(first, ["kind", "made"]).where("name <> first").select("kind", "name")
        taken = written(meets.unionByName(state.join(originals, ["kind", "made"], "left_semi").select("kind", "name")).distinct(), "taken")
        if taken.isEmpty():
            return state.where("draw > 0 or gender is not null").select("kind", "name", "draw", "gender")
        again = state.join(taken, ["kind", "name"], "left_semi").withColumn("draw", F.col("draw") + 1).drop("made").select("kind", "name", "mention", "gender", "draw").mapInPandas(drawn, schema)
        state = written(state.join(taken, ["kind", "name"], "left_anti").unionByName(again), "drawn")
    raise RuntimeError("entities fill the space of their shape, so that no surrogate is free")


def replace_documents(docs: DataFrame, key: bytes, *, text_col: str = "text") -> DataFrame:
    """docs with surrogates in their texts, and n_entities and entity_types in place of columns of that name."""
    keep = [c for c in docs.columns if c.lower() not in ("n_entities", "entity_types")]
    rows = docs.select(*[docs[c].alias(f"c{k}") for k, c in enumerate(keep)])
    text = F.col(f"c{keep.index(text_col)}")
    # by a hash of the text, so that equal texts count once and no text is moved unless the table is large
    texts = rows.select(F.xxhash64(text).alias("th"), text.alias("text"))
    mentions = written(texts.mapInPandas(_mentions, "th long, kind string, name string, mention string, f long, m long"), "mentions")
    draws = written(redrawn(mentions, key), "redrawn")
    if draws.isEmpty():
        rows = rows.withColumn("draws", F.lit(None).cast("array<struct<kind:string,name:string,draw:int,gender:string>>"))
    else:
        of = mentions.select("th", "kind", "name").join(draws, ["kind", "name"]).distinct()
        of = written(of.groupBy("th").agg(F.collect_list(F.struct("kind", "name", "draw", "gender")).alias("draws")), "draws")
        rows = rows.withColumn("th", F.xxhash64(text)).join(of, "th", "left").drop("th")

    @F.pandas_udf("text string, n long, kinds string")
    def made(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, draws_ in batches:
            out = [replace(key, t, {} if d is None else {(x["kind"], x["name"]): (x["draw"], x["gender"]) for x in d}) for t, d in zip(texts, draws_, strict=True)]
            yield pd.DataFrame(out, columns=["text", "n", "kinds"])
            texts = draws_ = out = None
        give_back()

    done = rows.withColumn("made", made(text, F.col("draws")))
    return done.select(*[(F.col("made.text") if c == text_col else F.col(f"c{k}")).alias(c) for k, c in enumerate(keep)], F.col("made.n").alias("n_entities"), F.col("made.kinds").alias("entity_types"))
