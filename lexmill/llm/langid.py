"""Language ID by language-bitmask n-gram filters.

One Bloom filter serves all languages: each slot holds a row of bits, one for each language (bit-sliced), and the AND of
the slots of an n-gram's hashes gives all languages that contain it at once. A language's popcount over a text's
n-grams, corrected for the false positives that its filling makes expectable, says how much of the text it explains;
the largest one decides.

What the filter holds is learnt from labelled texts: letter n-grams (lower-cased, a blank at word ends) of the orders in
`ORDERS`, counted over whole texts. A language contains an n-gram that makes up at least `MIN_RATE` of all its n-grams, if
that rate is at least `SHARE` of the highest in any language. Rates add up to one, so a language has at most 1 / MIN_RATE
n-grams, found without ranking them. Counting is spread over the cluster; the fit takes a hash-chosen sample of about
`TRAIN_DOCS` documents a language at most (all if there are fewer), so what comes to the driver is bounded by 1 / MIN_RATE
times the number of languages. The filter has `ROOM` slots for each n-gram of the largest language.

Defined cases: text that is null or has no letter is `und` with score 0; text with letters of which no n-gram is known
takes the language of most labelled documents, with score 0; without any labelled document everything is `und`; repeated
rows are scored alike; ties go to the first language by code point; texts of any length are read whole, in blocks; other
columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.storage import give_back, written

ORDERS = (2, 3, 4)
TRAIN_DOCS, MIN_RATE, MIN_COUNT, SHARE = 4000, 2e-5, 5, 0.5
ROOM, HASHES = 8, 3
#: Letters taken at once, whatever the length of a text.
BLOCK = 1 << 20
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _blocks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(code points with a blank for what isn't a letter, number of the text) for about BLOCK letters at a time. Pieces
    of a long text overlap, so that each n-gram comes once."""
    edge = max(ORDERS) - 1
    parts, owner, n = [], [], 0  # owner: number of the text, and how many places at the end belong to the next piece
    for k, text in enumerate(texts):
        if not text:
            continue
        low = f" {text.lower()} "
        for s in range(0, max(1, len(low) - edge), BLOCK):
            part = low[s : s + BLOCK + edge]
            parts.append(part), owner.append((k, edge if s + BLOCK + edge < len(low) else 0))
            n += len(part)
            if n >= BLOCK:
                yield _codes(parts, owner)
                parts, owner, n = [], [], 0
    if parts:
        yield _codes(parts, owner)


def _codes(parts: list[str], owner: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    # between pieces a mark that no n-gram spans
    codes = np.frombuffer("\0".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(_letters()[codes], codes, np.uint32(32))
    lengths = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    ends = np.cumsum(lengths) - 1
    codes[ends[:-1]] = 0
    of = np.repeat(np.array([k for k, _ in owner]), lengths)[: len(codes)]
    for end, (_, over) in zip(ends.tolist(), owner, strict=True):
        if over:
            of[end - over : end] = -1
    return codes, of


def _grams(codes: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, places) of the n-grams of each order. A gram has a letter, ends of words only at its own ends, and no
    mark."""
    letter = codes > 32
    with np.errstate(over="ignore"):
        base = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        base ^= base >> np.uint64(29)
        for n in ORDERS:
            m = len(codes) - n + 1
            if m <= 0:
                continue
            ok = (owner[:m] >= 0) & (codes[:m] > 0) & (codes[n - 1 :] > 0)
            for k in range(1, n - 1):
                ok &= letter[k : k + m]
            if n == 2:
                ok &= letter[:m] | letter[1:]
            at = np.flatnonzero(ok)
            h = np.full(len(at), n, np.uint64)
            for k in range(n):
                h = (h ^ base[at + k]) * np.uint64(0xD6E8FEB86659FD93)
                h ^= h >> np.uint64(32)
            yield h, at


def _slots(h: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Slots of each n-gram among n, a power of two."""
    step = (h >> np.uint64(20)) | np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(HASHES):
            yield ((h + step * np.uint64(k)) & np.uint64(n - 1)).astype(np.int64)


@dataclass
class LanguageFilter:
    """languages in code-point order; slots[s, w] has bit l % 64 of word w = l // 64 set for language l. usual: number of
    the language for letters that say nothing."""

    languages: list[str]
    slots: np.ndarray
    usual: int = 0

    @staticmethod
    def of(languages: list[str], terms: list[np.ndarray], usual: int = 0) -> LanguageFilter:
        n = 1 << max(10, (ROOM * max([1, *map(len, terms)]) - 1).bit_length())
        slots = np.zeros((n, max(1, -(-len(languages) // 64))), np.uint64)
        for k, hashes in enumerate(terms):
            for s in _slots(hashes.astype(np.uint64), n):
                slots[s, k // 64] |= np.uint64(1) << np.uint64(k % 64)
        return LanguageFilter(languages, slots, usual)

    def wrong(self) -> np.ndarray:
        """For each language, the chance that a strange n-gram is taken for one of it."""
        fill = [(self.slots[:, k // 64] >> np.uint64(k % 64) & np.uint64(1)).mean() for k in range(len(self.languages))]
        return np.array(fill) ** HASHES

    def containing(self, h: np.ndarray) -> np.ndarray:
        """Bits of all languages that contain each n-gram."""
        first, *rest = _slots(h, len(self.slots))
        mask = self.slots[first]
        for s in rest:
            mask &= self.slots[s]
        return mask

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        n, k = len(texts), len(self.languages)
        counts, total, letters = np.zeros((n, k)), np.zeros(n), np.zeros(n)
        for codes, owner in _blocks(texts):
            letters += np.bincount(owner[owner >= 0], (codes > 32)[owner >= 0], n)
            for h, at in _grams(codes, owner):
                of, mask = owner[at], self.containing(h)
                total += np.bincount(of, minlength=n)
                for l in range(k):
                    counts[:, l] += np.bincount(of, (mask[:, l // 64] >> np.uint64(l % 64)) & np.uint64(1), n)
        if not k:
            return [UNKNOWN] * n, np.zeros(n)
        wrong = self.wrong()
        true = np.maximum((counts - total[:, None] * wrong) / (1 - wrong), 0)
        best, most = true.argmax(axis=1), true.max(axis=1)
        best = np.where(most > 0, best, self.usual)
        score = np.where(letters > 0, most / np.maximum(true.sum(axis=1), 1e-12), 0.0)
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), (letters > 0).tolist(), strict=True)], score


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, gram, n), counted within a batch."""
    for batch in batches:
        langs, texts = (np.array(batch.column(k).to_pylist(), object) for k in range(2))
        for lang in sorted(set(langs)):
            grams = [h for codes, owner in _blocks(texts[langs == lang].tolist()) for h, _ in _grams(codes, owner)]
            if grams:
                h, n = np.unique(np.concatenate(grams), return_counts=True)
                yield pa.record_batch([pa.array([lang] * len(h)), h.view(np.int64), n.astype(np.int64)], names=["lang", "gram", "n"])
        batch = langs = texts = grams = h = n = None
    give_back()


def fit(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> LanguageFilter:
    """The filter for labelled rows (text, language), of which nulls are left out. What is collected are a number and the
    n-grams of each language."""
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    sizes = written(rows.groupBy("lang").agg(F.count("*").alias("size")), "sizes")
    listed = sorted(sizes.collect(), key=lambda r: r["lang"].encode())
    if not listed:
        return LanguageFilter.of([], [])
    languages = [r["lang"] for r in listed]
    chosen = F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < F.lit(TRAIN_DOCS * 1_000_000) / F.col("size")
    sample = rows.join(sizes, "lang").where(chosen).select("lang", "text")
    counts = sample.mapInArrow(_count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = written(counts, "grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rates = counts.join(totals, "lang").withColumn("rate", F.col("n") / F.col("total"))
    best = rates.groupBy("gram").agg(F.max("rate").alias("best"))
    own = rates.where((F.col("rate") >= MIN_RATE) & (F.col("n") >= MIN_COUNT)).join(best, "gram").where(F.col("rate") >= SHARE * F.col("best"))
    terms = own.select("lang", "gram").toPandas()
    usual = max(range(len(listed)), key=lambda k: (listed[k]["size"], -k))
    return LanguageFilter.of(languages, [terms.gram[terms.lang == x].to_numpy(np.int64).view(np.uint64) for x in languages], usual)


def predict(docs: DataFrame, model: LanguageFilter, text: Column) -> DataFrame:
    """docs with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.slots, model.usual))

    @F.pandas_udf("lang_pred string, score double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = LanguageFilter(*shared.value)
        for texts in batches:
            names, scores = [], []
            for s in range(0, len(texts), 256):
                a, b = model.predict(texts.iloc[s : s + 256].tolist())
                names += a
                scores.append(b)
            yield pd.DataFrame({"lang_pred": names, "score": np.concatenate(scores) if scores else np.zeros(0)})
            texts = None
        give_back()

    return docs.withColumn("__language", of(text)).select(*docs.columns, "__language.lang_pred", "__language.score")


def held_out(doc_id: Column) -> Column:
    """One in five ids; a null id is held out, as nothing says that it may be learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score for each document, by a filter fitted to those that aren't held out."""
    model = fit(docs.where(~held_out(docs[id_col])), text_col=text_col, lang_col=lang_col)
    rows = docs.select(docs[id_col].alias("doc_id"), held_out(docs[id_col]).alias("held_out"), docs[text_col].alias("text"))
    return predict(rows, model, F.col("text")).drop("text")


def drop_unidentified(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.0) -> DataFrame:
    """docs without those whose language can't be told: `und`, or a score under `least`."""
    model = fit(docs.where(~held_out(docs[id_col])), text_col=text_col, lang_col=lang_col)
    renamed = docs.select(*[docs[c].alias(f"c{k}") for k, c in enumerate(docs.columns)])
    text = F.col(f"c{docs.columns.index(text_col)}")
    keep = (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)
    return predict(renamed, model, text).where(keep).select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])
