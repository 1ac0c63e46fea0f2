"""Quality rules with an isolation forest on rule statistics.

Rules count what low-quality text shows: few words, symbols, equal lines, repeated three-word windows, long words. A base
rule rejects a document outright. For the others an isolation forest decides: each tree splits a small random sample of
documents at random values of random statistics until they are alone; documents that end on short paths are anomalous.
The threshold comes from labelled rows: over a histogram of all labelled scores, the one with the best mean of the shares
of good rows kept and bad rows rejected, among those that keep at least `KEEP_GOOD` of the good ones.

The forest is fitted on a hash-chosen sample of about `FIT_ROWS` documents at most (all if there are fewer), so that what
comes to the driver is bounded. The statistics, the scores and the threshold cover every document.

Defined cases: null text has no words; base_failed then holds, so it isn't kept; repeated rows are counted and scored
alike; labels that are null, or name no document, count for nothing; a label counts once for each document of its id,
however often it is repeated, and contrary ones both count; without labels of both kinds the score at which 5 %
of the sample would go is the threshold; empty tables give no rows; extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.storage import written

SYMBOLS = "#*$%&|<>"
FIT_ROWS, TREES, SAMPLE, SEED = 20_000, 100, 256, 31
KEEP_GOOD, BINS = 0.97, 2000
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SPACE = dict.fromkeys(map(ord, " \t\n\v\f\r"))
_SYMBOL = {ord(c): None for c in SYMBOLS}


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words in windows of `width` that the text has twice or more, the first ones included."""
    n = len(words)
    if n <= width:
        return 0
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    window = code[: n - width + 1]
    for k in range(1, width):
        # renumbered at each step, so that numbers stay small in texts of any length
        pair = window * len(ids) + code[k : n - width + 1 + k]
        window = np.unique(pair, return_inverse=True)[1]
    often = np.flatnonzero(np.bincount(window)[window] > 1)
    inside = np.zeros(n + 1, np.int64)
    np.add.at(inside, often, 1)
    np.add.at(inside, often + width, -1)
    return int((np.cumsum(inside) > 0).sum())


def statistics(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; words are runs outside ASCII white space."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(" \t\v\f\r")]
    symbols = len(text) - len(text.translate(_SYMBOL)) if any(c in text for c in SYMBOLS) else 0
    return len(words), len(text.translate(_SPACE)), symbols, len(lines) - len(set(lines)), repeated_words(words)


def _statistics_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = np.array([statistics(t) for t in b.iloc[:, 1]], np.int64).reshape(-1, 5)
        yield pd.DataFrame({"doc_id": b.iloc[:, 0], **{c: rows[:, k] for k, c in enumerate(COUNTS)}})


def features(rows: np.ndarray) -> np.ndarray:
    """The length, and the other statistics by word, so that long and short texts compare; what has no bound as a logarithm,
    as splits are drawn evenly over a range and a few huge values would take them all."""
    n = np.maximum(rows[:, 0], 1)
    return np.column_stack((np.log1p(rows[:, 0]), np.log1p(rows[:, 1] / n), np.log1p(rows[:, 2] / n), rows[:, 3] / n, rows[:, 4] / n))


@dataclass
class IsolationForest:
    """Trees as arrays: feature (-1 at a leaf), value, left child, path length at a leaf. The right child follows left."""

    feature: np.ndarray
    value: np.ndarray
    child: np.ndarray
    path: np.ndarray
    norm: float

    @staticmethod
    def _expected(n: float) -> float:
        return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    @classmethod
    def fit(cls, x: np.ndarray) -> IsolationForest:
        rng = np.random.default_rng(SEED)
        size = min(SAMPLE, len(x))
        depth, nodes = int(np.ceil(np.log2(max(size, 2)))), 2 * size
        shape = (TREES, max(nodes, 1))
        feature, value, child, path = np.full(shape, -1), np.zeros(shape), np.zeros(shape, np.int64), np.zeros(shape)
        for t in range(TREES):
            todo, used = [(0, rng.choice(len(x), size, replace=False) if size else np.zeros(0, int), 0)], 1
            while todo:
                at, rows, d = todo.pop()
                low, high = (x[rows].min(axis=0), x[rows].max(axis=0)) if len(rows) else (np.zeros(x.shape[1]),) * 2
                open_ = np.flatnonzero(high > low)
                if d >= depth or len(rows) <= 1 or not len(open_):
                    path[t, at] = d + cls._expected(len(rows))
                    continue
                f = rng.choice(open_)
                v = rng.uniform(low[f], high[f])
                right = x[rows, f] > v
                feature[t, at], value[t, at], child[t, at] = f, v, used
                todo += [(used, rows[~right], d + 1), (used + 1, rows[right], d + 1)]
                used += 2
        return cls(feature, value, child, path, max(cls._expected(size), 1e-9))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Near 1: anomalous; under 0.5: ordinary."""
        total = np.zeros(len(x))
        for feature, value, child, path in zip(self.feature, self.value, self.child, self.path, strict=True):
            at = np.zeros(len(x), np.int64)
            while True:
                f = feature[at]
                inner = np.flatnonzero(f >= 0)
                if not len(inner):
                    break
                node = at[inner]
                at[inner] = child[node] + (x[inner, f[inner]] > value[node])
            total += path[at]
        return 2.0 ** (-total / TREES / self.norm)


def measure(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the rule statistics of each document."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(_statistics_of, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS))


def _base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _score(measured: DataFrame, forest: IsolationForest) -> DataFrame:
    shared = measured.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def of(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            yield pd.Series(shared.value.score(features(np.column_stack([c.to_numpy(np.float64) for c in columns]))))

    return measured.withColumn("anomaly", of(*COUNTS))


def threshold(histogram: pd.DataFrame, sample: np.ndarray) -> float:
    """From (bin, quality, n) of labelled rows: scores over the result are rejected."""
    good, bad = (np.bincount(h.bin, h.n, BINS + 1) if len(h := histogram[histogram.quality == q]) else np.zeros(BINS + 1) for q in (1, 0))
    if not good.sum() or not bad.sum():
        return float(np.quantile(sample, 0.95)) if len(sample) else 1.0
    kept = np.cumsum(good) / good.sum()
    rejected = 1 - np.cumsum(bad) / bad.sum()
    gain = np.where(kept >= KEEP_GOOD, kept + rejected, -1.0)
    return float((gain.argmax() + 1) / BINS)


def judge(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """doc_id, the statistics, base_failed, anomaly and kept for each document."""
    measured = written(measure(docs, id_col=id_col, text_col=text_col), "statistics")
    rows = measured.count()
    part = min(1.0, FIT_ROWS / max(rows, 1))
    chosen = measured.where(~_base_failed() & (F.pmod(F.xxhash64("doc_id", *COUNTS), F.lit(1_000_000)) < part * 1_000_000))
    sample = chosen.select(*COUNTS).toPandas().to_numpy(np.float64).reshape(-1, len(COUNTS))
    # in an order of their own, whatever the partitions
    sample = sample[np.lexsort(sample.T)]
    forest = IsolationForest.fit(features(sample))
    scored = written(_score(measured, forest), "scored")
    graded = labels.select(labels[label_id].alias("of"), labels[label_col].alias("quality")).where("of is not null and quality is not null").distinct()
    bins = scored.where(~_base_failed()).join(graded, F.col("doc_id") == F.col("of")).groupBy(F.floor(F.col("anomaly") * BINS).cast("int").alias("bin"), "quality").agg(F.count("*").alias("n"))
    limit = threshold(bins.toPandas(), forest.score(features(sample)) if len(sample) else np.zeros(0))
    failed = _base_failed()
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("anomaly") <= limit))
