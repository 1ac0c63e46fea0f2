"""Byte-level BPE encoding and decoding with a two-tier lookup.

The first tier resolves whole pre-tokens that the vocabulary holds: a minimal perfect hash (hash and displace) maps each
vocabulary entry to a slot of its own in a table without gaps, and one comparison tells an entry from a stranger. The
second tier encodes the rest: the bytes form a doubly linked list, a heap holds each adjacent pair by rank and place,
and the lowest pair is merged until none is left. A worker keeps the encodings of pre-tokens, as words repeat, until they
fill `KEPT_BYTES`, and starts anew then; pre-tokens of over `LONG` letters are forgotten at once. The vocabulary is opened
by each worker: its path is a name there, not one of the driver's.

Defined cases: null text counts as empty and gives no ids; repeated rows are encoded alike; an empty table gives no
rows; texts of any length are encoded whole; other columns are kept, and the result's names win over clashing ones.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyspark.sql.types as T
import regex
import xxhash
from pyspark.sql import DataFrame

from lexmill.llm.storage import give_back

#: Bytes, about, of the encodings that a worker keeps; letters of a pre-token that is worth it; pre-tokens taken at once.
KEPT_BYTES, LONG, PART = 256 << 20, 1024, 100_000
#: What an entry takes beside its letters and ids.
_ENTRY = 400
_ROWS = 256


class PerfectHash:
    """Minimal perfect hash of byte strings: n keys to 0..n-1. Each key falls into one of n/2 buckets by its hash; buckets,
    the largest first, take the first seed that sends all their keys to free slots. A bucket of one key, of which there are
    many and which come last, names a free slot itself, as -1 less the slot, rather than try seeds on a nearly full table."""

    def __init__(self, keys: list[bytes]):
        n = self.size = len(keys)
        self.buckets = max(1, n // 2)
        self.seeds = np.zeros(self.buckets, np.int64)
        self.keys: list[bytes] = [b""] * n
        self.values = np.zeros(n, np.int64)
        groups: list[list[tuple[int, int]]] = [[] for _ in range(self.buckets)]
        for i, key in enumerate(keys):
            h = xxhash.xxh64_intdigest(key)
            groups[h % self.buckets].append((h, i))
        taken, free = bytearray(n), 0
        for b in sorted(range(self.buckets), key=lambda b: -len(groups[b])):
            if not groups[b]:
                break
            seed = 0
            if len(groups[b]) == 1:
                free = taken.index(0, free)
                seed = -1 - free
            while True:
                slots = [self._slot(h, seed) for h, _ in groups[b]]
                if len(set(slots)) == len(slots) and not any(taken[s] for s in slots):
                    break
                seed += 1
            self.seeds[b] = seed
            for s, (_, i) in zip(slots, groups[b], strict=True):
                taken[s], self.keys[s], self.values[s] = 1, keys[i], i
        self.seeds, self.values = self.seeds.tolist(), self.values.tolist()

    def _slot(self, h: int, seed: int) -> int:
        if seed < 0:
            return -1 - seed
        x = (h ^ (seed * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF
        x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF
        return (x ^ (x >> 32)) % self.size

    def find(self, key: bytes) -> int:
        """Place of the key in the list it was built from, or -1."""
        h = xxhash.xxh64_intdigest(key)
        s = self._slot(h, self.seeds[h % self.buckets])
        return self.values[s] if self.keys[s] == key else -1


class Encoder:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            rows = [line.split() for line in f if line.strip()]
        entries = [(base64.b64decode(a), int(b)) for a, b in rows]
        self.hash = PerfectHash([k for k, _ in entries])
        self.ids = [r for _, r in entries]
        self.bytes_of = dict((r, k) for k, r in entries)
        self.find_all = regex.compile(pattern).findall
        by_bytes = dict(entries)
        self.of_byte = [by_bytes.get(bytes([b]), -1) for b in range(256)]
        # (left id, right id) -> id of the joined bytes, for every way to cut an entry in two: a merge needs no bytes
        self.joined: dict[tuple[int, int], int] = {}
        for key, rank in entries:
            for cut in range(1, len(key)):
                a, b = by_bytes.get(key[:cut]), by_bytes.get(key[cut:])
                if a is not None and b is not None:
                    self.joined[a, b] = rank
        # of kept pre-tokens: ids as text, the bytes that they decode to, their number
        self.texts: dict[str, str] = {}
        self.raws: dict[str, bytes] = {}
        self.sizes: dict[str, int] = {}
        self.held, self.long = 0, []

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a pre-token that isn't an entry: merges of the lowest rank first, of equal ones the leftmost."""
        ids = [self.of_byte[b] for b in piece]
        n, joined = len(ids), self.joined.get
        if -1 in ids:
            raise ValueError("the vocabulary lacks a single byte")
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := joined((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or joined((ids[i], ids[j])) != r:
                continue
            ids[i], ids[j] = r, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (x := joined((r, ids[k]))) is not None:
                    heapq.heappush(heap, (x, i))
            p = before[i]
            if p >= 0 and (x := joined((ids[p], r))) is not None:
                heapq.heappush(heap, (x, p))
        return [x for x in ids if x >= 0]

    def piece(self, token: str) -> list[int]:
        raw = token.encode()
        at = self.hash.find(raw)
        return [self.ids[at]] if at >= 0 else self.merge(raw)

    def encode(self, text: str) -> list[int]:
        return [x for t in self.find_all(text) for x in self.piece(t)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[x] for x in ids])

    def _keep(self, tokens: list[str]) -> None:
        """Have the encoding of each token in texts, raws and sizes, until the next call."""
        kept = self.texts, self.raws, self.sizes
        for t in self.long:
            for d in kept:
                del d[t]
        self.long = []
        if self.held > KEPT_BYTES:
            for d in kept:
                d.clear()
            self.held = 0
        for t in set(tokens).difference(self.texts):
            ids = self.piece(t)
            text, raw = self.texts[t], self.raws[t] = ",".join(map(str, ids)), self.decode(ids)
            self.sizes[t] = len(ids)
            if len(t) > LONG:
                self.long.append(t)
            else:
                self.held += _ENTRY + 2 * len(t) + len(text) + len(raw)

    def forget(self) -> None:
        for d in (self.texts, self.raws, self.sizes):
            d.clear()
        self.long.clear()
        self.held = 0

    def digest(self, text: str | None, into: list[np.ndarray] | None = None) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the decimal ids joined by commas, SHA-256 of the decoded bytes; the ids themselves
        are appended to into."""
        n, ids, decoded, sep = 0, hashlib.sha256(), hashlib.sha256(), b""
        parts = [np.zeros(0, np.int32)]
        for tokens in self._parts(text or ""):
            self._keep(tokens)
            joined = ",".join(map(self.texts.__getitem__, tokens))
            n += joined.count(",") + 1
            ids.update(sep + joined.encode())
            decoded.update(b"".join(map(self.raws.__getitem__, tokens)))
            sep = b","
            if into is not None:
                parts.append(np.fromstring(joined, dtype=np.int32, sep=","))
        if into is not None:
            into.append(np.concatenate(parts))
        return n, ids.hexdigest(), decoded.hexdigest()

    def count(self, text: str | None) -> int:
        n = 0
        for tokens in self._parts(text or ""):
            self._keep(tokens)
            n += sum(map(self.sizes.__getitem__, tokens))
        return n

    def _parts(self, text: str) -> Iterator[list[str]]:
        """Pre-tokens of a text, in lists of bounded length."""
        tokens = self.find_all(text)
        for k in range(0, len(tokens), PART):
            yield tokens[k : k + PART]


@cache
def encoder(path: str, pattern: str) -> Encoder:
    """One for each worker and vocabulary."""
    return Encoder(path, pattern)


def vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[str, str]:
    """(path, pattern) of an installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def _opened(path: str | None, pattern: str | None) -> Encoder:
    """In a worker: the encoder of a path and pattern, of the installed vocabulary's where they aren't given."""
    where, how = (path, pattern) if path and pattern else vocabulary()
    return encoder(path or where, pattern or how)


def _with_columns(docs: DataFrame, text_col: str, fields: list[T.StructField], row, done=lambda: None) -> DataFrame:
    """docs without columns of the fields' names, plus the fields; row makes an iterable of value lists from texts, done is
    called at the end of a task."""
    made = {f.name.lower() for f in fields}
    kept = [f for f in docs.schema.fields if f.name.lower() not in made]
    schema = T.StructType([*kept, *fields])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in fields]
        for batch in batches:
            for s in range(0, batch.num_rows, _ROWS):
                part = batch.slice(s, _ROWS)
                values = row(part.column(0).to_pylist())
                yield pa.record_batch([*part.columns[1:], *[pa.array(v, t) for v, t in zip(values, types, strict=True)]], names=[f.name for f in schema.fields])
            batch = part = values = None
        done()
        give_back()

    text = docs[text_col].alias("__text")
    return docs.select(text, *[docs[f.name] for f in kept]).mapInArrow(of, schema)


def encode_documents(docs: DataFrame, *, path: str | None = None, pattern: str | None = None, text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256; with_ids also token_ids."""
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        fields.append(T.StructField("token_ids", T.ArrayType(T.IntegerType())))

    def row(texts):
        e, ids = _opened(path, pattern), [] if with_ids else None
        out = list(zip(*[e.digest(t, ids) for t in texts], strict=True))
        return [*out, ids] if with_ids else out

    return _with_columns(docs, text_col, fields, row, lambda: _opened(path, pattern).forget())


def decode_ids(rows: DataFrame, ids_col: str = "token_ids", *, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """rows with `decoded`: the bytes of their ids."""
    return _with_columns(rows, ids_col, [T.StructField("decoded", T.BinaryType())], lambda ids: [[_opened(path, pattern).decode(x or []) for x in ids]])


def count_tokens(docs: DataFrame, *, path: str | None = None, pattern: str | None = None, text_col: str = "text") -> DataFrame:
    """docs with n_tokens."""
    return _with_columns(docs, text_col, [T.StructField("n_tokens", T.LongType())], lambda texts: [[_opened(path, pattern).count(t) for t in texts]], lambda: _opened(path, pattern).forget())
