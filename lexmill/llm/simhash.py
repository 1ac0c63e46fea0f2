"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints within `MAX_BITS` = 2 differing bits are linked. The index has two parts. Its upper nodes are masked bit
patterns: of the four 16-bit blocks of a fingerprint, two linked ones share at least two, so each of the six pairs of
blocks is a mask, and all fingerprints with the same bits under a mask share one upper node, dealt out by shuffle. Its
lower nodes, built inside a task, cover the node's members in Gray-code order, where neighbours differ in few bits:
each holds the bits that all its members share, and a pair of nodes is pruned, with all its members, once the bits
that both share differ in more than two places. Only a spanning forest of the links leaves a task, never all pairs.

An upper node with over `NODE_ROWS` members is split by a second mask over its 32 free bits (two of four 8-bit
blocks), again by six patterns that lose no link. Below that a node has 16 free bits, so 65,536 members at most.

Defined cases: null or empty text has no words and the fingerprint zero, linked like any other; fewer words than a
shingle needs give one shingle of them all; repeated rows stay and share all columns; documents with a null id get
their component's smallest id (null if it has none); an empty table gives no rows; extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.components import Forest, components
from lexmill.llm.storage import written

MAX_BITS = 2
NODE_ROWS = 8192
LEAF, FANOUT = 32, 8
#: Shingles that are unpacked to bits at once, whatever the length of a text.
CHUNK = 16_384


def fingerprint(text: str | None, width: int = 3) -> int:
    """Words are runs outside ASCII white space; A-Z count as a-z; a bit is set if over half the shingles set it."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(line, 42)
    gap = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts = np.concatenate(([0], gap + 1))[: len(words) - width + 1].tolist()
    ends = np.concatenate((gap, [len(line)]))[width - 1 :].tolist()
    digest, total, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(starts)
    for k in range(0, n, CHUNK):
        h = np.array([digest(line[a:b], 42) for a, b in zip(starts[k : k + CHUNK], ends[k : k + CHUNK], strict=True)], dtype=">u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprint_column(text: Column, width: int = 3) -> Column:
    """The fingerprint as a signed long."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, width) for t in texts], dtype=np.uint64).view(np.int64))

    return of(text)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each uint64 in the order of the reflected Gray code."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def gray_order(x: np.ndarray) -> np.ndarray:
    """Order of fingerprints of 64 bits, or of rows of them, by their place in the reflected Gray code."""
    if x.ndim == 1:
        return np.argsort(gray_rank(x), kind="stable")
    ranks, odd = [], np.uint64(0)
    for word in x.T:
        ranks.append(gray_rank(word) ^ odd)
        odd = np.where(ranks[-1] & np.uint64(1), np.uint64(2**64 - 1), np.uint64(0))
    return np.lexsort(ranks[::-1])


def _mask_keys(fp: Column, blocks: list[int], tag: int) -> Column:
    """The six upper nodes of a fingerprint: a number for the mask, and the bits under it."""
    pairs = [sum(b) for b in combinations(blocks, 2)]
    signed = [m - (1 << 64) if m >> 63 else m for m in pairs]
    return F.array(*[F.struct(F.lit(tag + k).alias("mask"), fp.bitwiseAND(F.lit(m)).alias("bits")) for k, m in enumerate(signed)])


_WIDE = [0xFFFF << s for s in (0, 16, 32, 48)]


def _narrow(mask: int) -> list[int]:
    """Of the wide mask's free 32 bits, four blocks of eight."""
    free = [b for b in _WIDE if b not in [*combinations(_WIDE, 2)][mask]]
    return [0xFF << s for b in free for s in ((b & -b).bit_length() - 1, (b & -b).bit_length() + 7)]


def link_node(fps: np.ndarray, bits: int = MAX_BITS) -> Forest:
    """Links among the distinct fingerprints of one upper node, uint64 or rows of them, by a self-join of its Gray-order
    tree. Pairs of nodes wait on a stack and are taken in blocks, so that memory stays bounded; a pair whose members are
    all in one component already is dropped."""
    count = np.bitwise_count if fps.ndim == 1 else lambda v: np.bitwise_count(v).sum(axis=-1, dtype=np.int64)
    order = gray_order(fps)
    x, n = fps[order], len(fps)
    forest = Forest(n)
    starts, levels = np.arange(0, n, LEAF), []
    ands, ors = np.bitwise_and.reduceat(x, starts), np.bitwise_or.reduceat(x, starts)
    while True:
        levels.append((~(ands ^ ors), ands, starts))
        if len(starts) == 1:
            break
        at = np.arange(0, len(starts), FANOUT)
        ands, ors, starts = np.bitwise_and.reduceat(ands, at), np.bitwise_or.reduceat(ors, at), starts[at]
    stack = [(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    step = np.arange(FANOUT)
    lane = np.arange(LEAF)
    while stack:
        level, a, b = stack.pop()
        if len(a) > 4096:
            stack += [(level, a[k : k + 4096], b[k : k + 4096]) for k in range(0, len(a), 4096)]
            continue
        shared, value, _ = levels[level]
        near = count((value[a] ^ value[b]) & shared[a] & shared[b]) <= bits
        a, b = a[near], b[near]
        if not len(a):
            continue
        if level:
            below = len(levels[level - 1][2])
            p, q = (a[:, None] * FANOUT + step)[:, :, None], (b[:, None] * FANOUT + step)[:, None, :]
            p, q = np.broadcast_arrays(p, q)
            keep = (p <= q) & (p < below) & (q < below)
            stack.append((level - 1, p[keep], q[keep]))
            continue
        for k in range(0, len(a), 512):
            i, j = a[k : k + 512, None] * LEAF + lane, b[k : k + 512, None] * LEAF + lane
            label_i, label_j = forest.label[np.minimum(i, n - 1)], forest.label[np.minimum(j, n - 1)]
            apart = (label_i != label_i[:, :1]).any(1) | (label_j != label_i[:, :1]).any(1)
            i, j = i[apart], j[apart]
            if not len(i):
                continue
            xi, xj = x[np.minimum(i, n - 1)], x[np.minimum(j, n - 1)]
            hit = (count(xi[:, :, None] ^ xj[:, None, :]) <= bits) & (i[:, :, None] < j[:, None, :]) & (j < n)[:, None, :]
            r, s, t = np.nonzero(hit)
            forest.link(i[r, s], j[r, t])
    back = np.empty(n, np.int64)
    own, root = forest.spanning()
    back[:] = np.arange(n)
    back[order[own]] = order[root]
    out = Forest(n)
    out.link(np.arange(n), back)
    return out


def _link_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (mask, bits): one upper node after the other, of which the last waits for the next batch."""
    out_schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    held = [np.empty(0, np.int64)] * 3

    def work(mask, bits, fp):
        if not len(fp):
            return None
        new = np.concatenate(([True], (mask[1:] != mask[:-1]) | (bits[1:] != bits[:-1])))
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(fp)))
        u, v = [], []
        two = at[size == 2]
        close = np.bitwise_count((fp[two] ^ fp[two + 1]).view(np.uint64)) <= MAX_BITS
        u.append(fp[two][close]), v.append(fp[two + 1][close])
        for s, k in zip(at[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            own, root = link_node(fp[s : s + k].view(np.uint64)).spanning()
            u.append(fp[s : s + k][own]), v.append(fp[s : s + k][root])
        return pa.record_batch([np.concatenate(u), np.concatenate(v)], schema=out_schema)

    for b in batches:
        rows = [np.concatenate((h, b.column(k).to_numpy(zero_copy_only=False).astype(np.int64))) for k, h in enumerate(held)]
        if not len(rows[0]):
            continue
        tail = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))
        cut = tail[-1] + 1 if len(tail) else 0
        held = [r[cut:] for r in rows]
        if cut:
            yield work(*[r[:cut] for r in rows])
    if len(held[0]):
        yield work(*held)


def link_fingerprints(distinct: DataFrame) -> DataFrame:
    """(fp) distinct -> (u, v): links whose components are those of all pairs within MAX_BITS."""
    keyed = written(distinct.select("fp", F.explode(_mask_keys(F.col("fp"), _WIDE, 0)).alias("k")).select("fp", "k.mask", "k.bits"), "upper")
    size = keyed.groupBy("mask", "bits").agg(F.count("*").alias("size")).where("size > 1")
    shared = written(keyed.join(size, ["mask", "bits"]), "shared")
    narrow = F.coalesce(*[F.when(F.col("mask") == m, _mask_keys(F.col("fp"), _narrow(m), 6 * (m + 1))) for m in range(6)])
    # the second mask's bits and the first one's together name the node
    split = shared.where(F.col("size") > NODE_ROWS).select("fp", F.col("bits").alias("wide"), F.explode(narrow).alias("k")).select("fp", F.col("k.mask").alias("mask"), F.col("k.bits").bitwiseOR(F.col("wide")).alias("bits"))
    nodes = shared.where(F.col("size") <= NODE_ROWS).select("mask", "bits", "fp").unionByName(split.select("mask", "bits", "fp"))
    return nodes.repartition("mask", "bits").sortWithinPartitions("mask", "bits").mapInArrow(_link_groups, "u long, v long")


def simhash(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """doc_id, fp (signed long), component_id, first (the one row of a component that stays) for each document."""
    fp = fingerprint_column(docs[text_col], width)
    table = written(docs.select(docs[id_col].alias("doc_id"), fp.alias("fp")), "fingerprints")
    groups = written(table.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    linked = components(link_fingerprints(groups.select("fp")))
    rooted = groups.join(linked, groups.fp == linked.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = written(rooted.join(least, "root").select("fp", "component_id"), "labels")
    return table.join(labels, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def dedup_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """docs, with one document of each component: the one of the smallest id. If rows share that id, the one of the
    smallest text hash stays, once. Documents without an id all stay, as nothing names the one to keep."""
    labels = simhash(docs, id_col=id_col, text_col=text_col, width=width)
    keep = labels.where("doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    staying = docs.join(keep, F.col(id_col) == F.col("kept_id"), "left_semi").unionByName(docs.where(F.col(id_col).isNull()))
    twice = written(docs.groupBy(F.col(id_col).alias("twice_id")).count().where("count > 1 and twice_id is not null").select("twice_id"), "twice")
    if twice.isEmpty():
        return staying
    once = staying.join(twice, F.col(id_col) == F.col("twice_id"), "left_anti")
    row = F.min_by(F.struct(*[F.col(c) for c in docs.columns]), F.xxhash64(text_col)).alias("row")
    first = staying.join(twice, F.col(id_col) == F.col("twice_id"), "left_semi").groupBy(F.col(id_col).alias("of")).agg(row)
    return once.unionByName(first.select("row.*"))
