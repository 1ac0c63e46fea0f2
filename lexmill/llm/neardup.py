"""Near-dedup of documents by the Jaccard similarity of their sets of word shingles: candidates by SimHash and its
hierarchical index, each then checked exactly.

Two sets' fingerprints differ in a share of their bits that follows from their angle: 0.15 at a similarity of 0.8. In 64
bits that is 10, up to 20, where unlike texts come as near, so a set has one of `WORDS` times 64 here. The upper nodes of
the index are masked bit patterns: a mask is a choice of bits, and all sets with the same bits under it share a node, dealt
out by shuffle. There are as many masks as it takes to miss a pair of the asked similarity with a chance of `MISS` (less for
closer pairs). Inside a node those sets are linked that differ in no more of their first `COMPARED` words than such a pair
does (`bound`): a large node by its Gray-order tree, a small one row by row. Only a spanning forest of the links leaves a
task. Sets of up to `SHORT` shingles, whose fingerprints are coarse, also meet by all that leave one shingle out, which at
0.8 loses none. What is linked, and linked by others, is a bucket; within it each pair is decided on the whole sets.

A document goes if a compared earlier one is similar enough; of two similar documents at least one goes. Earlier means: by
id (null last), then by a hash of the text. Buckets of up to `SMALL` sets compare all pairs. In a larger one all pairs
would be the square of a group of copies, so its sets are held against a centre, the shingles that most of a few of
them have. Two sets differ by no more than their differences from the centre together, so sets near the centre are
similar without a look at each other: all go but the earliest. That one is compared with all the rest. Sets further out
can only be similar if some of their differences are the same ones, so pairs come from an equi-join on the rarest
differences (a prefix filter: how many must agree follows from how far out the two are, and from their sizes, which the
similarity bounds too). Differences that many share are buckets of their own and take another round. Which centre is
taken changes the work, never what is found. Before the sets of a pair are read, their parity bits sort out those that
must differ in too many shingles, again without a loss.

Defined cases: texts without words are copies of each other; fewer words than a shingle needs give one shingle of them
all; of rows with equal id and text one stays; rows that share an id but no text are documents of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from math import acos, ceil, exp, lgamma, log, log2, pi, sqrt
from operator import add, xor

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm import simhash
from lexmill.llm.components import Forest, components
from lexmill.llm.storage import column_named, give_back, written

#: Words of a fingerprint, and those of them that are compared within a node.
WORDS, COMPARED = 8, 4
#: Bits under a mask at least; they grow with the table so that a node keeps about NODE_ROWS rows. Nodes over TREE take a tree.
LEAST_BITS, NODE_ROWS, TREE = 10, 4096, 1024
MISS = 1e-5
SHORT = 8
SMALL = 16
#: About as many sets of a bucket vote for its centre.
VOTES = 32
#: Steps of distance from the centre by which sets are compared with the earliest that are that much nearer.
STEPS = 8
#: Words of a set's parity bits, by which pairs are sorted out before their sets are read.
PARITY = 32
#: Places by which rows are told that can't be among those asked for, so that their texts needn't move; 64 to a row.
PLACES = 2**24
#: Far below the gap between any two sums of differences and shares.
EPS = 1e-6
_PLUS = np.random.default_rng(7).integers(0, 2**63, WORDS, dtype=np.uint64)
SET = ["s1", "s2"]


def shingles(text: str | None, width: int) -> np.ndarray:
    """Distinct hashes, sorted. Words are runs outside ASCII white space; A-Z count as a-z."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(line, 42)], np.uint64)
    gap = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts = np.concatenate(([0], gap + 1))[: len(words) - width + 1].tolist()
    ends = np.concatenate((gap, [len(line)]))[width - 1 :].tolist()
    return np.unique(np.array([digest(line[a:b], 42) for a, b in zip(starts, ends, strict=True)], np.uint64))


def fingerprint(h: np.ndarray) -> np.ndarray:
    """SimHash of a set of shingles, as words of 64 bits: a bit is set if over half the shingles set it."""
    total = np.zeros(WORDS * 64, np.int64)
    for k in range(0, len(h), 255):  # as many as a byte counts
        z = h[k : k + 255, None] + _PLUS
        z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        total += np.unpackbits(z.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * total > len(h)).view(np.uint64)


def short_keys(h: np.ndarray) -> list[int]:
    """Of a set of few shingles, keys that it shares with each set that has one more or one less."""
    if not 0 < len(h) <= SHORT:
        return []
    mixed = [xxhash.xxh64_intdigest(x.tobytes(), 3) for x in h]
    whole = reduce(xor, mixed)
    return [(k ^ whole) - 2**63 for k in (0, *mixed)]


def parity(h: np.ndarray) -> np.ndarray:
    """Bits that tell whether an odd number of shingles falls to each. Two sets differ in as many shingles at least as these
    differ in bits, as one shingle turns one bit."""
    return np.packbits(np.bincount((h % np.uint64(PARITY * 64)).astype(np.int64), minlength=PARITY * 64).astype(np.uint8) & 1).view(np.int64)


def _differing(similarity: float) -> float:
    """The chance that a bit differs between two sets of that similarity: the angle between them; of sets of one size, for
    which it is widest."""
    return acos(2 * similarity / (1 + similarity)) / pi


def _choose(n: int, k: int) -> float:
    return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)


def masks(similarity: float, width: int) -> np.ndarray:
    """Places of the bits under each mask of `width` bits: as many masks as it takes to miss a pair of that similarity with a
    chance of MISS."""
    bits, q = WORDS * 64, max(_differing(similarity), 1e-9)
    d = range(bits - width + 1)
    chance = np.array([exp(_choose(bits, k) + k * log(q) + (bits - k) * log(1 - q)) for k in d])
    none = np.array([1 - exp(_choose(bits - k, width) - _choose(bits, width)) for k in d])
    count = 1
    while (chance * none**count).sum() > MISS:
        count += 1
    rng = np.random.default_rng(11)
    return np.array([rng.choice(bits, width, replace=False) for _ in range(count)])


def bound(similarity: float) -> int:
    """Bits of the compared words in which two sets of that similarity differ at most, but for a chance of 1e-7."""
    bits, q = COMPARED * 64, _differing(similarity)
    return ceil(bits * q + 5.8 * sqrt(bits * q * (1 - q)))


def _sketch(text: Column, width: int) -> Column:
    @F.pandas_udf("s1 long, s2 long, n long, fp array<long>, short array<long>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for t in texts:
                h = shingles(t, width)
                raw = h.tobytes()
                out.append((xxhash.xxh64_intdigest(raw, 1) - 2**63, xxhash.xxh64_intdigest(raw, 2) - 2**63, len(h), fingerprint(h).view(np.int64), short_keys(h)))
            yield pd.DataFrame(out, columns=["s1", "s2", "n", "fp", "short"])
            texts = out = None
        give_back()

    return of(text)


def _nodes(fp: Column, places: np.ndarray) -> Column:
    """The upper nodes of a fingerprint: numbers made of the mask and the bits under it."""
    value = 1 << np.arange(places.shape[1], dtype=np.int64)
    first = np.arange(len(places), dtype=np.int64) << places.shape[1]

    @F.pandas_udf("array<long>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for fps in batches:
            out = []
            for k in range(0, len(fps), 1024):
                words = np.array(fps.iloc[k : k + 1024].tolist(), np.int64).reshape(-1, WORDS)
                out += list(np.unpackbits(words.view(np.uint8), axis=1)[:, places] @ value + first)
            yield pd.Series(out, dtype=object)
            fps = out = None
        give_back()

    return of(fp)


def link_rows(node: np.ndarray, fps: np.ndarray, bits: int) -> Forest:
    """Links among rows sorted by node: of the same node, and at most `bits` apart. Nodes of over `TREE` rows take their
    Gray-order tree; in the others, each row meets the one that is 1, 2, ... rows on, over all nodes at once."""
    forest = Forest(len(node))
    starts = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
    sizes = np.diff(np.append(starts, len(node)))
    for s, k in zip(starts[sizes > TREE].tolist(), sizes[sizes > TREE].tolist(), strict=True):
        same = np.unique(fps[s : s + k], axis=0, return_inverse=True, return_index=True)
        own, root = simhash.link_node(fps[s : s + k][same[1]], bits).spanning()
        forest.link(np.arange(s, s + k), s + same[1][same[2].reshape(-1)])
        forest.link(s + same[1][own], s + same[1][root])
    rank = np.flatnonzero(sizes <= TREE)
    rank = rank[np.argsort(-sizes[rank], kind="stable")]
    sizes = sizes[rank]
    ends = np.cumsum(sizes)
    rows = np.repeat(starts[rank] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
    of, words = np.repeat(np.arange(len(rank)), sizes), fps[rows].T.copy()
    for d in range(1, sizes[0] if len(sizes) else 0):
        m = ends[np.searchsorted(-sizes, -d) - 1]  # rows of the nodes that have more than d
        apart = np.zeros(m - d, np.uint16)
        for w in words:
            apart += np.bitwise_count(w[: m - d] ^ w[d:m])
        hit = np.flatnonzero((apart <= bits) & (of[: m - d] == of[d:m]))
        if len(hit):
            forest.link(rows[hit], rows[hit + d])
    return forest


def _link_nodes(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (node, s1, words) sorted by node -> (u, v): links among the s1 whose components are those of all pairs of a
    node that are at most `bits` apart. The last node of a batch waits for the next one."""

    def work(columns: list[np.ndarray]) -> pa.RecordBatch:
        own, root = link_rows(columns[0], np.stack(columns[2:], axis=1).view(np.uint64), bits).spanning()
        return pa.record_batch([columns[1][own], columns[1][root]], names=["u", "v"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * (2 + COMPARED)
        for b in batches:
            held = [np.concatenate((h, b.column(k).to_numpy(zero_copy_only=False))) for k, h in enumerate(held)]
            tail = np.flatnonzero(held[0] != held[0][-1]) if len(held[0]) else []
            if len(tail):
                cut = tail[-1] + 1
                yield work([h[:cut] for h in held])
                held = [h[cut:] for h in held]
        if len(held[0]):
            yield work(held)
        b = held = None
        give_back()

    return linked


def link_sets(groups: DataFrame, similarity: float) -> DataFrame:
    """(s1, n, fp, short) -> (u, v): links between the s1, of whose components each holds all sets that are similar to one of it."""
    width = max(LEAST_BITS, ceil(log2(max(1, groups.count()) / NODE_ROWS)))
    places = masks(similarity, width)
    words = [F.get("fp", F.lit(k)).alias(f"f{k}") for k in range(COMPARED)]
    rows = groups.where("n > 0").select("s1", *words, _nodes(F.col("fp"), places).alias("nodes")).select(F.explode("nodes").alias("node"), "s1", *[f"f{k}" for k in range(COMPARED)])
    near = rows.repartition("node").sortWithinPartitions("node").mapInArrow(_link_nodes(bound(similarity)), "u long, v long")
    short = groups.select("s1", F.explode("short").alias("key"))
    least = short.groupBy("key").agg(F.min("s1").alias("v"), F.count("*").alias("c")).where("c > 1").drop("c")
    return near.unionByName(short.join(least, "key").where("s1 <> v").select(F.col("s1").alias("u"), "v"))


def _set(text: Column, width: int) -> Column:
    @F.pandas_udf("set array<long>, parity array<long>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            sets = [shingles(t, width) for t in texts]
            yield pd.DataFrame({"set": [h.view(np.int64) for h in sets], "parity": [parity(h) for h in sets]})
            texts = sets = None
        give_back()

    return of(text)


def _asked(rows: DataFrame, of: DataFrame) -> DataFrame:
    """The rows (doc_id, th, ...) that of (of_id, of_th, ...) asks for, with its columns. Bits of bounded number sort out
    most of the others first, where they are; which rows are found is left to the join."""
    at = lambda *key: F.pmod(F.xxhash64(*key), F.lit(PLACES))
    marks = of.select(at("of_id", "of_th").alias("at")).groupBy(F.expr("at div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("marks"))
    some = rows.withColumn("at", at("doc_id", "th")).join(F.broadcast(marks), F.expr("at div 64 = word")).where("shiftright(marks, cast(at % 64 as int)) & 1 = 1")
    return some.drop("at", "word", "marks").join(of, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("th") == F.col("of_th")))


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(s1, s2, o1, o2) -> (s1, s2) of those whose sets are as similar as asked."""
    a = sets.select(*SET, F.col("set").alias("a"))
    b = sets.select(F.col("s1").alias("o1"), F.col("s2").alias("o2"), F.col("set").alias("b"))
    both = pairs.distinct().join(a, SET).join(b, ["o1", "o2"]).withColumn("common", F.size(F.array_intersect("a", "b")))
    return both.where(F.col("common") >= F.lit(similarity) * (F.size("a") + F.size("b") - F.col("common")) - 1e-9).select(*SET).distinct()


def _centres(active: DataFrame, sets: DataFrame, salt: int) -> DataFrame:
    """(k, g, centre): what over half of a bucket's voters have; g is the same where the centre is."""
    votes = active.where(F.pmod(F.xxhash64("k", *SET, F.lit(salt)), F.ceil(F.col("c") / VOTES)) == 0).select("k", *SET)
    held = votes.join(sets, SET).select("k", F.explode("set").alias("x")).groupBy("k", "x").agg(F.count("*").alias("for"))
    most = held.join(votes.groupBy("k").agg(F.count("*").alias("of")), "k").where("2 * for > of")
    centre = most.groupBy("k").agg(F.array_sort(F.collect_list("x")).alias("centre"))
    out = active.select("k").distinct().join(centre, "k", "left").withColumn("centre", F.coalesce("centre", F.array().cast("array<long>")))
    return out.select("k", F.xxhash64("centre").alias("g"), "centre")


def _from_centre(active: DataFrame, sets: DataFrame, share: float, salt: int) -> DataFrame:
    """(g, s1, s2, ord, n, d, e, by_step, f): each set with its differences d from the centre, and by how much e their
    number exceeds its share; by_step tells that an earlier set is similar, f is the earliest of those with e <= 0."""
    centres = written(_centres(active, sets, salt), "centres")
    hubs = centres.groupBy("g").agg(F.any_value("centre").alias("centre"))
    members = active.join(centres.select("k", "g"), "k").select("g", *SET, "ord", "n").distinct()
    apart = members.join(hubs, "g").join(sets, SET)
    apart = apart.withColumn("d", F.concat(F.array_except("set", "centre"), F.array_except("centre", "set")))
    apart = apart.select("g", *SET, "ord", "n", "d", (F.size("d") - share * F.col("n")).alias("e"), (share * F.size("centre") / STEPS).alias("step"))
    apart = written(apart, "apart")
    # two sets are similar if the sum of their e is not above 0
    nearer = [F.min(F.when(F.col("e") <= EPS - j * F.col("step"), F.col("ord"))).alias(f"l{j}") for j in range(STEPS + 1)]
    f = F.min(F.when(F.col("e") <= EPS, F.struct("ord", *SET, "n", "d"))).alias("f")
    goes = F.lit(False)
    for j in range(STEPS + 1):
        goes |= F.coalesce((F.col("e") <= j * F.col("step") + EPS) & (F.col("ord") > F.col(f"l{j}")), F.lit(False))
    return apart.join(apart.groupBy("g").agg(*nearer, f), "g").select("g", *SET, "ord", "n", "d", "e", goes.alias("by_step"), "f")


def _by_difference(rest: DataFrame) -> DataFrame:
    """Buckets (k, s1, s2, ord, n, e, low, c, lows) of sets outside their centre's reach, one for each difference that
    can tell a similar pair. low marks those that need no look at differences beyond this as the nearer of a pair."""
    each = rest.select("g", *SET, F.explode("d").alias("x"))
    shared = each.groupBy("g", "x").agg(F.count("*").alias("f")).where("f > 1")
    ranked = each.join(shared, ["g", "x"]).groupBy("g", *SET).agg(F.array_sort(F.collect_list(F.struct("f", "x"))).alias("xs"))
    least = rest.groupBy("g").agg(F.min("e").alias("least"))
    ranked = ranked.join(rest.select("g", *SET, "ord", "n", "e", F.size("d").alias("size")), ["g", *SET]).join(least, "g")
    # what two similar sets share of their differences: half the sum of their e at least, and all of one's but those that
    # tell the two apart, of which there are `apart` at most, as the other's size is within the similarity too
    share = (F.col("size") - F.col("e")) / F.col("n")
    apart = 2 * (F.col("size") - F.col("e")) / (1 - share)
    common = F.greatest((F.col("e") + F.col("least")) / 2, F.col("size") - apart)
    # differences that no other has are the rarest and come before those in xs
    # so many of the rarest that a set near enough shares one of them; cut out before they become rows
    rarest = F.slice("xs", F.lit(1), F.greatest(F.lit(0), F.size("xs") + 1 - F.ceil(common - EPS).cast("int")))
    ranked = ranked.select("*", F.posexplode(rarest).alias("pos", "at")).withColumn("must", F.size("xs") - F.col("pos"))
    low = (F.col("must") >= F.ceil(F.col("e") - EPS)).alias("low")
    dealt = written(ranked.select(F.xxhash64("g", "at.x").alias("k"), "g", *SET, "ord", "n", "e", low), "dealt")
    count = [F.count("*").alias("c"), F.count_if("low").alias("lows"), F.any_value("g").alias("g")]
    who = [F.bit_xor("s1").alias("x1"), F.bit_xor("s2").alias("x2"), F.bit_xor(F.when(F.col("low"), F.col("s1"))).alias("x3")]
    sizes = dealt.groupBy("k").agg(*count, *who).where("c > 1 and lows > 0")
    once = sizes.groupBy("c", "lows", "g", "x1", "x2", "x3").agg(F.min("k").alias("k"))  # of buckets with the same sets, one
    return dealt.drop("g").join(once.select("k", "c", "lows"), "k")


def _near_sets(rows: DataFrame, groups: DataFrame, width: int, similarity: float) -> DataFrame:
    """(s1, s2) of the sets that go."""
    linked = written(components(link_sets(groups, similarity)), "linked")
    keyed = groups.select(*SET, "ord", "n", F.lit(0.0).alias("e"), F.lit(True).alias("low")).join(linked, F.col("s1") == F.col("node")).withColumnRenamed("root", "k").drop("node")
    size = keyed.groupBy("k").agg(F.count("*").alias("c"), F.count("*").alias("lows"))
    active = written(keyed.join(size, "k"), "buckets")
    of = active.select(*SET, F.col("ord.doc_id").alias("of_id"), F.col("ord.th").alias("of_th")).distinct()
    texts = _asked(rows, of).select(*SET, "text").dropDuplicates(SET)
    sets = written(texts.select(*SET, _set(F.col("text"), width).alias("of")).select(*SET, "of.*"), "sets")

    # J >= t is: sets of n and m shingles differ in at most (n + m) * (1 - t) / (1 + t)
    share = (1 - similarity) / (1 + similarity)
    small, gone, most, salt = active.where(F.col("c") * F.col("lows") <= SMALL * SMALL), None, SMALL, 0
    active = written(active.where(F.col("c") * F.col("lows") > SMALL * SMALL), "large")
    while not active.isEmpty():
        apart = written(_from_centre(active, sets, share, salt), "judged")
        differ = F.size(F.array_except("d", "f.d")) + F.size(F.array_except("f.d", "d"))
        near_first = (F.col("ord") != F.col("f.ord")) & (differ <= share * (F.col("n") + F.col("f.n")) + EPS)
        later = F.coalesce(near_first & (F.col("ord") > F.col("f.ord")), F.lit(False))
        near = apart.where(F.col("by_step") | later).select(*SET).unionByName(apart.where(near_first & (F.col("ord") < F.col("f.ord"))).select("f.s1", "f.s2"))
        near = written(near.distinct(), "near")
        gone = near if gone is None else gone.unionByName(near)
        rest = written(apart.where(F.col("e") > EPS).join(near, SET, "left_anti").select("g", *SET, "ord", "n", "d", "e"), "rest")
        left = written(_by_difference(rest), "left")
        most, salt = most * 2, salt + 1
        within = F.col("c") * F.col("lows") <= most * most
        small = small.unionByName(left.where(within).select(small.columns))
        active = left.where(~within)
    if gone is not None:
        small = written(small.join(gone.distinct(), SET, "left_anti"), "small")
    small = small.join(sets.select(*SET, "parity"), SET)
    a = small.where("low").select("k", "ord", *SET, "n", "e", "parity")
    b = small.select("k", F.col("ord").alias("o"), F.col("s1").alias("o1"), F.col("s2").alias("o2"), F.col("n").alias("m"), F.col("e").alias("o_e"), F.col("parity").alias("o_parity"))
    odd = reduce(add, [F.bit_count(F.get("parity", F.lit(k)).bitwiseXOR(F.get("o_parity", F.lit(k)))) for k in range(PARITY)])
    fits = (F.col("n") >= F.lit(similarity) * F.col("m") - 1e-9) & (F.col("m") >= F.lit(similarity) * F.col("n") - 1e-9)
    nearer = (F.col("e") < F.col("o_e")) | (F.col("e") == F.col("o_e")) & (F.col("ord") < F.col("o"))
    pairs = a.join(b, "k").where(nearer & fits & (odd <= share * (F.col("n") + F.col("m")) + EPS))
    goes, stays = F.struct(*SET), F.struct(F.col("o1").alias("s1"), F.col("o2").alias("s2"))
    pairs = pairs.select(F.when(F.col("ord") > F.col("o"), F.struct(goes.alias("a"), stays.alias("b"))).otherwise(F.struct(stays.alias("a"), goes.alias("b"))).alias("p"))
    near = _similar(pairs.select("p.a.s1", "p.a.s2", F.col("p.b.s1").alias("o1"), F.col("p.b.s2").alias("o2")), sets, similarity)
    return written((near if gone is None else near.unionByName(gone)).distinct(), "gone")


def dedup_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without those that are near copies of an earlier one."""
    rows = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(docs[text_col]).alias("th"), docs[text_col].alias("text"))
    sketched = written(rows.select("doc_id", "th", _sketch(F.col("text"), width).alias("s")).select("doc_id", "th", "s.*"), "sketches")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")
    groups = written(sketched.groupBy(*SET).agg(F.min(order).alias("ord"), *[F.any_value(c).alias(c) for c in ("n", "fp", "short")]), "groups")
    kept = groups.join(_near_sets(rows, groups, width, similarity), SET, "left_anti")
    kept = written(kept.select(F.col("ord.doc_id").alias("of_id"), F.col("ord.th").alias("of_th")), "kept")
    th = column_named(docs, "th")
    staying = docs.withColumn(th, F.xxhash64(text_col)).join(kept, F.col(id_col).eqNullSafe(F.col("of_id")) & (F.col(th) == F.col("of_th")), "left_semi")
    # of rows with equal id and text, one
    twice = sketched.groupBy(F.col("doc_id").alias("of_id"), F.col("th").alias("of_th")).count().where("count > 1").drop("count")
    twice = written(twice, "twice")
    if twice.isEmpty():
        return staying.drop(th)
    same = F.col(id_col).eqNullSafe(F.col("of_id")) & (F.col(th) == F.col("of_th"))
    row = F.min_by(F.struct(*[F.col(c) for c in docs.columns]), F.xxhash64(*docs.columns)).alias("row")
    one = staying.join(twice, same, "left_semi").groupBy(F.col(id_col).alias("of"), F.col(th).alias("of_th")).agg(row)
    return staying.join(twice, same, "left_anti").drop(th).unionByName(one.select("row.*"))
