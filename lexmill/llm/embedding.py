"""Embedding near-dedup by Euclidean p-stable hashing.

A table's key is the floor of `k` random Gaussian projections of the normalised vector, each quantised to width
`WIDTH`. Vectors that share a key in any of `tables` tables are compared exactly, in double precision. A pair is counted
in the first table in which it meets, so counts are exact for all pairs found. `k` grows with the logarithm of the
largest label, and the number of tables with it, so that a pair at the threshold itself is missed with a probability
of at most `MISS` (closer pairs far less often) whatever the size.

Identical vectors are collapsed before hashing and counted by their multiplicity. A key with over `TILE` vectors is cut
into tiles, and each pair of tiles is a task's work of fixed size; tasks return a count for each vector and a spanning
forest of the links, never pairs. A key of n different vectors takes n * n / TILE rows of work: exact counts of links need
all its pairs compared, and a tile is as large as a task's memory allows, so that few rows are sent for them.

Defined cases: a null label, and a vector that is null, empty, zero or holds null or non-finite components, link with
nothing (n_links 0, own component); vectors of different length don't link; repeated rows are vectors of their own
that link with each other; a null vec_id takes the component's smallest id and isn't kept; an empty table gives no
rows; extra columns are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.components import Forest, components
from lexmill.llm.storage import written

WIDTH, MISS, TILE, BLOCK, SEED = 1.6, 1e-5, 8192, 256, 977
#: Numbers that a tile holds at most: vectors of over 1,024 have smaller tiles.
TILE_NUMBERS = 1 << 23
#: Vectors without relation that a key should hold beside those it is meant for.
STRANGERS = 64


def _meets(distance: float) -> float:
    """Chance that one quantised projection puts two vectors at this distance into one cell."""
    r = WIDTH / distance
    return 1 - math.erfc(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def table_sizes(rows: int, threshold: float) -> tuple[int, int]:
    """(projections a key, tables) for the largest label's number of vectors."""
    near, far = _meets(math.sqrt(2 - 2 * threshold)), _meets(math.sqrt(2))
    k = max(6, math.ceil(math.log(max(1.0, rows / STRANGERS)) / -math.log(far)))
    return k, math.ceil(math.log(MISS) / math.log1p(-(near**k)))


def _unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _keys(k: int, tables: int) -> Column:
    """A vector's key in each table, as a 32-bit hash of its cells."""

    @F.pandas_udf("array<int>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        made: dict[int, tuple] = {}
        for vectors in batches:
            out = np.empty(len(vectors), object)
            dims = vectors.map(len).to_numpy()
            for dim in np.unique(dims).tolist():
                if dim not in made:
                    rng = np.random.default_rng([SEED, dim])
                    made[dim] = rng.standard_normal((dim, tables * k)), rng.random(tables * k) * WIDTH, rng.integers(1, 2**62, (1, 1, k), dtype=np.int64) | 1
                planes, shift, mult = made[dim]
                at = np.flatnonzero(dims == dim)
                for s in range(0, len(at), 512):
                    part = at[s : s + 512]
                    cells = np.floor((_unit(np.stack(vectors.iloc[part].to_list())) @ planes + shift) / WIDTH).astype(np.int64).reshape(len(part), tables, k)
                    with np.errstate(over="ignore"):
                        mixed = ((cells + 7) * mult).sum(axis=2)
                        mixed ^= mixed >> 29
                        mixed *= np.int64(-4658895280553007687)
                    for i, row in zip(part.tolist(), (mixed >> 32).astype(np.int32), strict=True):
                        out[i] = row
            yield pd.Series(out)

    return of(F.col("vector"))


def _compare(threshold: float):
    """Rows sorted by work (label, dim, table, key, tile): one piece of work after the other. Returns counts (u, null,
    n) of linked vectors, and links (u, v, 0)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("n", pa.int64())])

        def work(rows: pa.Table) -> pa.RecordBatch:
            rid, times, side, table = (rows.column(c).to_numpy() for c in ("rid", "times", "side", "table"))
            vectors, keys = (rows.column(c).combine_chunks().flatten().to_numpy().reshape(len(rid), -1) for c in ("vector", "keys"))
            vectors, keys = _unit(vectors), keys[:, : int(table[0])]
            left, right = np.flatnonzero(side < 2), np.flatnonzero(side > 0)  # 0: left tile, 2: right tile, 1: both
            forest, n = Forest(len(rid)), np.zeros(len(rid), np.int64)
            for s in range(0, len(left), BLOCK):
                a = left[s : s + BLOCK]
                i, j = np.nonzero(vectors[a] @ vectors[right].T >= threshold)
                i, j = a[i], right[j]
                i, j = (x[rid[i] < rid[j]] for x in (i, j)) if side[0] == 1 else (i, j)
                forest.link(i, j)
                for t in range(0, len(i), 1 << 16):
                    p, q = i[t : t + (1 << 16)], j[t : t + (1 << 16)]
                    first = ~(keys[p] == keys[q]).any(axis=1)
                    np.add.at(n, p[first], times[q[first]])
                    np.add.at(n, q[first], times[p[first]])
            own, root = forest.spanning()
            some = np.flatnonzero(n)
            none = pa.nulls(len(some), pa.int64())
            return pa.record_batch([pa.array(np.concatenate((rid[some], rid[own]))), pa.concat_arrays([none, pa.array(rid[root])]), pa.array(np.concatenate((n[some], np.zeros(len(own), np.int64))))], schema=schema)

        held: pa.Table | None = None
        for b in batches:
            rows = pa.Table.from_batches([b])
            rows = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
            if not rows.num_rows:
                continue
            name = rows.column("work").to_numpy()
            at = np.append(np.flatnonzero(np.append(True, name[1:] != name[:-1])), len(name))
            for s, e in zip(at[:-2].tolist(), at[1:-1].tolist(), strict=True):
                if e - s > 1:
                    yield work(rows.slice(s, e - s))
            held = pa.Table.from_batches(rows.slice(at[-2]).to_batches())
        if held is not None and held.num_rows > 1:
            yield work(held)

    return of


def embedding_links(vectors: DataFrame, threshold: float = 0.93, *, id_col="vec_id", vector_col="embedding", label_col="label") -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors."""
    v = F.col("vector")
    usable = F.col("label").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(vectors[id_col].alias("vec_id"), vectors[label_col].alias("label"), vectors[vector_col].alias("vector"))
    rows = rows.withColumns({"usable": F.coalesce(usable, F.lit(False)), "h1": F.xxhash64(v), "h2": F.xxhash64(F.lit(1), v), "dim": F.size(v)})
    same = ["label", "dim", "h1", "h2"]
    distinct = rows.where("usable").groupBy(*same).agg(F.any_value(v).alias("vector"), F.count("*").alias("times"), F.min("vec_id").alias("least"))
    distinct = written(distinct.withColumn("rid", F.monotonically_increasing_id()), "distinct")
    most = distinct.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    k, tables = table_sizes(most, threshold)
    hashed = written(distinct.select("rid", "label", "dim", "times", "vector", _keys(k, tables).alias("keys")), "hashed")

    cell = ["label", "dim", "table", "key"]
    dealt = hashed.select("rid", "label", "dim", F.posexplode("keys").alias("table", "key"))
    full = dealt.groupBy(*cell).agg(F.count("*").alias("size")).where("size > 1")
    tile_rows = F.greatest(F.lit(1), F.least(F.lit(TILE), F.floor(F.lit(TILE_NUMBERS) / F.col("dim")).cast("int")))
    tiles = F.ceil(F.col("size") / tile_rows)
    tile = F.when(F.col("tiles") > 1, F.pmod(F.xxhash64("rid", "table"), F.col("tiles"))).otherwise(F.lit(0).cast("long"))
    placed = dealt.join(full, cell).withColumn("tiles", tiles).withColumn("tile", tile)
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
    placed = placed.withColumn("other", other)
    place = F.xxhash64(*cell, F.least("tile", "other"), F.greatest("tile", "other"))
    side = F.when(F.col("tile") == F.col("other"), 1).when(F.col("tile") < F.col("other"), 0).otherwise(2)
    work = placed.select("rid", "table", place.alias("work"), side.alias("side")).join(hashed.select("rid", "times", "vector", "keys"), "rid")
    found = work.repartition("work").sortWithinPartitions("work").mapInArrow(_compare(threshold), "u long, v long, n long")
    found = written(found, "found")

    n_links = found.where("v is null").groupBy(F.col("u").alias("rid")).agg(F.sum("n").alias("n"))
    roots = components(found.where("v is not null").select("u", "v"))
    rooted = distinct.join(roots, distinct.rid == roots.node, "left").select("rid", *same, "times", "least", F.coalesce("root", "rid").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = rooted.join(least, "root").join(n_links, "rid", "left").select(*[F.col(c).alias(f"of_{c}") for c in same], "component_id", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"))
    labels = written(labels, "labels")
    on = F.col("usable")
    for c in same:
        on = on & (F.col(c) == F.col(f"of_{c}"))
    both = rows.drop("vector").join(labels, on, "left")
    component = F.when(F.col("usable"), F.col("component_id")).otherwise(F.col("vec_id"))
    return both.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
