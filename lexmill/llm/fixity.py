"""WARC: Merkle fixity audit.

Records are framed as WARC and laid into files; a replica is a table (file, offset, length, digest). Its tree has one
node for each range of offsets: the lowest ranges span `SPAN` bytes, each level above `FANOUT` of those below, the root
the whole file. A node's hash covers its records' offsets and digests, or its children's hashes, in order. An audit
compares the roots of two replicas and descends only into ranges whose hashes differ, level by level, until it reads
the records of the lowest ones that differ.

A record takes over a hundred bytes, so a lowest range holds a bounded number of them, and files of any size cost no
task more than that.

Defined cases: null url or html count as empty; a null page id goes to the file -1; repeated rows are records of their
own with equal content, one after the other; a file that a replica lacks differs at its root; empty tables give empty
trees and findings; extra columns are left alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.storage import written

SPAN, FANOUT, FILE_IDS = 1 << 17, 16, 1000


def warc_record(page_id: Column, url: Column, html: Column) -> Column:
    """A WARC/1.1 resource record as text."""
    body = F.coalesce(html, F.lit(""))
    head = ["WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:", F.coalesce(page_id.cast("string"), F.lit("none")), ">\r\nWARC-Target-URI: ", F.coalesce(url, F.lit("")), "\r\nContent-Type: text/html\r\nContent-Length: ", F.octet_length(body).cast("string"), "\r\n\r\n"]
    return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in head], body, F.lit("\r\n\r\n"))


def lay_out(records: DataFrame) -> DataFrame:
    """(file, digest, length, others) -> with offset. A file holds its records in the order of their digests; offsets
    are prefix sums over ranges of digests and inside each range. Equal rows are counted before they are dealt out."""
    same = records.groupBy(*records.columns).agg(F.count("*").alias("times")).withColumn("part", F.substring("digest", 1, 3))
    same = written(same, "records")
    bytes_ = F.col("times") * F.col("length")
    parts = same.groupBy("file", "part").agg(F.sum(bytes_).alias("bytes"))
    parts = parts.withColumn("before", F.sum("bytes").over(Window.partitionBy("file").orderBy("part")) - F.col("bytes")).drop("bytes")
    others = [c for c in records.columns if c not in ("file", "digest")]
    inside = Window.partitionBy("file", "part").orderBy("digest", *others)
    start = F.col("before") + F.sum(bytes_).over(inside) - bytes_
    rows = same.join(parts, ["file", "part"]).withColumn("start", start).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
    return rows.select(*records.columns, (F.col("start") + F.col("k") * F.col("length")).cast("long").alias("offset"))


def _hash_of(at: str, digest: str) -> Column:
    """SHA-256 over place:digest of all rows of a group, in order."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(digest).alias("digest"))))
    return F.sha2(F.array_join(F.transform(parts, lambda p: F.concat_ws(":", p["at"].cast("string"), p["digest"])), ";"), 256)


def tree(replica: DataFrame, levels: int) -> list[DataFrame]:
    """The nodes (file, node, hash) of each level, the lowest first; the last holds the roots, with node 0."""
    low = replica.groupBy("file", F.expr(f"offset div {SPAN}").alias("node")).agg(_hash_of("offset", "digest").alias("hash"))
    out = [written(low, "leaves")]
    for _ in range(levels):
        up = out[-1].groupBy("file", F.expr(f"node div {FANOUT}").alias("up")).agg(_hash_of("node", "hash").alias("hash"))
        out.append(written(up.withColumnRenamed("up", "node"), "nodes"))
    return out


def depth(*replicas: DataFrame) -> int:
    """Levels above the lowest that the largest file needs."""
    last = max((r.agg(F.max("offset")).first()[0] or 0) for r in replicas) // SPAN
    n = 0
    while last:
        last, n = last // FANOUT, n + 1
    return n


def archive_root(levels: list[DataFrame]) -> DataFrame:
    """One row: the hash of the file roots, in 256 groups first, so that one task has few hashes only."""
    part = F.pmod(F.xxhash64("file"), F.lit(256))
    groups = levels[-1].groupBy(part.alias("part")).agg(_hash_of("file", "hash").alias("hash"))
    return groups.agg(_hash_of("part", "hash").alias("root"))


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.join(b.withColumnRenamed("hash", "other"), ["file", "node"], "full")
    return both.where(~F.col("hash").eqNullSafe(F.col("other"))).select("file", "node")


def audit(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """file, offset, length, expected, found, status of each record at which the replicas differ: `corrupt` if both have
    one at the offset, else `missing` or `extra`."""
    n = depth(ours, theirs)
    a, b = tree(ours, n), tree(theirs, n)
    open_ = written(_differing(a[n], b[n]), "open")
    for k in range(n - 1, -1, -1):
        below = [t[k].withColumn("up", F.expr(f"node div {FANOUT}")).join(open_.withColumnRenamed("node", "up"), ["file", "up"], "left_semi").drop("up") for t in (a, b)]
        open_ = written(_differing(*below), "open")
    found = [r.withColumn("node", F.expr(f"offset div {SPAN}")).join(open_, ["file", "node"], "left_semi").select("file", "offset", F.col("length").alias(f"{s}_length"), F.col("digest").alias(s)) for r, s in ((ours, "expected"), (theirs, "found"))]
    both = reduce(lambda x, y: x.join(y, ["file", "offset"], "full"), found).where(~F.col("expected").eqNullSafe(F.col("found")))
    status = F.when(F.col("found").isNull(), "missing").when(F.col("expected").isNull(), "extra").otherwise("corrupt")
    return both.select("file", "offset", F.coalesce("expected_length", "found_length").alias("length"), "expected", "found", status.alias("status"))


def page_archive(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", changed: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Two replicas of pages as WARC files; in the second one `changed` stands for the html."""
    id_, url, html = pages[id_col], pages[url_col], pages[html_col]
    first, second = warc_record(id_, url, html), warc_record(id_, url, html if changed is None else changed)
    file = F.coalesce(F.floor(id_ / FILE_IDS), F.lit(-1)).cast("long")
    rows = pages.select(file.alias("file"), F.sha2(first, 256).alias("digest"), F.octet_length(first).cast("long").alias("length"), F.sha2(second, 256).alias("copy"))
    laid = written(lay_out(rows), "archive")
    return laid.select("file", "offset", "length", "digest"), laid.select("file", "offset", "length", F.col("copy").alias("digest"))
