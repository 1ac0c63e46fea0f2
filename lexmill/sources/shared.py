"""Tables and folders that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only a local session without that setting gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="lexmill-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, removed when the process ends."""
    folder = f"{shared_folder(spark)}/lexmill-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_remove_all)
    _made.append((spark, folder))
    return f"{folder}/{tag}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder. A lost executor then costs a reread, never the work before it, and values that
    depend on the task (partition ids) are fixed once written."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def perhaps_in(rows: DataFrame, key: str, table: DataFrame, bits: int = 24) -> DataFrame:
    """The rows whose key is in the table's column of that name, and a few more: told by bits of hashes, so that a join
    moves few others. The bits are at most 2^(bits - 6) rows, whatever the table's size, which is why they are broadcast."""
    place = F.pmod(F.xxhash64(key), F.lit(1 << bits))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
    masks = table.groupBy(F.shiftright(place, 6).alias("__slot")).agg(F.bit_or(one).alias("__mask"))
    near = rows.join(F.broadcast(masks), F.shiftright(place, 6) == F.col("__slot"))
    return near.where(F.col("__mask").bitwiseAND(one) != 0).drop("__slot", "__mask")


def _remove_all() -> None:
    for spark, path in _made:
        try:
            sc = spark.sparkContext
            where = sc._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session is gone; what is left belongs to the folder's owner
            return
