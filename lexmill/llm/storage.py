"""Tables that cut a lineage: written as Parquet into the folder which driver and executors share."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

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


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder. A lost executor then costs a reread, never the work before it, and
    values that depend on the task (partition ids) are fixed once written."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lexmill-{uuid.uuid4().hex}/{tag}"
    df.write.parquet(path)
    if not _made:
        atexit.register(_remove_all)
    _made.append((spark, path.rsplit("/", 1)[0]))
    return spark.read.schema(df.schema).parquet(path)


def _remove_all() -> None:
    for spark, path in _made:
        try:
            sc = spark.sparkContext
            where = sc._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session is gone; what is left belongs to the folder's owner
            return


def give_back() -> None:
    """In a Python worker, at the end of a task: free memory goes back to the system. Spark keeps workers for later tasks,
    more than an executor has cores, and what each took at its peak would stay beside the JVM through stages without Python."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU library
        return


def column_named(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have yet, for helper columns beside whatever the caller carries."""
    taken, name = {c.lower() for c in df.columns}, f"__{base}"
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
