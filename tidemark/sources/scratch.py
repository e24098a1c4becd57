"""Intermediate tables in the folder that driver and executors share.

An intermediate that several later jobs read is written once as Parquet and
read back. That cuts lineage, survives the loss of any executor, and is
evaluated exactly once. One whose successors are written is released: its
folder goes at once, so that disk use follows the largest step, not their sum.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table whose files hold at most so many bytes may be broadcast.
BROADCAST_BYTES = 8 << 20
_FOLDERS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only on a local master, where the executors share the driver's disk, may it be unset.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once under the shared folder and returns the table read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _FOLDERS[out] = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes the folders of tables that ``materialize`` returned; nothing may read them any more."""
    for df in tables:
        path = _FOLDERS.pop(df, None)
        if path is not None:
            jvm = df.sparkSession._jvm
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def forget(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files of finished jobs, which it does once nothing refers to them any more."""
    gc.collect()
    spark._jvm.System.gc()


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the files of a table that ``materialize`` returned hold at most ``limit`` bytes."""
    path = _FOLDERS.get(df)
    if path is None:
        raise ValueError("only a materialized table has a known size")
    jvm = df.sparkSession._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).getContentSummary(folder).getLength() <= limit


def sized(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A table that ``materialize`` returned, marked for broadcast if its files are small; larger ones are shuffled."""
    return F.broadcast(df) if small(df, limit) else df
