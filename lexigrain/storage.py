"""Folders and small files on whatever file system Spark reads, scratch folders, and joins with sides of a counted size."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import shared_dir

#: Bytes up to which a side is broadcast. Beyond it the join is left to the planner.
BROADCAST_BYTES = 16 << 20


def _place(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def kind(spark: SparkSession, path: str) -> str | None:
    """'dir', 'file' or None."""
    system, where = _place(spark, path)
    if not system.exists(where):
        return None
    return "dir" if system.getFileStatus(where).isDirectory() else "file"


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none if it doesn't exist."""
    system, where = _place(spark, path)
    return sorted(f.getPath().getName() for f in system.listStatus(where)) if system.exists(where) else []


def delete(spark: SparkSession, path: str) -> None:
    """Remove a file or a folder with all it holds, if it is there."""
    system, where = _place(spark, path)
    system.delete(where, True)


def read_text(spark: SparkSession, path: str) -> str:
    system, where = _place(spark, path)
    stream = system.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A new small file, which appears whole: it is written under another name and renamed."""
    system, where = _place(spark, path)
    if system.exists(where):
        raise FileExistsError(path)
    folder, name = path.rsplit("/", 1)
    _, part = _place(spark, f"{folder}/.{name}-{uuid.uuid4().hex}")
    out = system.create(part, False)
    out.write(bytearray(text.encode()))
    out.close()
    if not system.rename(part, where):
        raise FileExistsError(path)


_scratch: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new name in the shared folder; what is written there is removed when Python ends, or by ``clear``."""
    if not _scratch:
        atexit.register(clear)
    _scratch.append((spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"))
    return _scratch[-1][1]


def clear() -> None:
    """Remove the scratch folders of sessions that still run."""
    while _scratch:
        spark, path = _scratch.pop()
        if spark._sc._jsc is not None:
            delete(spark, path)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a copy in the shared folder; it outlives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def drop_checkpoint(df: DataFrame) -> None:
    """Remove what ``checkpoint`` wrote for this table, which isn't read any more."""
    at = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if at.isDefined():
        delete(df.sparkSession, at.get())


def spread(df: DataFrame) -> DataFrame:
    """Deal a table out anew where it comes in fewer partitions than there are cores, as a small file of one row group does. A
    large table stays in the partitions that it is stored in."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """A checkpointed or cheap table, to be broadcast where its counted rows fit BROADCAST_BYTES, else as the planner likes."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def join_small(left: DataFrame, right: DataFrame, on: Sequence[str], row_bytes: int, how: str = "left") -> DataFrame:
    """Join with a checkpointed ``right`` by ``small``."""
    return left.join(small(right, row_bytes), list(on), how)
