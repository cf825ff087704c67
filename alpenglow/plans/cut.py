"""Cutting lineage: intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Paths made by this driver and not dropped since, oldest first.
_made: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a new local folder if the master is local, else an error.

    On a cluster each executor would write to a disk of its own, and rows would be lost.
    """
    context = spark.sparkContext
    path = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="alpenglow-")
        context.setCheckpointDir(path)
    return path.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def written(df: DataFrame, name: str = "cut") -> DataFrame:
    """``df`` as a table of its own: computed once, and what is lost later is read again, not recomputed."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_at = path  # for drop_tables
    return table


def drop(spark: SparkSession, paths: Iterable[str]) -> None:
    """Remove intermediate tables or files that no DataFrame will read again."""
    for path in list(paths):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        if path in _made:
            _made.remove(path)


def drop_tables(*tables: DataFrame) -> None:
    """:func:`drop` the tables that :func:`written` gave."""
    for df in tables:
        drop(df.sparkSession, [df.written_at])


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Drops, at its end, all that was written within; what is still needed must have been written elsewhere or collected."""
    before = set(_made)
    try:
        yield
    finally:
        drop(spark, [p for p in _made if p not in before])
