"""The folder that the driver and all executors share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alpenglow.plans.cut import drop, drop_tables, fresh, scratch, shared_folder, written

__all__ = ["drop", "drop_tables", "exists", "free_name", "fresh", "release", "scratch", "shared_folder", "shuffles_end_with_queries", "top", "written"]


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores after it until no column of ``df`` is called so (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def top(rows: DataFrame, by: str, size: int, *ties: str) -> DataFrame:
    """The ``size`` rows of highest ``by`` (positive numbers), best first; equal ones by ``ties``.

    A histogram of steps of a sixteenth of a power of two, of some thousand rows at most, tells which
    rows can be among them; only these meet in one task.
    """
    kept = written(rows.withColumn("step", F.floor(F.log2(by) * 16)), "counted")
    total, cut = 0, None
    for step, n in sorted(((r[0], r[1]) for r in kept.groupBy("step").count().collect()), reverse=True):
        total, cut = total + n, step
        if total >= size:
            break
    some = kept if cut is None else kept.where(F.col("step") >= cut)
    return some.drop("step").orderBy(F.desc(by), *ties).limit(size)


@contextmanager
def shuffles_end_with_queries(spark: SparkSession) -> Iterator[None]:
    """In here Spark removes a query's shuffle files as soon as it has ended.

    For steps that write or collect each DataFrame once; the setting is as before afterwards.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of steps whose results are written: it does when the driver's garbage is collected."""
    import gc

    gc.collect()
    spark._jvm.System.gc()
