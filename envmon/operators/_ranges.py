"""Sorted ranges: a global order over a table without a task that sees all of it.

A table is sorted into ranges by some columns and written; what a range must know of the
ranges before or after it is then one small row per range (and key), combined by a window
over those rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..session import new_path


def table(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` as a table in the shared folder: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_ranges(df: DataFrame, name: str, *order: str) -> DataFrame:
    """``df`` as a table sorted into ranges of ``order``, with its range ``part`` and its place ``at`` there."""
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("mid", F.monotonically_increasing_id())
    return table(ordered.select("*", F.shiftright("mid", 33).cast("int").alias("part"),
                                F.col("mid").bitwiseAND((1 << 33) - 1).alias("at")).drop("mid"), name)


def offsets(df: DataFrame, key: str) -> DataFrame:
    """One row per range: the rows before it (``offset``), its first and its last ``key``."""
    sizes = df.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first_key"), F.max(key).alias("last_key"))
    so_far = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    return sizes.select("part", "first_key", "last_key", F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("offset"))


def ranges_before(key: str) -> WindowSpec:
    """Over rows per key and range: the ranges of a key before this one."""
    return Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)


def ranges_after(key: str) -> WindowSpec:
    return Window.partitionBy(key).orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
