"""Readings laid out by sensor and time within a day.

A day's readings are sorted into ranges of (sensor, time), so a file, and within it a row group, holds few sensors
and their bounds in the Parquet statistics are narrow: a scan for one sensor skips the files and row groups
whose bounds exclude it.  A sensor with very many readings fills several ranges, parted by time.

:func:`latest_of_sensor` reads a sensor's newest readings from the newest days on, twice as many days each time, until
there are enough; older days are not touched.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import hadoop_path

#: Rows of a Parquet row group and of a file: small enough to be skipped, large enough to be read in one go.
ROW_GROUP_BYTES = 16 << 20
ROWS_PER_FILE = 2_000_000


def write_clustered(readings: DataFrame, path: str, files: int | None = None, rows_per_file: int = ROWS_PER_FILE) -> str:
    """Write ``readings`` below ``path`` by day, each day in ranges of (sensor, time); ``files``: ranges over all days."""
    r = readings.withColumn("collected_date", F.to_date("collected_at"))
    order = ["collected_date", "sensor_id", "collected_at", "reading_id"]
    dealt = r.repartitionByRange(files, *order) if files else r.repartitionByRange(*order)
    (dealt.sortWithinPartitions(*order).write.partitionBy("collected_date").option("maxRecordsPerFile", rows_per_file)
     .option("parquet.block.size", ROW_GROUP_BYTES).parquet(path))
    return path


def days_of(spark: SparkSession, path: str) -> list[_dt.date]:
    """The days stored below ``path``, newest first (folder names only)."""
    fs, p = hadoop_path(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    days = [n.split("=", 1)[1] for n in names if n.startswith("collected_date=")]
    return sorted((_dt.date.fromisoformat(d) for d in days if not d.startswith("__")), reverse=True)


def latest_of_sensor(spark: SparkSession, path: str, sensor_id: int, n: int = 1000) -> DataFrame:
    """A sensor's newest ``n`` readings with their rank, newest first; readings without a time are older than all."""
    days, take = days_of(spark, path), 1
    every = spark.read.parquet(path).where(F.col("sensor_id") == sensor_id)
    order = [F.desc_nulls_last("collected_at"), F.desc("reading_id")]
    while True:
        rows = every.where(F.col("collected_date") >= F.lit(days[take - 1])) if take <= len(days) else every
        top = rows.orderBy(*order).limit(n)
        if take > len(days) or top.count() >= n:
            return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # at most n rows
        take *= 2
