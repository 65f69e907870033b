"""Kept reading statistics: mergeable partial aggregates per sensor and day, corrected batch by batch.

The store holds, per day, sensor, type, unit and status, the counts, exact sum, extremes and newest time of the readings.
These merge by adding and comparing, so a batch is aggregated once and merged into the days it
touches, late days included; other days are neither read nor written.

The days are the parts of a versioned table (``versioned``): a merge that failed is done again, a batch that
comes again changes nothing, and merges into one store run one after the other.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.common import as_date, mean_of
from ..operators._plan import ordered, rollup_through, sensor_dim
from ..operators._ranges import table
from ..schemas import enum_rank
from . import versioned

Tables = Mapping[str, DataFrame]
KEYS = ["collected_date", "sensor_id", "reading_type", "value_unit", "data_status"]
SCHEMA = ("sensor_id BIGINT, reading_type STRING, value_unit STRING, data_status STRING, ids BIGINT, readings BIGINT, n BIGINT, "
          "total DECIMAL(38,2), low DECIMAL(10,2), high DECIMAL(10,2), latest TIMESTAMP_NTZ, collected_date DATE")
_MERGE = {"ids": F.sum, "readings": F.sum, "n": F.sum, "total": F.sum, "low": F.min, "high": F.max, "latest": F.max}
#: Writers a day may have: a day that holds most of a batch is written by several tasks.
FILES_PER_DAY = 4


def partials(readings: DataFrame) -> DataFrame:
    """The partial aggregates of readings (with their status); a hot sensor is combined map-side."""
    value = F.col("numeric_value").cast("decimal(10,2)")
    return readings.groupBy(F.to_date("collected_at").alias("collected_date"), *KEYS[1:]).agg(
        F.count("reading_id").alias("ids"), F.count(F.lit(1)).alias("readings"), F.count(value).alias("n"),
        F.sum(value).cast("decimal(38,2)").alias("total"), F.min(value).alias("low"), F.max(value).alias("high"),
        F.max("collected_at").alias("latest"))


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """The partial aggregates as of the last merge; day filters prune folders."""
    return versioned.read(spark, path, "collected_date", SCHEMA, versioned.state(spark, path).parts)


def merge_batch(readings: DataFrame, path: str, batch: str) -> list:
    """Merge a batch of readings into the store at ``path``; returns the days it touched ([] for a batch merged before)."""
    spark = readings.sparkSession
    before = versioned.state(spark, path)
    if batch in before.batches:
        return []
    new = table(partials(readings), "summary-batch")
    touched = [r[0] for r in new.select("collected_date").distinct().collect()]  # one row per day
    held = {n: before.parts[n] for n in map(versioned.part_name, touched) if n in before.parts}
    both = versioned.read(spark, path, "collected_date", SCHEMA, held).unionByName(new)
    both = both.groupBy(*KEYS).agg(*[f(c).alias(c) for c, f in _MERGE.items()])
    both = both.withColumn("total", F.col("total").cast("decimal(38,2)"))
    salt = F.pmod(F.xxhash64("sensor_id"), F.lit(FILES_PER_DAY))
    versioned.commit(spark, path, before, both.repartition("collected_date", salt), "collected_date", touched, batch)
    return touched


# -- the statistics, from the store ------------------------------------------
def _valid(summary: DataFrame, days: int | None = None, as_of=None, types: list[str] | None = None) -> DataFrame:
    s = summary.where("data_status = 'VALID'")
    if days is not None:
        s = s.where(F.col("collected_date") >= F.date_sub(as_date(as_of), days))
    return s if types is None else s.where(F.col("reading_type").isin(types))


def region_daily_averages(summary: DataFrame, tables: Tables, days: int = 30, as_of=None, sort: bool = True) -> DataFrame:
    """A5 from the store."""
    agg = rollup_through(_valid(summary, days, as_of), "sensor_id", sensor_dim(tables),
                         [F.col("collected_date").alias("date"), F.col("reading_type").alias("metric_type"), F.col("value_unit").alias("unit")],
                         ["region_name"], [("s", "sum", F.col("total")), ("nv", "sum", F.col("n")), ("sample_count", "sum", F.col("ids"))])
    out = agg.select("date", "region_name", "metric_type", mean_of("s", "nv").alias("avg_value"), "unit",
                     F.col("sample_count").cast("bigint").alias("sample_count"))
    return ordered(out, "date", "region_name", enum_rank("metric_type", "sensor_readings", "reading_type"), "unit", sort=sort)


def environment_trend(summary: DataFrame, tables: Tables, days: int = 30, as_of=None, sort: bool = True) -> DataFrame:
    """A4 from the store."""
    d = region_daily_averages(summary, tables, days, as_of, sort=False).select(
        F.col("date").alias("time"), "region_name", "metric_type", F.col("avg_value").alias("metric_value"), "unit")
    return ordered(d, "time", "region_name", enum_rank("metric_type", "sensor_readings", "reading_type"), "unit", sort=sort)


def monthly_stats(summary: DataFrame, tables: Tables) -> DataFrame:
    """A18 from the store."""
    agg = rollup_through(_valid(summary, types=["TEMPERATURE", "HUMIDITY"]), "sensor_id", sensor_dim(tables),
                         [F.month("collected_date").alias("month"), F.year("collected_date").alias("year"), F.col("reading_type")],
                         ["region_name"], [("s", "sum", F.col("total")), ("nv", "sum", F.col("n")), ("max_value", "max", F.col("high")),
                                           ("min_value", "min", F.col("low")), ("sample_count", "sum", F.col("readings"))])
    return agg.select("month", "year", "region_name", "reading_type", mean_of("s", "nv").alias("avg_value"), "max_value", "min_value",
                      F.col("sample_count").cast("bigint").alias("sample_count"))


def sensor_data_summary(summary: DataFrame, tables: Tables, sort: bool = True) -> DataFrame:
    """A8 from the store."""
    good = lambda c: F.when(F.col("data_status") == "VALID", F.col(c))
    per_sensor = summary.groupBy("sensor_id").agg(
        F.sum("ids").alias("total_readings"), F.sum(good("readings")).alias("valid_readings"), F.sum(good("total")).alias("s"),
        F.sum(good("n")).alias("nv"), F.min(good("low")).alias("min_value"), F.max(good("high")).alias("max_value"),
        F.max("latest").alias("last_reading"))
    out = sensor_dim(tables).join(per_sensor, "sensor_id", "left").select(
        "sensor_id", "region_name", "monitor_type", F.coalesce("total_readings", F.lit(0)).cast("bigint").alias("total_readings"),
        F.coalesce("valid_readings", F.lit(0)).cast("bigint").alias("valid_readings"), mean_of("s", "nv").alias("avg_value"),
        "min_value", "max_value", "last_reading")
    return ordered(out, "sensor_id", sort=sort)
