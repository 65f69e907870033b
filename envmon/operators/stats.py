"""Reading statistics: validity, daily averages, trends, air quality, summaries.

All reading aggregates go through ``rollup_through``: readings are never
shuffled raw to meet the sensor dimension.  Averages are an exact decimal
sum divided once by the count (same number in every engine).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import count_if, mean_of, since, since_bound, text_equals, with_day_pruning
from ..functions.domain import (ANOMALY_THRESHOLD, anomaly_type, aqi, aqi_level)
from ..schemas import enum_rank
from ._plan import ordered, rollup_through, sensor_dim

Tables = Mapping[str, DataFrame]


def _readings(tables: Tables, status: str | None = "VALID", days: int | None = None, as_of=None,
              types: list[str] | None = None, metric: str | None = None) -> DataFrame:
    r = tables["sensor_readings"]
    if status is not None:
        r = r.filter(F.col("data_status") == status)
    if days is not None:
        r = with_day_pruning(r.filter(since("collected_at", as_of, days)), "collected_at",
                             lo=since_bound(as_of, days))
    if types is not None:
        r = r.filter(F.col("reading_type").isin(types))
    if metric is not None:
        r = r.filter(F.col("reading_type") == metric)
    return r


def _dim(tables: Tables, region: str | None = None, collation: str | None = None) -> DataFrame:
    d = sensor_dim(tables)
    if region is not None:
        d = d.filter(text_equals("region_name", region, collation))
    return d


# -- A5 / A4 -----------------------------------------------------------------
def region_daily_averages(tables: Tables, days: int = 30, region: str | None = None,
                          metric: str | None = None, as_of=None, sort: bool = True) -> DataFrame:
    """Per day, region, reading type and unit: average of VALID readings and count."""
    r = _readings(tables, "VALID", days, as_of, metric=metric)
    agg = rollup_through(
        r, "sensor_id", _dim(tables, region),
        [F.to_date("collected_at").alias("date"), F.col("reading_type").alias("metric_type"),
         F.col("value_unit").alias("unit")],
        ["region_name"],
        [("s", "sum", F.col("numeric_value")), ("nv", "count", F.col("numeric_value")),
         ("sample_count", "count", F.col("reading_id"))])
    out = agg.select("date", "region_name", "metric_type", mean_of("s", "nv").alias("avg_value"),
                     "unit", F.col("sample_count").cast("bigint").alias("sample_count"))
    return ordered(out, "date", "region_name", _type_rank("metric_type"), "unit", sort=sort)


def _type_rank(col: str):
    """Reading types sort by their declaration position (ENUM order), as in the source."""
    return enum_rank(col, "sensor_readings", "reading_type")


def environment_trend(tables: Tables, days: int = 30, region: str | None = None,
                      metric: str | None = None, as_of=None, sort: bool = True) -> DataFrame:
    """A5 without the count, named as the trend call names it."""
    d = region_daily_averages(tables, days, region, metric, as_of)
    out = d.select(F.col("date").alias("time"), "region_name", "metric_type",
                   F.col("avg_value").alias("metric_value"), "unit")
    return ordered(out, "time", "region_name", _type_rank("metric_type"), "unit", sort=sort)


def _daily_env_sums(tables: Tables, *groups: str) -> DataFrame:
    """Sums and counts of VALID TEMPERATURE and HUMIDITY per day, region, type and ``groups``."""
    r = _readings(tables, "VALID", types=["TEMPERATURE", "HUMIDITY"])
    return rollup_through(
        r, "sensor_id", _dim(tables),
        [F.to_date("collected_at").alias("date"), F.col("reading_type"), *[F.col(g) for g in groups]],
        ["region_name"],
        [("s", "sum", F.col("numeric_value")), ("nv", "count", F.col("numeric_value")),
         ("sample_count", "count", F.lit(1))])


def daily_env_avg(tables: Tables) -> DataFrame:
    """View form of A5: TEMPERATURE and HUMIDITY, all time, reading_type/value_unit names."""
    return _daily_env_sums(tables, "value_unit").select(
        "date", "region_name", "reading_type", mean_of("s", "nv").alias("avg_value"),
        "value_unit", F.col("sample_count").cast("bigint").alias("sample_count"))


# -- A3 ----------------------------------------------------------------------
def sensor_validity(tables: Tables, days: int | None = 7, as_of=None, sort: bool = True) -> DataFrame:
    """Per sensor with readings: total, valid, invalid, last reading (optionally last N days).

    Readings are aggregated per sensor first; the result (one row per sensor)
    meets the sensor and region dimensions.
    """
    r = _readings(tables, None, days, as_of)
    per_sensor = r.groupBy("sensor_id").agg(
        F.count("reading_id").alias("total_readings"),
        count_if(F.col("data_status") == "VALID").alias("valid_readings"),
        count_if(F.col("data_status") == "INVALID").alias("invalid_readings"),
        F.max("collected_at").alias("last_reading_at"))
    d = sensor_dim(tables)
    out = per_sensor.join(d, "sensor_id").select(
        "region_name", "sensor_id", "monitor_type", "total_readings", "valid_readings",
        "invalid_readings", "last_reading_at")
    return ordered(out, F.desc("invalid_readings"), F.desc("last_reading_at"), "sensor_id", sort=sort)


# -- A6 / A7 -----------------------------------------------------------------
_AIR = ["PM25", "PM10", "CO2", "TEMPERATURE", "HUMIDITY"]


def _typed_parts(types):
    parts = []
    for t in types:
        v = F.when(F.col("reading_type") == t, F.col("numeric_value"))
        parts += [(f"s_{t}", "sum", v), (f"n_{t}", "count", v)]
    return parts


def air_quality(tables: Tables, days: int = 7, region: str | None = None, as_of=None, sort: bool = True) -> DataFrame:
    """Per day and region: mean PM25, PM10, CO2, temperature, humidity (missing -> 0), AQI."""
    r = _readings(tables, "VALID", days, as_of)
    agg = rollup_through(r, "sensor_id", _dim(tables, region),
                         [F.to_date("collected_at").alias("time")], ["region_name"], _typed_parts(_AIR))
    cols = {t: F.coalesce(mean_of(f"s_{t}", f"n_{t}"), F.lit(0.0)) for t in _AIR}
    out = agg.select("time", "region_name", cols["PM25"].alias("pm25"), cols["PM10"].alias("pm10"),
                     cols["CO2"].alias("co2"), cols["TEMPERATURE"].alias("temperature"),
                     cols["HUMIDITY"].alias("humidity"))
    out = out.withColumn("aqi", aqi(F.col("pm25"))).withColumn("aqi_level", aqi_level(F.col("aqi")))
    return ordered(out, "time", "region_name", sort=sort)


def region_environment_pivot(tables: Tables, days: int = 30, region: str | None = None,
                             as_of=None, sort: bool = True) -> DataFrame:
    """Per day, region and sensor monitor type: mean temperature, humidity, PM25, PM10 (NULL kept)."""
    r = _readings(tables, "VALID", days, as_of)
    types = ["TEMPERATURE", "HUMIDITY", "PM25", "PM10"]
    agg = rollup_through(r, "sensor_id", _dim(tables, region),
                         [F.to_date("collected_at").alias("date")], ["region_name", "monitor_type"],
                         _typed_parts(types))
    out = agg.select("date", "region_name", "monitor_type",
                     *[mean_of(f"s_{t}", f"n_{t}").alias(f"avg_{t.lower()}") for t in types])
    return ordered(out, "date", "region_name", "monitor_type", sort=sort)


# -- A8 ----------------------------------------------------------------------
def sensor_data_summary(tables: Tables, region: str | None = None,
                        monitor_type: str | None = None, sort: bool = True) -> DataFrame:
    """Every sensor (with a known region): counts and VALID value statistics; no readings -> 0/NULL."""
    r = tables["sensor_readings"]
    valid = F.col("data_status") == "VALID"
    vv = F.when(valid, F.col("numeric_value"))
    per_sensor = r.groupBy("sensor_id").agg(
        F.count("reading_id").alias("total_readings"), count_if(valid).alias("valid_readings"),
        F.sum(vv).alias("s"), F.count(vv).alias("nv"), F.min(vv).alias("min_value"),
        F.max(vv).alias("max_value"), F.max("collected_at").alias("last_reading"))
    d = _dim(tables, region)
    if monitor_type is not None:
        d = d.filter(F.col("monitor_type") == monitor_type)
    out = d.join(per_sensor, "sensor_id", "left").select(
        "sensor_id", "region_name", "monitor_type",
        F.coalesce("total_readings", F.lit(0)).cast("bigint").alias("total_readings"),
        F.coalesce("valid_readings", F.lit(0)).cast("bigint").alias("valid_readings"),
        mean_of("s", "nv").alias("avg_value"), "min_value", "max_value", "last_reading")
    return ordered(out, "sensor_id", sort=sort)


# -- A18 ---------------------------------------------------------------------
def monthly_stats(tables: Tables) -> DataFrame:
    """Per month, year, region, type: mean, max, min and count of VALID temperature/humidity."""
    r = _readings(tables, "VALID", types=["TEMPERATURE", "HUMIDITY"])
    agg = rollup_through(
        r, "sensor_id", _dim(tables),
        [F.month("collected_at").alias("month"), F.year("collected_at").alias("year"),
         F.col("reading_type")],
        ["region_name"],
        [("s", "sum", F.col("numeric_value")), ("nv", "count", F.col("numeric_value")),
         ("max_value", "max", F.col("numeric_value")), ("min_value", "min", F.col("numeric_value")),
         ("sample_count", "count", F.lit(1))])
    return agg.select("month", "year", "region_name", "reading_type",
                      mean_of("s", "nv").alias("avg_value"), "max_value", "min_value",
                      F.col("sample_count").cast("bigint").alias("sample_count"))


# -- W2 ----------------------------------------------------------------------
def trend_analysis(tables: Tables) -> DataFrame:
    """Daily mean per region and type (over all units) with the previous present day's mean and the change.

    The window runs over the aggregated rows (one per day), never over readings.
    """
    d = _daily_env_sums(tables).select("date", "region_name", "reading_type", mean_of("s", "nv").alias("avg_value"))
    w = Window.partitionBy("region_name", "reading_type").orderBy("date")
    prev = F.lag("avg_value").over(w)
    return d.select("date", "region_name", "reading_type", "avg_value",
                    prev.alias("prev_avg_value"), (F.col("avg_value") - prev).alias("change_value"))


# -- P12 ---------------------------------------------------------------------
def anomaly_data(tables: Tables, days: int = 7, region: str | None = None,
                 anomaly: str | None = None, as_of=None, sort: bool = True) -> DataFrame:
    """INVALID readings of the window, classed HIGH / LOW / OUT_OF_RANGE, newest first."""
    r = _readings(tables, "INVALID", days, as_of)
    r = r.select("collected_at", "sensor_id", "reading_type", "numeric_value", "value_unit",
                 anomaly_type().alias("anomaly_type"))
    if anomaly is not None:
        r = r.filter(F.col("anomaly_type") == anomaly)
    d = _dim(tables, region)
    d = d.select("sensor_id", "region_name")
    out = r.join(d, "sensor_id").select(
        F.col("collected_at").alias("time"), "region_name", "sensor_id", "reading_type",
        F.col("numeric_value").alias("value"), F.col("value_unit").alias("unit"), "anomaly_type",
        F.lit(ANOMALY_THRESHOLD).alias("threshold"))
    return ordered(out, F.desc("time"), "sensor_id", sort=sort)


# -- W3 ----------------------------------------------------------------------
def latest_readings(tables: Tables, n: int = 100, sensor_ids=None) -> DataFrame:
    """Newest ``n`` readings of every sensor (or of the given sensors).

    row_number <= n over (sensor, newest first); Spark plans a partial
    per-partition top-n (WindowGroupLimit) before the shuffle, so a sensor
    with very many readings is cut down on the map side.
    """
    r = tables["sensor_readings"]
    cols = ["sensor_id", "rank", "reading_id", "collected_at", "reading_type", "numeric_value", "value_unit",
            "data_status"]
    order = [F.desc("collected_at"), F.desc("reading_id")]
    if sensor_ids is not None:
        ids = list(sensor_ids)
        r = r.filter(F.col("sensor_id").isin(ids))
        if len(ids) == 1:
            # one sensor: a plain top-n (TakeOrderedAndProject keeps n rows per task), then the
            # rank over at most n rows
            top = r.orderBy(*order).limit(n)
            return top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select(*cols)
    w = Window.partitionBy("sensor_id").orderBy(*order)
    out = r.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    return out.select(*cols)

