"""Registered queries over readings and sensors."""

from __future__ import annotations

from ..operators import quality, stats
from .catalog import RA, register, since_sql, tables

# VALID readings in one row per sensor, day, type and unit; every mean below comes from these sums and counts.
def sensor_days(more: str = "") -> str:
    return f"""days AS (
  SELECT sensor_id, CAST(collected_at AS DATE) AS date, reading_type, value_unit, SUM(numeric_value) AS total,
         COUNT(numeric_value) AS n, COUNT(reading_id) AS ids, COUNT(*) AS readings,
         MAX(numeric_value) AS high, MIN(numeric_value) AS low
  FROM sensor_readings WHERE data_status = 'VALID' {more} GROUP BY ALL),
placed AS (SELECT days.*, region_name, monitor_type FROM days JOIN sensors USING (sensor_id) JOIN regions USING (region_id))"""


_ENV = "AND reading_type IN ('TEMPERATURE', 'HUMIDITY')"
_MEAN = "CAST(SUM(total) AS DOUBLE) / NULLIF(SUM(n), 0)"


def _recent(days: int) -> str:
    return f"AND collected_at >= {since_sql(RA, days)}"


def _mean_of(kind: str) -> str:
    """Mean of one type; no value, no mean."""
    return (f"CAST(SUM(total) FILTER (reading_type = '{kind}') AS DOUBLE) "
            f"/ NULLIF(SUM(n) FILTER (reading_type = '{kind}'), 0)")


@register("validate_readings", """
SELECT reading_id, sensor_id, collected_at, reading_type, numeric_value, value_unit, data_status
FROM sensor_readings""")
def q_validate(spark, d):
    t = tables(spark, d)
    return quality.validate_readings(t["raw_readings"]).select(
        "reading_id", "sensor_id", "collected_at", "reading_type", "numeric_value", "value_unit",
        "data_status")


@register("region_daily_averages", f"""
WITH {sensor_days(_recent(30))}
SELECT date, region_name, reading_type AS metric_type, {_MEAN} AS avg_value, value_unit AS unit,
       CAST(SUM(ids) AS BIGINT) AS sample_count
FROM placed GROUP BY ALL""")
def q_rda(spark, d):
    return stats.region_daily_averages(tables(spark, d), days=30, as_of=RA)


@register("environment_trend", f"""
WITH {sensor_days(_recent(30))}
SELECT date AS time, region_name, reading_type AS metric_type, {_MEAN} AS metric_value, value_unit AS unit
FROM placed GROUP BY ALL""")
def q_trend(spark, d):
    return stats.environment_trend(tables(spark, d), days=30, as_of=RA)


@register("daily_env_avg", f"""
WITH {sensor_days(_ENV)}
SELECT date, region_name, reading_type, {_MEAN} AS avg_value, value_unit, CAST(SUM(readings) AS BIGINT) AS sample_count
FROM placed GROUP BY ALL""")
def q_daily_env_avg(spark, d):
    return stats.daily_env_avg(tables(spark, d))


# One row per sensor of its readings.
_VALIDITY = """
WITH heard AS (
  SELECT sensor_id, COUNT(*) AS total_readings, COUNT(*) FILTER (data_status = 'VALID') AS valid_readings,
         COUNT(*) FILTER (data_status = 'INVALID') AS invalid_readings, MAX(collected_at) AS last_reading_at
  FROM sensor_readings {where} GROUP BY sensor_id)
SELECT heard.*, monitor_type, region_name FROM heard JOIN sensors USING (sensor_id) JOIN regions USING (region_id)"""


@register("sensor_validity", _VALIDITY.format(where=f"WHERE collected_at >= {since_sql(RA, 7)}"))
def q_validity(spark, d):
    return stats.sensor_validity(tables(spark, d), days=7, as_of=RA)


@register("sensor_validity_all", _VALIDITY.format(where=""))
def q_validity_all(spark, d):
    return stats.sensor_validity(tables(spark, d), days=None)


# AQI: twice the mean PM25, cut to a whole number; a type without a value counts as 0.
@register("air_quality", f"""
WITH {sensor_days(_recent(7))},
means AS (SELECT date AS time, region_name, COALESCE({_mean_of('PM25')}, 0) AS pm25, COALESCE({_mean_of('PM10')}, 0) AS pm10,
                 COALESCE({_mean_of('CO2')}, 0) AS co2, COALESCE({_mean_of('TEMPERATURE')}, 0) AS temperature,
                 COALESCE({_mean_of('HUMIDITY')}, 0) AS humidity
          FROM placed GROUP BY ALL),
levels AS (SELECT *, CAST(TRUNC(pm25 * 2) AS INTEGER) AS aqi FROM means)
SELECT *, CASE WHEN aqi < 50 THEN '优' WHEN aqi < 100 THEN '良' WHEN aqi < 150 THEN '轻度污染'
               WHEN aqi < 200 THEN '中度污染' WHEN aqi < 300 THEN '重度污染' ELSE '严重污染' END AS aqi_level
FROM levels""")
def q_air(spark, d):
    return stats.air_quality(tables(spark, d), days=7, as_of=RA)


@register("region_environment_pivot", f"""
WITH {sensor_days(_recent(30))}
SELECT date, region_name, monitor_type, {_mean_of('TEMPERATURE')} AS avg_temperature, {_mean_of('HUMIDITY')} AS avg_humidity,
       {_mean_of('PM25')} AS avg_pm25, {_mean_of('PM10')} AS avg_pm10
FROM placed GROUP BY ALL""")
def q_pivot(spark, d):
    return stats.region_environment_pivot(tables(spark, d), days=30, as_of=RA)


SENSOR_SUMMARY = """
WITH heard AS (
  SELECT sensor_id, COUNT(reading_id) AS ids, COUNT(*) FILTER (data_status = 'VALID') AS good, MAX(collected_at) AS latest,
         SUM(numeric_value) FILTER (data_status = 'VALID') AS total, COUNT(numeric_value) FILTER (data_status = 'VALID') AS n,
         MIN(numeric_value) FILTER (data_status = 'VALID') AS low, MAX(numeric_value) FILTER (data_status = 'VALID') AS high
  FROM sensor_readings GROUP BY sensor_id)
SELECT sensor_id, region_name, monitor_type, COALESCE(ids, 0) AS total_readings, COALESCE(good, 0) AS valid_readings,
       CAST(total AS DOUBLE) / NULLIF(n, 0) AS avg_value, low AS min_value, high AS max_value, latest AS last_reading
FROM sensors JOIN regions USING (region_id) LEFT JOIN heard USING (sensor_id)"""


@register("sensor_data_summary", SENSOR_SUMMARY)
def q_summary(spark, d):
    return stats.sensor_data_summary(tables(spark, d))


@register("monthly_stats", f"""
WITH {sensor_days(_ENV)}
SELECT CAST(MONTH(date) AS INTEGER) AS month, CAST(YEAR(date) AS INTEGER) AS year, region_name, reading_type,
       {_MEAN} AS avg_value, MAX(high) AS max_value, MIN(low) AS min_value, CAST(SUM(readings) AS BIGINT) AS sample_count
FROM placed GROUP BY ALL""")
def q_monthly(spark, d):
    return stats.monthly_stats(tables(spark, d))


@register("trend_analysis", f"""
WITH {sensor_days(_ENV)},
daily AS (SELECT date, region_name, reading_type, {_MEAN} AS avg_value FROM placed GROUP BY ALL),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY region_name, reading_type ORDER BY date) AS nth FROM daily)
SELECT d.date, d.region_name, d.reading_type, d.avg_value, p.avg_value AS prev_avg_value,
       d.avg_value - p.avg_value AS change_value
FROM ranked d LEFT JOIN ranked p
  ON p.region_name = d.region_name AND p.reading_type = d.reading_type AND p.nth = d.nth - 1""")
def q_trend_analysis(spark, d):
    return stats.trend_analysis(tables(spark, d))


@register("anomaly_data", f"""
WITH odd AS (SELECT * FROM sensor_readings WHERE data_status = 'INVALID' AND collected_at >= {since_sql(RA, 7)})
SELECT collected_at AS time, region_name, sensor_id, reading_type, numeric_value AS value, value_unit AS unit,
       IF(numeric_value > 100, 'HIGH', IF(numeric_value < 0, 'LOW', 'OUT_OF_RANGE')) AS anomaly_type, 100 AS threshold
FROM odd JOIN (SELECT sensor_id, region_name FROM sensors JOIN regions USING (region_id)) place USING (sensor_id)""")
def q_anomaly(spark, d):
    return stats.anomaly_data(tables(spark, d), days=7, as_of=RA)


@register("latest_readings", """
SELECT sensor_id, rank, reading_id, collected_at, reading_type, numeric_value, value_unit, data_status
FROM (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY sensor_id
                                        ORDER BY collected_at DESC, reading_id DESC) AS INTEGER) AS rank
      FROM sensor_readings) r
WHERE rank <= 100""")
def q_latest(spark, d):
    return stats.latest_readings(tables(spark, d), n=100)
