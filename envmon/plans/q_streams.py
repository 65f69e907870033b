"""Registered streaming queries: each runs its stream to the end of the input
(available-now trigger) into a sink below the shared folder and returns the
sink read back as a batch DataFrame."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import new_path
from ..streaming import keyed, nearby, streams
from .catalog import register
from .q_admin import LOCKOUT_SQL
from .q_assets import CAPTURE_SQL, PER_DEVICE


def _run(spark, start, *args):
    sink, ckpt = new_path(spark, "sink"), new_path(spark, "checkpoint")
    streams.run_to_end(start(*args, sink, ckpt))
    return spark.read.parquet(sink)


@register("stream_validate", """
SELECT reading_id, sensor_id, collected_at, reading_type, numeric_value, value_unit, data_status,
       CAST(collected_at AS DATE) AS collected_date
FROM sensor_readings""")
def q_stream_validate(spark, d):
    t = streams.StreamTables(spark, d)
    out = _run(spark, streams.start_validation, t["raw_readings"])
    return out.select("reading_id", "sensor_id", "collected_at", "reading_type", "numeric_value", "value_unit",
                      "data_status", "collected_date")


@register("stream_alerts", """
SELECT sr.reading_id, ru.rule_id, s.region_id, sr.collected_at AS triggered_at,
       'Region ' || CAST(s.region_id AS VARCHAR) || ' sensor ' || CAST(sr.sensor_id AS VARCHAR)
         || ' triggered alert: ' || CAST(sr.numeric_value AS VARCHAR) || ' matches rule '
         || CAST(ru.rule_id AS VARCHAR) AS content,
       'PENDING' AS status
FROM sensor_readings sr
JOIN sensors s ON sr.sensor_id = s.sensor_id
JOIN (SELECT alert_type, MIN(rule_id) AS rule_id FROM alert_rules WHERE is_active GROUP BY alert_type) ru
  ON ru.alert_type = CASE WHEN sr.reading_type = 'TEMPERATURE' AND sr.numeric_value > 35 THEN 'FIRE'
                          WHEN sr.reading_type = 'HUMIDITY' AND sr.numeric_value < 20 THEN 'DROUGHT' END
WHERE sr.data_status = 'VALID'""")
def q_stream_alerts(spark, d):
    t = streams.StreamTables(spark, d)
    from ..operators.quality import validate_readings
    readings = validate_readings(t["raw_readings"])
    out = _run(spark, streams.start_alerts, readings, t)
    return out.select("reading_id", "rule_id", "region_id", "triggered_at", "content", "status")


@register("stream_alert_windows", """
SELECT time_bucket(INTERVAL '5 minutes', sr.collected_at) AS window_start,
       time_bucket(INTERVAL '5 minutes', sr.collected_at) + INTERVAL 5 MINUTE AS window_end,
       s.region_id, ru.alert_type, CAST(COUNT(*) AS BIGINT) AS alerts
FROM sensor_readings sr
JOIN sensors s ON sr.sensor_id = s.sensor_id
JOIN (SELECT alert_type, MIN(rule_id) AS rule_id FROM alert_rules WHERE is_active GROUP BY alert_type) ru
  ON ru.alert_type = CASE WHEN sr.reading_type = 'TEMPERATURE' AND sr.numeric_value > 35 THEN 'FIRE'
                          WHEN sr.reading_type = 'HUMIDITY' AND sr.numeric_value < 20 THEN 'DROUGHT' END
WHERE sr.data_status = 'VALID'
GROUP BY 1, 2, 3, 4
-- append mode emits a window once the watermark (latest reading - 5 minutes) passes its end
HAVING time_bucket(INTERVAL '5 minutes', sr.collected_at) + INTERVAL 5 MINUTE
       <= (SELECT MAX(collected_at) FROM raw_readings) - INTERVAL 5 MINUTE""")
def q_stream_windows(spark, d):
    t = streams.StreamTables(spark, d)
    from ..operators.quality import validate_readings
    readings = validate_readings(t["raw_readings"])
    return _run(spark, streams.start_alert_windows, readings, t)


@register("stream_lockouts", LOCKOUT_SQL)
def q_stream_lockouts(spark, d):
    t = streams.StreamTables(spark, d)
    sink, ckpt = new_path(spark, "sink"), new_path(spark, "checkpoint")
    streams.run_to_end(streams.start_lockouts(t["login_events"], sink, ckpt))
    streams.finish_lockouts(spark, sink, ckpt)
    return streams.read_lockouts(spark, sink)


# J7 on two streams.  A minute of readings is passed on once the watermark, five minutes behind the slower of the two
# streams, has reached its end; alerts whose readings come in later minutes are still waiting when the input ends.
@register("stream_alerts_invalid_nearby", """
WITH closed AS (
  SELECT date_trunc('minute', collected_at) AS minute, MIN(collected_at) AS first, MAX(collected_at) AS last
  FROM sensor_readings WHERE data_status = 'INVALID' GROUP BY 1),
mark AS (
  SELECT LEAST((SELECT MAX(collected_at) FROM sensor_readings), (SELECT MAX(triggered_at) FROM live_alerts)) - INTERVAL 5 MINUTE AS w)
SELECT alert_id, rule_id, region_id, triggered_at, status
FROM live_alerts a
WHERE EXISTS (SELECT 1 FROM closed, mark WHERE minute + INTERVAL 1 MINUTE <= w
              AND last >= a.triggered_at - INTERVAL 5 MINUTE AND first <= a.triggered_at + INTERVAL 5 MINUTE)""")
def q_stream_nearby(spark, d):
    t = streams.StreamTables(spark, d)
    from ..operators.quality import validate_readings
    alerts = t["live_alerts"].select("alert_id", "rule_id", "region_id", "triggered_at", "status")
    return _run(spark, nearby.start_alerts_near_readings, alerts, validate_readings(t["raw_readings"]), "INVALID")


# R4 on a stream of row versions: the second version of every resource against the state the first one left.
@register("stream_resource_changes", CAPTURE_SQL)
def q_stream_changes(spark, d):
    t = streams.StreamTables(spark, d)
    folder = new_path(spark, "versions")
    for n, name in ((1, "resources"), (2, "resources_next")):
        t[name].select("resource_id", F.lit(n).cast("bigint").alias("version"), "quantity", "area", "growth_stage").write.parquet(f"{folder}/v{n}")
    versions = (spark.readStream.schema(spark.read.parquet(f"{folder}/v1").schema).option("recursiveFileLookup", "true").parquet(folder))
    out = _run(spark, keyed.start_resource_changes, versions)
    return out.where("version = 2").drop("version")


# R5 as timers: the reminders that stand when the watermark has reached the last record's time.
@register("stream_maintenance_due", f"""
WITH {PER_DEVICE},
today AS (SELECT CAST(MAX(maintenance_time) AS DATE) AS d FROM maintenance_records),
age AS (SELECT placed.*, latest, d, d - CAST(latest AS DATE) AS days FROM today, placed LEFT JOIN serviced USING (device_id))
SELECT device_id, device_name, device_type, region_name, latest AS last_maintenance_time,
       days AS days_since_last_maintenance, 'INSPECTION' AS maintenance_type, CAST(d AS TIMESTAMP) AS maintenance_time,
       concat(device_name, CASE WHEN days IS NULL THEN ' 设备从未维护，需要进行巡检'
                                ELSE concat(' 设备已超过 ', days, ' 天未维护，需要进行巡检') END) AS content,
       'PENDING' AS result
FROM age WHERE days IS NULL OR days > 30""")
def q_stream_due(spark, d):
    t = streams.StreamTables(spark, d, streamed=("orders", "supplier"))
    sink, ckpt = new_path(spark, "sink"), new_path(spark, "checkpoint")
    q = keyed.start_maintenance_news(t["devices"], t["maintenance_records"], sink, ckpt)
    streams.run_to_end(q)
    return keyed.devices_due(spark.read.parquet(sink), streams.StreamTables(spark, d, streamed=()), keyed.watermark_date(q))
