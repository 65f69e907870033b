"""Registered list, lookup, range and enrichment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import enrich, filters
from ..session import new_path
from ..sources import snapshot
from ..sources.tables import load_tables, save_tables
from .catalog import register, tables


@register("list_regions", """
SELECT region_id, region_name, region_type, manager_id FROM regions
WHERE region_type = 'FOREST' AND region_name ILIKE '%1%'""")
def q_list_regions(spark, d):
    return filters.list_regions(tables(spark, d), "FOREST", "1").select(
        "region_id", "region_name", "region_type", "manager_id")


@register("list_sensors", """
SELECT sensor_id, region_id, model, monitor_type, status FROM sensors
WHERE monitor_type = 'TEMPERATURE' AND status = 'ACTIVE'""")
def q_list_sensors(spark, d):
    return filters.list_sensors(tables(spark, d), monitor_type="TEMPERATURE", status="ACTIVE").select(
        "sensor_id", "region_id", "model", "monitor_type", "status")


@register("list_alert_rules", """
SELECT rule_id, alert_type, condition_expr, severity_level, is_active FROM alert_rules
WHERE is_active""")
def q_list_rules(spark, d):
    return filters.list_alert_rules(tables(spark, d), is_active=True).select(
        "rule_id", "alert_type", "condition_expr", "severity_level", "is_active")


@register("list_resources", """
SELECT resource_id, resource_type, region_id, species_name, quantity, area, growth_stage FROM resources
WHERE resource_type = 'TREE' AND species_name ILIKE '%Ring%'""")
def q_list_resources(spark, d):
    return filters.list_resources(tables(spark, d), resource_type="TREE", species_contains="Ring").select(
        "resource_id", "resource_type", "region_id", "species_name", "quantity", "area", "growth_stage")


@register("list_devices", """
SELECT device_id, device_name, device_type, install_region_id FROM devices WHERE device_type = 'CAMERA'""")
def q_list_devices(spark, d):
    return filters.list_devices(tables(spark, d), device_type="CAMERA").select(
        "device_id", "device_name", "device_type", "install_region_id")


@register("list_report_templates", """
SELECT template_id, template_name, dimension, cycle, is_active FROM report_templates WHERE is_active = TRUE""")
def q_list_templates(spark, d):
    return filters.list_report_templates(tables(spark, d), is_active=True).select(
        "template_id", "template_name", "dimension", "cycle", "is_active")


@register("list_reports", """
SELECT r.report_id, r.template_id, r.period, r.generated_at FROM reports r
JOIN report_templates rt ON r.template_id = rt.template_id WHERE rt.cycle = 'DAY'""")
def q_list_reports(spark, d):
    return filters.list_reports(tables(spark, d), cycle="DAY").select(
        "report_id", "template_id", "period", "generated_at")


@register("list_roles", "SELECT role_id, role_name FROM roles")
def q_list_roles(spark, d):
    return filters.list_roles(tables(spark, d)).select("role_id", "role_name")


# Lookup: the sensors named by readings (found) and reading sensor ids with no sensor row (missing).
@register("lookup_keys", """
SELECT sensor_id, region_id, model, monitor_type, status FROM sensors
WHERE sensor_id IN (SELECT sensor_id FROM sensor_readings)""")
def q_lookup(spark, d):
    t = tables(spark, d)
    found, _ = filters.lookup_keys(t["sensors"], t["sensor_readings"], "sensor_id")
    return found.select("sensor_id", "region_id", "model", "monitor_type", "status")


@register("lookup_missing_keys", """
SELECT DISTINCT sensor_id FROM sensor_readings
WHERE sensor_id NOT IN (SELECT sensor_id FROM sensors)""")
def q_lookup_missing(spark, d):
    t = tables(spark, d)
    _, missing = filters.lookup_keys(t["sensors"], t["sensor_readings"], "sensor_id")
    return missing


@register("readings_in_range", """
SELECT reading_id, sensor_id, collected_at, reading_type, numeric_value, data_status FROM sensor_readings
WHERE collected_at BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00'""")
def q_readings_range(spark, d):
    return filters.readings_in_range(tables(spark, d), "2024-01-10 00:00:00", "2024-01-20 12:00:00").select(
        "reading_id", "sensor_id", "collected_at", "reading_type", "numeric_value", "data_status")


@register("status_logs_in_range", """
SELECT log_id, device_id, collected_at, run_status, battery_percent, signal_strength FROM device_status_logs
WHERE collected_at BETWEEN TIMESTAMP '1998-01-01 00:00:00' AND TIMESTAMP '1998-12-31 00:00:00'""")
def q_logs_range(spark, d):
    return filters.status_logs_in_range(tables(spark, d), "1998-01-01 00:00:00", "1998-12-31 00:00:00")


@register("status_logs_of_device", """
SELECT log_id, device_id, collected_at, run_status, battery_percent, signal_strength FROM device_status_logs
WHERE device_id IN (SELECT device_id FROM devices WHERE device_type = 'SENSOR')""")
def q_logs_device(spark, d):
    t = tables(spark, d)
    ids = t["devices"].filter(F.col("device_type") == "SENSOR").select("device_id")
    return filters.status_logs_of_device(t, ids)


REGION_SENSORS = """
SELECT region_id, region_name, region_type, sensor_id, model, monitor_type, CAST(NULL AS TIMESTAMP) AS install_time,
       status AS sensor_status
FROM sensors RIGHT JOIN regions USING (region_id)"""


@register("region_sensors", REGION_SENSORS)
def q_region_sensors(spark, d):
    return enrich.region_sensors(tables(spark, d))


@register("sensors_by_region_name", """
SELECT s.sensor_id, s.region_id, s.model, s.monitor_type, s.status, r.region_name
FROM sensors s JOIN regions r ON s.region_id = r.region_id WHERE r.region_name = 'NATION_7'""")
def q_sensors_by_name(spark, d):
    return enrich.sensors_by_region_name(tables(spark, d), "NATION_7").select(
        "sensor_id", "region_id", "model", "monitor_type", "status", "region_name")


@register("active_alerts", """
SELECT alert_id, region_name, alert_type, severity_level, triggered_at, content, status,
       (SELECT real_name FROM users WHERE user_id = handler_id) AS handler_name
FROM alerts JOIN regions USING (region_id) JOIN alert_rules USING (rule_id)
WHERE status <> 'CLOSED'""")
def q_active_alerts(spark, d):
    return enrich.active_alerts(tables(spark, d))


@register("resource_change_log", """
WITH held AS (SELECT resource_id, resource_type, species_name, region_name FROM resources JOIN regions USING (region_id))
SELECT held.*, change_id, change_type, CAST(NULL AS VARCHAR) AS change_reason, change_amount, change_area, changed_at,
       (SELECT real_name FROM users WHERE user_id = operator_id) AS operator_name
FROM resource_changes JOIN held USING (resource_id)""")
def q_change_log(spark, d):
    return enrich.resource_change_log(tables(spark, d))


@register("maintenance_log", """
WITH placed AS (SELECT device_id, device_name, device_type, region_name
                FROM devices LEFT JOIN regions ON region_id = install_region_id)
SELECT placed.*, maintenance_id, maintenance_type, maintenance_time, content, CAST(NULL AS VARCHAR) AS result,
       (SELECT real_name FROM users WHERE user_id = maintainer_id) AS maintainer_name
FROM maintenance_records JOIN placed USING (device_id)""")
def q_maint_log(spark, d):
    return enrich.maintenance_log(tables(spark, d))


@register("alert_notifications_detail", """
SELECT n.notification_id, n.alert_id, n.receiver_id, n.channel, n.sent_at, n.receive_status,
       COALESCE(a.content, '') AS alert_content, COALESCE(u.real_name, '') AS receiver_name
FROM notifications n JOIN alerts a ON n.alert_id = a.alert_id JOIN users u ON n.receiver_id = u.user_id""")
def q_notif_detail(spark, d):
    return enrich.alert_notifications_detail(tables(spark, d))


@register("device_timeline", """
SELECT e.device_id, d.device_name, e.event_time, e.event_kind, e.run_status, e.battery_percent,
       e.signal_strength, e.maintenance_id, e.maintenance_type, u.real_name AS maintainer_name,
       e.content, e.result
FROM (SELECT device_id, collected_at AS event_time, 'STATUS' AS event_kind, run_status, battery_percent,
             signal_strength, CAST(NULL AS BIGINT) AS maintenance_id, CAST(NULL AS VARCHAR) AS maintenance_type,
             CAST(NULL AS BIGINT) AS maintainer_id, CAST(NULL AS VARCHAR) AS content,
             CAST(NULL AS VARCHAR) AS result
      FROM device_status_logs
      UNION ALL
      SELECT device_id, maintenance_time, 'MAINTENANCE', NULL, NULL, NULL, maintenance_id, maintenance_type,
             maintainer_id, content, NULL
      FROM maintenance_records) e
JOIN devices d ON e.device_id = d.device_id
LEFT JOIN users u ON e.maintainer_id = u.user_id""")
def q_timeline(spark, d):
    return enrich.device_timeline(tables(spark, d))


# The tables written as a store, opened with their declared types, and read through an operator.
@register("load_tables", REGION_SENSORS)
def q_load_tables(spark, d):
    t = tables(spark, d)
    store = save_tables({n: t[n] for n in ("regions", "sensors")}, new_path(spark, "store"), fmt="csv")
    return enrich.region_sensors(load_tables(spark, store, fmt="csv"))


# A copy of every stored table, restored.
@register("snapshot_restore", "SELECT alert_id, rule_id, region_id, triggered_at, content, status, handler_id FROM alerts")
def q_snapshot(spark, d):
    t = tables(spark, d)
    store = save_tables({n: t[n] for n in ("regions", "alerts")}, new_path(spark, "store"))
    copy = snapshot.snapshot(load_tables(spark, store), new_path(spark, "copies"))
    return snapshot.restore(spark, copy)["alerts"].select(
        "alert_id", "rule_id", "region_id", "triggered_at", "content", "status", "handler_id")
