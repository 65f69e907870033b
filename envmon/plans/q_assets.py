"""Registered device and resource queries (A2, A2p, A16, W1, R5, A10, A10p, A11, A14, A15, R4)."""

from __future__ import annotations

from ..operators import devices, resources
from .catalog import HA, register, tables

# One row per device of each fact.
PER_DEVICE = """logged AS (
  SELECT device_id, COUNT(*) AS logs, COUNT(*) FILTER (run_status = 'FAULT') AS faults, MAX(collected_at) AS seen
  FROM device_status_logs GROUP BY device_id),
serviced AS (
  SELECT device_id, COUNT(*) AS n, MAX(maintenance_time) AS latest FROM maintenance_records GROUP BY device_id),
placed AS (
  SELECT device_id, device_name, device_type, region_name
  FROM devices LEFT JOIN regions ON install_region_id = region_id)"""


@register("device_fault_maintenance", f"""
WITH {PER_DEVICE}
SELECT region_name, device_id, device_name, faults AS fault_times, COALESCE(serviced.n, 0) AS maintenance_count,
       serviced.latest AS last_maintenance
FROM placed JOIN logged USING (device_id) LEFT JOIN serviced USING (device_id)
WHERE region_name IS NOT NULL AND faults > 0""")
def q_dfm(spark, d):
    return devices.device_fault_maintenance(tables(spark, d))


# The source joins every log with every maintenance record of a device: each count is multiplied by the other's
@register("device_fault_maintenance_parity", """
WITH fan_out AS (
  SELECT device_id, run_status, collected_at, maintenance_id, maintenance_time
  FROM device_status_logs LEFT JOIN maintenance_records USING (device_id)),
counted AS (
  SELECT device_id, COUNT(*) FILTER (run_status = 'FAULT') AS fault_count, COUNT(maintenance_id) AS maintenance_count,
         MAX(maintenance_time) AS last_maintenance_time, MAX(collected_at) AS last_status_update
  FROM fan_out GROUP BY device_id)
SELECT (SELECT region_name FROM regions WHERE region_id = install_region_id) AS region_name, device_name, device_type,
       counted.*
FROM counted JOIN devices USING (device_id)
WHERE fault_count > 0 AND install_region_id IN (SELECT region_id FROM regions)""")
def q_dfm_parity(spark, d):
    return devices.device_fault_maintenance_parity(tables(spark, d))


@register("device_faults", f"""
WITH {PER_DEVICE},
down AS (SELECT device_id, COUNT(*) AS fault_count, MIN(collected_at) AS first_fault_at, MAX(collected_at) AS last_fault_at
         FROM device_status_logs WHERE run_status <> 'NORMAL' GROUP BY device_id)
SELECT * FROM placed JOIN down USING (device_id)""")
def q_device_faults(spark, d):
    return devices.device_faults(tables(spark, d))


@register("latest_device_status", f"""
WITH {PER_DEVICE},
newest AS (SELECT device_id, arg_max(log_id, (collected_at, log_id)) AS log_id FROM device_status_logs GROUP BY device_id)
SELECT region_name, placed.device_id, device_name, device_type, run_status, battery_percent, signal_strength,
       collected_at AS last_status_update
FROM newest JOIN device_status_logs USING (log_id) JOIN placed ON placed.device_id = newest.device_id""")
def q_latest_status(spark, d):
    return devices.latest_device_status(tables(spark, d))


@register("maintenance_due", f"""
WITH {PER_DEVICE},
age AS (SELECT placed.*, latest, DATE '{HA}' - CAST(latest AS DATE) AS days FROM placed LEFT JOIN serviced USING (device_id))
SELECT device_id, device_name, device_type, region_name, latest AS last_maintenance_time,
       days AS days_since_last_maintenance, 'INSPECTION' AS maintenance_type,
       CAST(DATE '{HA}' AS TIMESTAMP) AS maintenance_time,
       concat(device_name, CASE WHEN days IS NULL THEN ' 设备从未维护，需要进行巡检'
                                ELSE concat(' 设备已超过 ', days, ' 天未维护，需要进行巡检') END) AS content,
       'PENDING' AS result
FROM age WHERE days IS NULL OR days > 30""")
def q_maint_due(spark, d):
    return devices.maintenance_due(tables(spark, d), as_of=HA)


# One row per resource of its changes: count, newest, and what they add up to (ADD plus, all else minus).
PER_RESOURCE = """changed AS (
  SELECT resource_id, COUNT(*) AS n, MAX(changed_at) AS latest,
         SUM(COALESCE(change_amount, 0) * IF(change_type = 'ADD', 1, -1)) AS amount,
         SUM(COALESCE(change_area, 0) * IF(change_type = 'ADD', 1, -1)) AS area
  FROM resource_changes GROUP BY resource_id)"""


@register("resource_summary", f"""
WITH {PER_RESOURCE}
SELECT region_name, resource_type, CAST(SUM(COALESCE(quantity, 0)) AS BIGINT) AS current_quantity,
       CAST(SUM(COALESCE(held.area, 0)) AS DECIMAL(38,2)) AS current_area,
       CAST(SUM(COALESCE(n, 0)) AS BIGINT) AS change_records, MAX(latest) AS last_change_time
FROM resources held LEFT JOIN changed USING (resource_id) JOIN regions USING (region_id) GROUP BY ALL""")
def q_res_summary(spark, d):
    return resources.resource_summary(tables(spark, d))


# The source joins a resource with its changes before it sums: quantity and area count once per change.
@register("resource_summary_parity", """
SELECT region_name, resource_type, CAST(SUM(COALESCE(quantity, 0)) AS BIGINT) AS current_quantity,
       CAST(SUM(COALESCE(area, 0)) AS DECIMAL(38,2)) AS current_area, COUNT(change_id) AS change_records,
       MAX(changed_at) AS last_change_time
FROM resources LEFT JOIN resource_changes USING (resource_id) JOIN regions USING (region_id) GROUP BY ALL""")
def q_res_summary_parity(spark, d):
    return resources.resource_summary_parity(tables(spark, d))


@register("resource_net_change", f"""
WITH {PER_RESOURCE}
SELECT region_name, resource_type, species_name, MAX(quantity) AS current_quantity,
       CAST(SUM(COALESCE(n, 0)) AS BIGINT) AS change_count, CAST(SUM(COALESCE(amount, 0)) AS BIGINT) AS net_quantity_change,
       CAST(SUM(COALESCE(changed.area, 0)) AS DECIMAL(38,2)) AS net_area_change, MAX(latest) AS last_change_time
FROM resources LEFT JOIN changed USING (resource_id) JOIN regions USING (region_id) GROUP BY ALL""")
def q_net_change(spark, d):
    return resources.resource_net_change(tables(spark, d))


@register("resource_totals", """
SELECT r.region_name, res.resource_type, res.species_name, res.growth_stage,
       CAST(SUM(COALESCE(res.quantity, 0)) AS BIGINT) AS total_quantity,
       CAST(SUM(COALESCE(res.area, 0)) AS DECIMAL(38,2)) AS total_area
FROM resources res JOIN regions r ON res.region_id = r.region_id
GROUP BY r.region_name, res.resource_type, res.species_name, res.growth_stage""")
def q_res_totals(spark, d):
    return resources.resource_totals(tables(spark, d))


@register("region_resources", """
WITH held AS (SELECT region_id, COUNT(*) AS n, SUM(quantity) AS quantity, SUM(area) AS area FROM resources GROUP BY region_id)
SELECT region_id, region_name, region_type, COALESCE(n, 0) AS resource_count,
       CAST(COALESCE(quantity, 0) AS BIGINT) AS total_quantity, CAST(COALESCE(area, 0) AS DECIMAL(38,2)) AS total_area
FROM regions LEFT JOIN held USING (region_id)""")
def q_region_resources(spark, d):
    return resources.region_resources(tables(spark, d))


CAPTURE_SQL = """
SELECT resource_id, change_type, change_reason, change_amount, change_area FROM (
  SELECT n.resource_id, CASE WHEN n.quantity > o.quantity THEN 'ADD' ELSE 'REDUCE' END AS change_type,
         'Auto record: quantity change' AS change_reason, CAST(ABS(n.quantity - o.quantity) AS INTEGER) AS change_amount,
         CAST(NULL AS DECIMAL(12,2)) AS change_area
  FROM resources o JOIN resources_next n ON o.resource_id = n.resource_id WHERE o.quantity <> n.quantity
  UNION ALL
  SELECT n.resource_id, CASE WHEN n.area > o.area THEN 'ADD' ELSE 'REDUCE' END,
         'Auto record: area change', CAST(NULL AS INTEGER), CAST(ABS(n.area - o.area) AS DECIMAL(12,2))
  FROM resources o JOIN resources_next n ON o.resource_id = n.resource_id WHERE o.area <> n.area
  UNION ALL
  SELECT n.resource_id, 'STATUS_UPDATE',
         'Auto record: growth stage changed from ' || o.growth_stage || ' to ' || n.growth_stage,
         CAST(NULL AS INTEGER), CAST(NULL AS DECIMAL(12,2))
  FROM resources o JOIN resources_next n ON o.resource_id = n.resource_id WHERE o.growth_stage <> n.growth_stage
  UNION ALL
  SELECT n.resource_id, 'ADD', '新增资源记录', n.quantity, n.area
  FROM resources_next n WHERE n.resource_id NOT IN (SELECT resource_id FROM resources)) c"""


@register("capture_resource_changes", CAPTURE_SQL)
def q_capture(spark, d):
    t = tables(spark, d)
    return resources.capture_resource_changes(t["resources"], t["resources_next"]).select(
        "resource_id", "change_type", "change_reason", "change_amount", "change_area")
