"""Registered rights, report and table-lifecycle queries
(J9-J12, R6, A17, A19-A22, S2-S6, S8, R7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import access, lifecycle, reports, resources
from ..operators._ranges import table
from ..session import new_path
from ..sources.ingest import assign_ids, ingest_readings
from .catalog import HA, REGISTRY, register, tables
from .fixture_sql import with_tables
from .q_assets import CAPTURE_SQL


@register("user_roles", """
SELECT ur.user_id, r.role_id, r.role_name, CAST(NULL AS VARCHAR) AS description
FROM roles r JOIN user_roles ur ON r.role_id = ur.role_id""")
def q_user_roles(spark, d):
    return access.user_roles(tables(spark, d))


@register("role_permissions", """
SELECT rp.role_id, p.permission_id, p.permission_name, p.resource, p.action
FROM permissions p JOIN role_permissions rp ON p.permission_id = rp.permission_id""")
def q_role_perms(spark, d):
    return access.role_permissions(tables(spark, d))


@register("user_permissions", """
SELECT DISTINCT ur.user_id, p.permission_id, p.permission_name, p.resource, p.action
FROM permissions p JOIN role_permissions rp ON p.permission_id = rp.permission_id
JOIN user_roles ur ON rp.role_id = ur.role_id""")
def q_user_perms(spark, d):
    return access.user_permissions(tables(spark, d))


def _requests(t):
    """Two requests per user: manage alerts, view reports."""
    asks = F.array(F.struct(F.lit("alerts").alias("resource"), F.lit("manage").alias("action")),
                   F.struct(F.lit("reports").alias("resource"), F.lit("view").alias("action")))
    return t["users"].select("user_id", F.explode(asks).alias("q")).select("user_id", "q.resource", "q.action")


@register("check_permissions", """
WITH asked AS (SELECT user_id, resource, action FROM users,
               (VALUES ('alerts', 'manage'), ('reports', 'view')) q(resource, action)),
held AS (SELECT DISTINCT user_id, resource, action
         FROM user_roles JOIN role_permissions USING (role_id) JOIN permissions USING (permission_id))
SELECT asked.*, held.user_id IS NOT NULL AS allowed FROM (SELECT DISTINCT * FROM asked) asked
LEFT JOIN held ON held.user_id = asked.user_id AND held.resource = asked.resource AND held.action = asked.action""")
def q_check_perms(spark, d):
    t = tables(spark, d)
    return access.check_permissions(t, _requests(t))


# The lock rule as a recursive query: one step per attempt of each user, in (ts, event_id) order.
# base = failures carried in (0 once a lock has ended); a try before the lock's end is refused.
LOCKOUT_SQL = """
WITH RECURSIVE ev AS (
  SELECT event_id, user_id, ts, COALESCE(success, false) AS success,
         ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id NULLS FIRST, COALESCE(success, false)) AS rn
  FROM login_events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
st(user_id, rn, event_id, ts, success, outcome, failures, locked_until) AS (
  SELECT user_id, rn, event_id, ts, success,
         CASE WHEN success THEN 'SUCCESS' ELSE 'FAILURE' END,
         CASE WHEN success THEN 0 ELSE 1 END,
         CAST(NULL AS TIMESTAMP)
  FROM ev WHERE rn = 1
  UNION ALL
  SELECT e.user_id, e.rn, e.event_id, e.ts, e.success,
         CASE WHEN s.locked_until IS NOT NULL AND e.ts < s.locked_until THEN 'REFUSED'
              WHEN e.success THEN 'SUCCESS'
              WHEN (CASE WHEN s.locked_until IS NOT NULL THEN 0 ELSE s.failures END) + 1 >= 5 THEN 'LOCKED'
              ELSE 'FAILURE' END,
         CASE WHEN s.locked_until IS NOT NULL AND e.ts < s.locked_until THEN s.failures
              WHEN e.success THEN 0
              ELSE (CASE WHEN s.locked_until IS NOT NULL THEN 0 ELSE s.failures END) + 1 END,
         CASE WHEN s.locked_until IS NOT NULL AND e.ts < s.locked_until THEN s.locked_until
              WHEN e.success THEN CAST(NULL AS TIMESTAMP)
              WHEN (CASE WHEN s.locked_until IS NOT NULL THEN 0 ELSE s.failures END) + 1 >= 5
                   THEN e.ts + INTERVAL 1 HOUR
              ELSE CAST(NULL AS TIMESTAMP) END
  FROM st s JOIN ev e ON e.user_id = s.user_id AND e.rn = s.rn + 1)
SELECT event_id, user_id, ts, success, outcome, CAST(failures AS INTEGER) AS failed_attempts, locked_until
FROM st
UNION ALL
SELECT event_id, user_id, ts, COALESCE(success, false), 'UNPLACED', NULL, NULL
FROM login_events WHERE user_id IS NULL OR ts IS NULL"""


@register("login_lockouts", LOCKOUT_SQL)
def q_lockouts(spark, d):
    return access.login_lockouts(tables(spark, d)["login_events"])


@register("report_template_usage", """
WITH made AS (SELECT template_id, COUNT(*) AS n, MAX(generated_at) AS latest FROM reports GROUP BY template_id)
SELECT template_id, template_name, dimension, CAST(NULL AS VARCHAR) AS metrics, cycle, is_active,
       CAST(NULL AS TIMESTAMP) AS created_at, COALESCE(n, 0) AS generated_reports_count, latest AS last_generated_at
FROM report_templates LEFT JOIN made USING (template_id)""")
def q_template_usage(spark, d):
    return reports.report_template_usage(tables(spark, d))


_REGION = f"""
SELECT region_id, region_name, region_type, COALESCE(n, 0) AS sensor_count, '个' AS unit, DATE '{HA}' AS date
FROM regions LEFT JOIN (SELECT region_id, COUNT(*) AS n FROM sensors GROUP BY region_id) owned USING (region_id)"""


@register("report_region", _REGION)
def q_report_region(spark, d):
    return reports.report_region(tables(spark, d), as_of=HA)


def _time_sql(when: str) -> str:
    return f"""
SELECT alert_id, region_name, alert_type, COALESCE(n, 0) AS notification_count, '条' AS unit, triggered_at
FROM alerts LEFT JOIN (SELECT alert_id, COUNT(*) AS n FROM notifications GROUP BY alert_id) sent USING (alert_id)
LEFT JOIN (SELECT region_id, region_name FROM regions) r USING (region_id)
LEFT JOIN (SELECT rule_id, alert_type FROM alert_rules) k USING (rule_id)
WHERE {when}"""


_TIME = _time_sql(f"CAST(triggered_at AS DATE) >= DATE '{HA}' - INTERVAL 30 DAY")


@register("report_time", _TIME)
def q_report_time(spark, d):
    return reports.report_time(tables(spark, d), as_of=HA)


def _type_sql(logs: str, silent: str) -> str:
    """Mean battery per device (no value counts as 0); a device without logs shows ``silent``."""
    return f"""
SELECT device_id, device_name, device_type, COALESCE(charge, {silent}) AS avg_battery, '%' AS unit, DATE '{HA}' AS date
FROM devices LEFT JOIN (
  SELECT device_id, CAST(SUM(COALESCE(battery_percent, 0)) AS DOUBLE) / COUNT(*) AS charge
  FROM {logs} GROUP BY device_id) l USING (device_id)"""


_TYPE = _type_sql("device_status_logs", "0.0")


def _generated_sql(period: str, time_sql: str, type_sql: str) -> str:
    return f"""
WITH made AS (
  SELECT 'REGION' AS dimension, region_id AS id, region_name AS name, region_type AS type,
         CAST(sensor_count AS DOUBLE) AS value, unit, CAST(date AS TIMESTAMP) AS time FROM ({_REGION}) x
  UNION ALL
  SELECT 'TIME', alert_id, region_name, alert_type, CAST(notification_count AS DOUBLE), unit, triggered_at
  FROM ({time_sql}) y
  UNION ALL
  SELECT 'TYPE', device_id, device_name, device_type, avg_battery, unit, CAST(date AS TIMESTAMP) FROM ({type_sql}) z)
SELECT template_id, '{period}' AS period, id, name, type, value, unit, time
FROM made JOIN (SELECT template_id, dimension FROM report_templates WHERE is_active) t USING (dimension)"""


@register("report_type", _TYPE)
def q_report_type(spark, d):
    return reports.report_type(tables(spark, d), as_of=HA)


@register("generate_reports", _generated_sql(HA, _TIME, _TYPE))
def q_generate(spark, d):
    return reports.generate_reports(tables(spark, d), as_of=HA)


_JUNE = "{c} >= TIMESTAMP '2001-06-01 00:00:00' AND {c} < TIMESTAMP '2001-07-01 00:00:00'"


@register("generate_reports_period", _generated_sql(
    "2001-06", _time_sql(_JUNE.format(c="triggered_at")),
    _type_sql(f"(SELECT * FROM device_status_logs WHERE {_JUNE.format(c='collected_at')}) j", "0.0")))
def q_generate_period(spark, d):
    return reports.generate_reports(tables(spark, d), as_of=HA, period="2001-06", restrict_to_period=True)


# The report rows written as text files, one folder per template and period, and read back.
@register("export_report", _generated_sql(HA, _TIME, _TYPE))
def q_export(spark, d):
    made = reports.generate_reports(tables(spark, d), as_of=HA)
    path = reports.export_report(made, new_path(spark, "reports"), fmt="csv")
    back = spark.read.schema("id BIGINT, name STRING, type STRING, value DOUBLE, unit STRING, time TIMESTAMP_NTZ, "
                             "template_id BIGINT, period STRING").option("header", "true").csv(path)
    return back.select("template_id", "period", *reports.REPORT_COLUMNS)


@register("report_registry", f"""
SELECT (SELECT COALESCE(MAX(report_id), 0) + 1 FROM reports) AS report_id,
       (SELECT MIN(template_id) FROM report_templates WHERE cycle = 'DAY') AS template_id,
       strftime(DATE '{HA}' - INTERVAL 1 DAY, '%Y-%m-%d') AS period,
       CAST(DATE '{HA}' AS TIMESTAMP) AS generated_at,
       '/reports/daily_' || strftime(DATE '{HA}' - INTERVAL 1 DAY, '%Y-%m-%d') || '.pdf' AS file_path,
       'Auto generated: Daily environmental monitoring data summary' AS data_source""")
def q_registry(spark, d):
    return reports.daily_report_entry(tables(spark, d), as_of=HA)


@register("ingest_readings", """
SELECT reading_id, sensor_id, collected_at, reading_type, numeric_value, value_unit, data_status,
       CAST(collected_at AS DATE) AS collected_date
FROM sensor_readings""")
def q_ingest(spark, d):
    t = tables(spark, d)
    path = ingest_readings(t["raw_readings"], new_path(spark, "readings"))
    return spark.read.parquet(path).select(
        "reading_id", "sensor_id", "collected_at", "reading_type", "numeric_value", "value_unit",
        "data_status", "collected_date")


@register("assign_ids", f"""
WITH caps AS ({CAPTURE_SQL}),
k AS (SELECT COUNT(*) AS n FROM caps),
m AS (SELECT MAX(change_id) AS mx FROM resource_changes)
SELECT CAST(k.n AS BIGINT) AS n, m.mx + 1 AS first_id, m.mx + k.n AS last_id, CAST(k.n AS BIGINT) AS distinct_ids
FROM k, m""")
def q_assign_ids(spark, d):
    # ids for the change rows captured between two resource versions; the check reads
    # count, range and distinctness of the assigned ids
    t = tables(spark, d)
    caps = resources.capture_resource_changes(t["resources"], t["resources_next"])
    ided = assign_ids(caps, "change_id", base=t["resource_changes"])
    return ided.agg(F.count(F.lit(1)).cast("bigint").alias("n"), F.min("change_id").alias("first_id"),
                    F.max("change_id").alias("last_id"),
                    F.countDistinct("change_id").cast("bigint").alias("distinct_ids"))


_NEXT_COLS = "resource_id, resource_type, region_id, species_name, quantity, area, growth_stage"


_CHANGED = """(SELECT n.resource_id, n.quantity, n.area, n.growth_stage
   FROM resources_next n LEFT JOIN resources o ON n.resource_id = o.resource_id
   WHERE o.resource_id IS NULL OR n.quantity IS DISTINCT FROM o.quantity
      OR n.area IS DISTINCT FROM o.area OR n.growth_stage IS DISTINCT FROM o.growth_stage)"""


@register("upsert_snapshot", f"""
SELECT b.resource_id, b.resource_type, b.region_id, b.species_name,
       CASE WHEN n.resource_id IS NOT NULL THEN n.quantity ELSE b.quantity END AS quantity,
       CASE WHEN n.resource_id IS NOT NULL THEN n.area ELSE b.area END AS area,
       CASE WHEN n.resource_id IS NOT NULL THEN n.growth_stage ELSE b.growth_stage END AS growth_stage
FROM resources b LEFT JOIN {_CHANGED} n ON b.resource_id = n.resource_id""")
def q_upsert(spark, d):
    t = tables(spark, d)
    out, _ = lifecycle.upsert_snapshot(t["resources"].select(*_NEXT_COLS.split(", ")), resource_changes_of(t), "resource_id")
    return out


def resource_changes_of(t):
    """Rows of the next resource version that are new or differ (NULL-safe) from the current one."""
    n = t["resources_next"].select("resource_id", "quantity", "area", "growth_stage")
    o = t["resources"].select("resource_id", F.col("quantity").alias("oq"), F.col("area").alias("oa"),
                              F.col("growth_stage").alias("og"))
    j = n.join(o, "resource_id", "left")
    same = (F.col("quantity").eqNullSafe(F.col("oq")) & F.col("area").eqNullSafe(F.col("oa"))
            & F.col("growth_stage").eqNullSafe(F.col("og")))
    return j.filter(F.col("oq").isNull() & F.col("oa").isNull() & F.col("og").isNull() | ~same).select(
        "resource_id", "quantity", "area", "growth_stage")


@register("upsert_unmatched", """
SELECT resource_id FROM resources_next WHERE resource_id NOT IN (SELECT resource_id FROM resources)""")
def q_upsert_unmatched(spark, d):
    t = tables(spark, d)
    _, unmatched = lifecycle.upsert_snapshot(t["resources"].select(*_NEXT_COLS.split(", ")), resource_changes_of(t),
                                             "resource_id")
    return unmatched


@register("insert_ignore", """
SELECT user_id, role_id FROM user_roles
UNION ALL
SELECT DISTINCT u.user_id, CAST(4 AS BIGINT) FROM users u
WHERE NOT EXISTS (SELECT 1 FROM user_roles ur WHERE ur.user_id = u.user_id AND ur.role_id = 4)""")
def q_insert_ignore(spark, d):
    t = tables(spark, d)
    base = t["user_roles"].select("user_id", "role_id")
    new = t["users"].select("user_id", F.lit(4).cast("bigint").alias("role_id"))
    return lifecycle.insert_ignore(base, new, ["user_id", "role_id"])


def _grassland(t):
    return t["regions"].filter(F.col("region_type") == "GRASSLAND").select("region_id")


_DOOMED = """
WITH dr AS (SELECT region_id FROM regions WHERE region_type = 'GRASSLAND'),
ds AS (SELECT sensor_id FROM sensors WHERE region_id IN (SELECT region_id FROM dr)),
da AS (SELECT alert_id FROM alerts WHERE region_id IN (SELECT region_id FROM dr)),
dres AS (SELECT resource_id FROM resources WHERE region_id IN (SELECT region_id FROM dr)),
dd AS (SELECT device_id FROM devices WHERE install_region_id IN (SELECT region_id FROM dr))
"""


@register("cascade_delete_counts", _DOOMED + """
SELECT 'regions' AS table_name, CAST(COUNT(*) AS BIGINT) AS removed FROM dr
UNION ALL SELECT 'sensors', COUNT(*) FROM ds
UNION ALL SELECT 'alerts', COUNT(*) FROM da
UNION ALL SELECT 'resources', COUNT(*) FROM dres
UNION ALL SELECT 'devices', COUNT(*) FROM dd
UNION ALL SELECT 'sensor_readings', COUNT(*) FROM sensor_readings WHERE sensor_id IN (SELECT sensor_id FROM ds)
UNION ALL SELECT 'notifications', COUNT(*) FROM notifications WHERE alert_id IN (SELECT alert_id FROM da)
UNION ALL SELECT 'resource_changes', COUNT(*) FROM resource_changes WHERE resource_id IN (SELECT resource_id FROM dres)
UNION ALL SELECT 'device_status_logs', COUNT(*) FROM device_status_logs WHERE device_id IN (SELECT device_id FROM dd)
UNION ALL SELECT 'maintenance_records', COUNT(*) FROM maintenance_records WHERE device_id IN (SELECT device_id FROM dd)""")
def q_cascade_counts(spark, d):
    t = tables(spark, d)
    _, counts = lifecycle.cascade_delete(t, "regions", _grassland(t))
    return counts


@register("cascade_delete_readings", _DOOMED + """
SELECT reading_id, sensor_id, collected_at FROM sensor_readings WHERE sensor_id NOT IN (SELECT sensor_id FROM ds)""")
def q_cascade_readings(spark, d):
    t = tables(spark, d)
    rem, _ = lifecycle.cascade_delete(t, "regions", _grassland(t))
    return rem["sensor_readings"].select("reading_id", "sensor_id", "collected_at")


@register("cascade_delete_notifications", _DOOMED + """
SELECT notification_id, alert_id FROM notifications WHERE alert_id NOT IN (SELECT alert_id FROM da)""")
def q_cascade_notifications(spark, d):
    t = tables(spark, d)
    rem, _ = lifecycle.cascade_delete(t, "regions", _grassland(t))
    return rem["notifications"].select("notification_id", "alert_id")


@register("cascade_delete_maintenance", _DOOMED + """
SELECT maintenance_id, device_id FROM maintenance_records WHERE device_id NOT IN (SELECT device_id FROM dd)""")
def q_cascade_maintenance(spark, d):
    t = tables(spark, d)
    rem, _ = lifecycle.cascade_delete(t, "regions", _grassland(t))
    return rem["maintenance_records"].select("maintenance_id", "device_id")


# Columns the fixture projections carry (the constraint checks look at these only).
FIXTURE_COLUMNS = {
    "regions": ["region_id", "region_name", "region_type", "manager_id"],
    "sensors": ["sensor_id", "region_id", "model", "monitor_type", "status"],
    "sensor_readings": ["reading_id", "sensor_id", "collected_at", "reading_type", "numeric_value",
                        "value_unit", "data_status"],
    "alert_rules": ["rule_id", "alert_type", "condition_expr", "severity_level", "is_active"],
    "alerts": ["alert_id", "rule_id", "region_id", "triggered_at", "content", "status", "handler_id"],
    "notifications": ["notification_id", "alert_id", "receiver_id", "channel", "sent_at", "receive_status"],
    "resources": ["resource_id", "resource_type", "region_id", "species_name", "quantity", "area", "growth_stage"],
    "resource_changes": ["change_id", "resource_id", "change_type", "change_amount", "change_area",
                         "changed_at", "operator_id"],
    "devices": ["device_id", "device_name", "device_type", "install_region_id"],
    "device_status_logs": ["log_id", "device_id", "collected_at", "run_status", "battery_percent",
                           "signal_strength"],
    "maintenance_records": ["maintenance_id", "device_id", "maintenance_type", "maintenance_time",
                            "maintainer_id", "content"],
    "report_templates": ["template_id", "template_name", "dimension", "cycle", "is_active"],
    "reports": ["report_id", "template_id", "period", "generated_at"],
    "users": ["user_id", "real_name"],
    "roles": ["role_id", "role_name"],
    "permissions": ["permission_id", "permission_name", "resource", "action"],
    "user_roles": ["user_id", "role_id"],
    "role_permissions": ["role_id", "permission_id"],
}


def _violations_sql() -> str:
    parts = []
    for chk in lifecycle.constraint_checks(FIXTURE_COLUMNS):
        kind, t = chk[0], chk[1]
        if kind.startswith("DUPLICATE"):
            ks = list(chk[2])
            key = " || ',' || ".join(f"CAST({k} AS VARCHAR)" for k in ks)
            nn = " AND ".join(f"{k} IS NOT NULL" for k in ks)
            parts.append(f"SELECT '{t}' AS table_name, '({','.join(ks)})' AS constraint_name, '{kind}' AS kind, "
                         f"{key} AS key_value, CAST(COUNT(*) AS BIGINT) AS n FROM {t} WHERE {nn} "
                         f"GROUP BY {', '.join(ks)} HAVING COUNT(*) > 1")
        elif kind == "ORPHAN":
            fk, pt, pk = chk[2], chk[3], chk[4]
            parts.append(f"SELECT '{t}', '{fk}->{pt}.{pk}', 'ORPHAN', CAST({fk} AS VARCHAR), CAST(COUNT(*) AS BIGINT) "
                         f"FROM {t} WHERE {fk} IS NOT NULL AND {fk} NOT IN (SELECT {pk} FROM {pt} WHERE {pk} IS NOT NULL) "
                         f"GROUP BY {fk}")
        else:
            col, values = chk[2], chk[3]
            lst = ", ".join(f"'{v}'" for v in values)
            parts.append(f"SELECT '{t}', '{col}', 'NOT_ALLOWED', CAST({col} AS VARCHAR), CAST(COUNT(*) AS BIGINT) "
                         f"FROM {t} WHERE {col} IS NOT NULL AND {col} NOT IN ({lst}) GROUP BY {col}")
    return "\nUNION ALL\n".join(parts)


@register("constraint_violations")
def q_violations(spark, d):
    t = tables(spark, d)
    t["lines"] = table(t["lines"], "lines")  # three of the tables are projections of it: numbered once
    return lifecycle.constraint_violations(t, FIXTURE_COLUMNS)


REGISTRY["constraint_violations"] = (q_violations, with_tables(_violations_sql()))
