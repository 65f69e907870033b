"""Fixed seed rows of the rights model and the alert rules.

These are the only inline tables; every other table is read from storage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from envmon.schemas import conform

# --- fixed values: roles in id order (ids 1..5) -----------------------------
ROLE_NAMES = ["SYSTEM_ADMIN", "DATA_ADMIN", "FOREST_GUARD", "PUBLIC_USER", "INSPECTOR"]

# --- fixed values: permissions in id order (ids 1..20): name, resource, action ----
PERMISSIONS = [
    ("view_regions", "regions", "view"),
    ("manage_regions", "regions", "manage"),
    ("view_sensors", "sensors", "view"),
    ("manage_sensors", "sensors", "manage"),
    ("view_alerts", "alerts", "view"),
    ("manage_alerts", "alerts", "manage"),
    ("view_resources", "resources", "view"),
    ("manage_resources", "resources", "manage"),
    ("view_devices", "devices", "view"),
    ("manage_devices", "devices", "manage"),
    ("view_reports", "reports", "view"),
    ("manage_reports", "reports", "manage"),
    ("view_statistics", "statistics", "view"),
    ("manage_statistics", "statistics", "manage"),
    ("view_users", "users", "view"),
    ("manage_users", "users", "manage"),
    ("view_roles", "roles", "view"),
    ("manage_roles", "roles", "manage"),
    ("view_permissions", "permissions", "view"),
    ("manage_permissions", "permissions", "manage"),
]

# --- fixed values: permission ids granted to each role -----------------------
ROLE_GRANTS = {
    1: [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20],
    2: [1, 3, 5, 7, 8, 9, 11, 12, 13, 14, 15, 16, 17, 18, 19],
    3: [1, 3, 5, 7, 8, 9, 11, 13, 15, 17],
    4: [1, 3, 7, 11, 13, 15],
    5: [1, 3, 5, 7, 9, 11, 13, 15, 17, 19],
}

# --- fixed values: alert rules (rule 3 inactive) -----------------------------
ALERT_RULES = [
    (1, "FIRE", "temperature > 35 AND humidity < 20", "SEVERE", True),
    (2, "FIRE", "temperature > 30 AND humidity < 25", "MODERATE", True),
    (3, "DROUGHT", "humidity < 15", "SEVERE", False),
    (4, "DROUGHT", "humidity < 20", "MODERATE", True),
    (5, "PEST", 'other_sensor = "pest_detected"', "GENERAL", True),
    (6, "OTHER", "system_error = true", "CRITICAL", True),
]


# The seed tables are SQL VALUES lists: a local relation whose size the
# optimizer knows, so joins with them are planned as broadcasts.
def roles(spark: SparkSession) -> DataFrame:
    return conform(spark.sql(values_sql("roles")), "roles")


def permissions(spark: SparkSession) -> DataFrame:
    return conform(spark.sql(values_sql("permissions")), "permissions")


def role_permissions(spark: SparkSession) -> DataFrame:
    return conform(spark.sql(values_sql("role_permissions")), "role_permissions")


def alert_rules(spark: SparkSession) -> DataFrame:
    return conform(spark.sql(values_sql("alert_rules")), "alert_rules")


def values_sql(kind: str) -> str:
    """The same seed rows as a SQL VALUES table (for the DuckDB oracle)."""
    if kind == "roles":
        body = ", ".join(f"(CAST({i} AS BIGINT), '{n}')" for i, n in enumerate(ROLE_NAMES, 1))
        return f"SELECT * FROM (VALUES {body}) AS t(role_id, role_name)"
    if kind == "permissions":
        vals = [f"(CAST({i} AS BIGINT), '{name}', '{res}', '{act}')"
                for i, (name, res, act) in enumerate(PERMISSIONS, start=1)]
        return ("SELECT * FROM (VALUES " + ", ".join(vals) +
                ") AS t(permission_id, permission_name, resource, action)")
    if kind == "role_permissions":
        vals = [f"(CAST({r} AS BIGINT), CAST({p} AS BIGINT))"
                for r, perms in ROLE_GRANTS.items() for p in perms]
        return "SELECT * FROM (VALUES " + ", ".join(vals) + ") AS t(role_id, permission_id)"
    if kind == "alert_rules":
        vals = []
        for rid, typ, cond, sev, act in ALERT_RULES:
            c = cond.replace("'", "''")
            vals.append(f"(CAST({rid} AS BIGINT), '{typ}', '{c}', '{sev}', {str(act).upper()})")
        return ("SELECT * FROM (VALUES " + ", ".join(vals) +
                ") AS t(rule_id, alert_type, condition_expr, severity_level, is_active)")
    raise KeyError(kind)
