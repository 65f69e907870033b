"""Table schemas, allowed values, keys and foreign keys of the monitoring model.

Schemas are Spark DDL strings, one per table.  Go pointer fields of the
original model are nullable columns; ENUM columns are strings plus an
allowed-value list whose order is the declaration order (MySQL sorts an
ENUM by that position, not by its text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: ENUM lists of the source DDL, in declaration order -------
ENUMS: dict[tuple[str, str], list[str]] = {
    ("regions", "region_type"): ["FOREST", "GRASSLAND"],
    ("sensors", "monitor_type"): ["TEMPERATURE", "HUMIDITY", "IMAGE", "OTHER"],
    ("sensors", "status"): ["ACTIVE", "INACTIVE"],
    # PM25, PM10 and CO2 are accepted as well (the air quality report asks
    # for them although the source ENUM lacks them).
    ("sensor_readings", "reading_type"): ["TEMPERATURE", "HUMIDITY", "IMAGE", "OTHER",
                                          "PM25", "PM10", "CO2"],
    ("sensor_readings", "data_status"): ["VALID", "INVALID"],
    ("alert_rules", "alert_type"): ["FIRE", "DROUGHT", "PEST", "OTHER"],
    ("alert_rules", "severity_level"): ["GENERAL", "MODERATE", "SEVERE", "CRITICAL"],
    ("alerts", "status"): ["PENDING", "PROCESSING", "CLOSED"],
    ("notifications", "channel"): ["SMS", "SYSTEM"],
    ("notifications", "receive_status"): ["SENT", "DELIVERED", "FAILED"],
    ("resources", "resource_type"): ["TREE", "GRASS"],
    ("resources", "growth_stage"): ["SEEDLING", "GROWING", "MATURE"],
    ("resource_changes", "change_type"): ["ADD", "REDUCE", "STATUS_UPDATE"],
    ("devices", "device_type"): ["SENSOR", "CAMERA", "ALERTER", "OTHER"],
    ("device_status_logs", "run_status"): ["NORMAL", "FAULT", "OFFLINE"],
    ("maintenance_records", "maintenance_type"): ["INSPECTION", "REPAIR", "REPLACE"],
    ("report_templates", "dimension"): ["REGION", "TIME", "TYPE"],
    ("report_templates", "cycle"): ["DAY", "WEEK", "MONTH"],
    ("users", "status"): ["ACTIVE", "INACTIVE", "LOCKED"],
}

SCHEMAS: dict[str, str] = {
    "regions": "region_id BIGINT, region_name STRING, region_type STRING, latitude DECIMAL(9,6), "
               "longitude DECIMAL(9,6), manager_id BIGINT, created_at TIMESTAMP_NTZ",
    "sensors": "sensor_id BIGINT, region_id BIGINT, model STRING, monitor_type STRING, "
               "install_time TIMESTAMP_NTZ, protocol STRING, status STRING, created_at TIMESTAMP_NTZ",
    "sensor_readings": "reading_id BIGINT, sensor_id BIGINT, collected_at TIMESTAMP_NTZ, "
                       "reading_type STRING, numeric_value DECIMAL(10,2), value_unit STRING, "
                       "media_path STRING, data_status STRING, created_at TIMESTAMP_NTZ",
    "alert_rules": "rule_id BIGINT, alert_type STRING, condition_expr STRING, severity_level STRING, "
                   "is_active BOOLEAN, created_at TIMESTAMP_NTZ",
    "alerts": "alert_id BIGINT, rule_id BIGINT, region_id BIGINT, triggered_at TIMESTAMP_NTZ, "
              "content STRING, status STRING, handler_id BIGINT, handle_result STRING",
    "notifications": "notification_id BIGINT, alert_id BIGINT, receiver_id BIGINT, channel STRING, "
                     "sent_at TIMESTAMP_NTZ, receive_status STRING",
    "resources": "resource_id BIGINT, resource_type STRING, region_id BIGINT, species_name STRING, "
                 "quantity INT, area DECIMAL(12,2), growth_stage STRING, planted_at DATE, "
                 "operator_id BIGINT, updated_at TIMESTAMP_NTZ",
    "resource_changes": "change_id BIGINT, resource_id BIGINT, change_type STRING, change_reason STRING, "
                        "change_amount INT, change_area DECIMAL(12,2), changed_at TIMESTAMP_NTZ, "
                        "operator_id BIGINT",
    "devices": "device_id BIGINT, device_name STRING, device_type STRING, model_spec STRING, "
               "purchased_at DATE, install_region_id BIGINT, installer_id BIGINT, warranty_until DATE, "
               "created_at TIMESTAMP_NTZ",
    "device_status_logs": "log_id BIGINT, device_id BIGINT, collected_at TIMESTAMP_NTZ, run_status STRING, "
                          "battery_percent INT, signal_strength INT, maintainer_id BIGINT",
    "maintenance_records": "maintenance_id BIGINT, device_id BIGINT, maintenance_type STRING, "
                           "maintenance_time TIMESTAMP_NTZ, maintainer_id BIGINT, content STRING, "
                           "result STRING",
    "report_templates": "template_id BIGINT, template_name STRING, dimension STRING, metrics STRING, "
                        "cycle STRING, is_active BOOLEAN, created_at TIMESTAMP_NTZ",
    "reports": "report_id BIGINT, template_id BIGINT, period STRING, generated_at TIMESTAMP_NTZ, "
               "file_path STRING, data_source STRING",
    "users": "user_id BIGINT, username STRING, password_hash STRING, email STRING, real_name STRING, "
             "phone STRING, status STRING, login_attempts INT, last_login_at TIMESTAMP_NTZ, "
             "locked_until TIMESTAMP_NTZ, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ",
    "roles": "role_id BIGINT, role_name STRING, description STRING, created_at TIMESTAMP_NTZ, "
             "updated_at TIMESTAMP_NTZ",
    "permissions": "permission_id BIGINT, permission_name STRING, resource STRING, action STRING, "
                   "description STRING, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ",
    "user_roles": "user_id BIGINT, role_id BIGINT, created_at TIMESTAMP_NTZ",
    "role_permissions": "role_id BIGINT, permission_id BIGINT, created_at TIMESTAMP_NTZ",
    # Event table form of the login counter (one row per login attempt).
    "login_events": "event_id BIGINT, user_id BIGINT, ts TIMESTAMP_NTZ, success BOOLEAN",
}

# Raw readings are readings before the validity rule sets data_status.
SCHEMAS["raw_readings"] = SCHEMAS["sensor_readings"]
# Alerts of the readings month (same columns as alerts).
SCHEMAS["live_alerts"] = SCHEMAS["alerts"]

PRIMARY_KEYS: dict[str, list[str]] = {
    "regions": ["region_id"], "sensors": ["sensor_id"], "sensor_readings": ["reading_id"],
    "alert_rules": ["rule_id"], "alerts": ["alert_id"], "notifications": ["notification_id"],
    "resources": ["resource_id"], "resource_changes": ["change_id"], "devices": ["device_id"],
    "device_status_logs": ["log_id"], "maintenance_records": ["maintenance_id"],
    "report_templates": ["template_id"], "reports": ["report_id"], "users": ["user_id"],
    "roles": ["role_id"], "permissions": ["permission_id"],
    "user_roles": ["user_id", "role_id"], "role_permissions": ["role_id", "permission_id"],
}

# Unique keys besides the primary key.
UNIQUE_KEYS: dict[str, list[list[str]]] = {
    "regions": [["region_name"]],
    "users": [["username"], ["email"]],
    "roles": [["role_name"]],
    "permissions": [["resource", "action"]],
}

# child table -> list of (fk column, parent table, parent key, on delete)
FOREIGN_KEYS: dict[str, list[tuple[str, str, str, str]]] = {
    "regions": [("manager_id", "users", "user_id", "restrict")],
    "sensors": [("region_id", "regions", "region_id", "restrict")],
    "sensor_readings": [("sensor_id", "sensors", "sensor_id", "restrict")],
    "alerts": [("rule_id", "alert_rules", "rule_id", "restrict"),
               ("region_id", "regions", "region_id", "restrict")],
    "notifications": [("alert_id", "alerts", "alert_id", "restrict")],
    "resources": [("region_id", "regions", "region_id", "restrict"),
                  ("operator_id", "users", "user_id", "restrict")],
    "resource_changes": [("resource_id", "resources", "resource_id", "restrict"),
                         ("operator_id", "users", "user_id", "restrict")],
    "devices": [("install_region_id", "regions", "region_id", "restrict")],
    "device_status_logs": [("device_id", "devices", "device_id", "restrict"),
                           ("maintainer_id", "users", "user_id", "restrict")],
    "maintenance_records": [("device_id", "devices", "device_id", "restrict"),
                            ("maintainer_id", "users", "user_id", "restrict")],
    "reports": [("template_id", "report_templates", "template_id", "restrict")],
    "user_roles": [("user_id", "users", "user_id", "cascade"),
                   ("role_id", "roles", "role_id", "cascade")],
    "role_permissions": [("role_id", "roles", "role_id", "cascade"),
                         ("permission_id", "permissions", "permission_id", "cascade")],
}


def struct_type(table: str) -> T.StructType:
    return T._parse_datatype_string(SCHEMAS[table])


def allowed(table: str, column: str) -> list[str]:
    return ENUMS[(table, column)]


def enum_rank(col: str | Column, table: str, column: str) -> Column:
    """Declaration position of an ENUM value (1-based), for MySQL-like ordering."""
    c = F.col(col) if isinstance(col, str) else col
    values = ENUMS[(table, column)]
    expr = F.when(c.isNull(), F.lit(None).cast("int"))
    for i, v in enumerate(values, start=1):
        expr = expr.when(c == F.lit(v), F.lit(i))
    return expr.otherwise(F.lit(0))


def conform(df: DataFrame, table: str) -> DataFrame:
    """Add every declared column the frame lacks as a typed NULL, in DDL order.

    Columns already present keep their type; extra columns are kept at the end.
    """
    st = struct_type(table)
    have = set(df.columns)
    cols = [F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name)
            for f in st.fields]
    extra = [F.col(c) for c in df.columns if c not in {f.name for f in st.fields}]
    return df.select(*cols, *extra)
