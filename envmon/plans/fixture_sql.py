"""The fixture projections as SQL text, for the DuckDB oracle.

Same mapping as ``envmon.sources.driver`` (which builds it with the
DataFrame API).  ``with_tables(body)`` puts the projections a query body
names in front of it as WITH clauses, in dependency order.
"""

from __future__ import annotations

import re

from ..sources.driver import LINE_COLUMNS

PROJECTIONS: dict[str, str] = {
    "regions": """
SELECT CAST(n_nationkey AS BIGINT) AS region_id, n_name AS region_name,
       CASE WHEN n_regionkey % 2 = 0 THEN 'FOREST' ELSE 'GRASSLAND' END AS region_type,
       CAST(n_nationkey AS BIGINT) AS manager_id
FROM nation""",
    "sensors": """
SELECT c_custkey AS sensor_id, CAST(c_nationkey % 20 AS BIGINT) AS region_id, c_name AS model,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'TEMPERATURE' WHEN 'MACHINERY' THEN 'HUMIDITY'
                         WHEN 'AUTOMOBILE' THEN 'IMAGE' ELSE 'OTHER' END AS monitor_type,
       CASE WHEN c_acctbal < 0 THEN 'INACTIVE' ELSE 'ACTIVE' END AS status
FROM customer""",
    "raw_readings": """
SELECT event_id AS reading_id, user_id AS sensor_id, ts AS collected_at,
       CASE event_type WHEN 'view' THEN 'TEMPERATURE' WHEN 'click' THEN 'HUMIDITY'
            WHEN 'purchase' THEN 'PM25' WHEN 'signup' THEN 'PM10' ELSE 'CO2' END AS reading_type,
       CAST(CASE WHEN event_type = 'view' THEN value - 60 ELSE value END AS DECIMAL(10,2)) AS numeric_value,
       CASE event_type WHEN 'view' THEN 'C' WHEN 'click' THEN '%' WHEN 'error' THEN 'ppm'
            ELSE 'ug/m3' END AS value_unit
FROM events""",
    "sensor_readings": """
SELECT *, CASE
         WHEN reading_type = 'TEMPERATURE' AND (numeric_value < -50 OR numeric_value > 50) THEN 'INVALID'
         WHEN reading_type = 'HUMIDITY' AND (numeric_value < 0 OR numeric_value > 100) THEN 'INVALID'
         ELSE 'VALID' END AS data_status
FROM raw_readings""",
    "alert_rules": """
SELECT CAST(n_nationkey + 1 AS BIGINT) AS rule_id,
       CASE n_regionkey % 4 WHEN 0 THEN 'FIRE' WHEN 1 THEN 'DROUGHT' WHEN 2 THEN 'PEST' ELSE 'OTHER' END AS alert_type,
       CASE n_nationkey % 3
            WHEN 0 THEN concat('temperature > ', n_nationkey % 10 + 25, ' AND humidity < ', n_nationkey % 7 + 20)
            WHEN 1 THEN concat('humidity < ', n_nationkey % 7 + 20)
            ELSE 'other_sensor = "pest_detected"' END AS condition_expr,
       CASE n_nationkey % 4 WHEN 0 THEN 'SEVERE' WHEN 1 THEN 'MODERATE' WHEN 2 THEN 'GENERAL'
            ELSE 'CRITICAL' END AS severity_level,
       n_nationkey % 5 <> 2 AS is_active
FROM nation""",
    "alerts": """
SELECT o_orderkey AS alert_id, CAST(1 + o_orderkey % 6 AS BIGINT) AS rule_id, CAST(c_nationkey AS BIGINT) AS region_id,
       o_orderdate AS triggered_at, o_orderpriority AS content,
       CASE o_orderstatus WHEN 'P' THEN 'PENDING' WHEN 'O' THEN 'PROCESSING' ELSE 'CLOSED' END AS status,
       CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_custkey END AS handler_id
FROM orders JOIN customer ON o_custkey = c_custkey""",
    "live_alerts": """
SELECT event_id AS alert_id, CAST(1 + event_id % 7 AS BIGINT) AS rule_id, CAST(c_nationkey AS BIGINT) AS region_id,
       ts AS triggered_at, CASE WHEN event_id % 2 = 0 THEN 'PENDING' ELSE 'CLOSED' END AS status
FROM events JOIN customer ON user_id = c_custkey WHERE event_type = 'error'""",
    "lines": f"""
SELECT (l_orderkey * 10 + l_linenumber) * 1000
         + ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {", ".join(LINE_COLUMNS)}) AS line_id,
       l_orderkey, l_partkey AS partkey, l_suppkey AS suppkey, l_quantity AS qty, l_extendedprice AS price,
       l_returnflag AS rflag, l_linestatus AS lstatus, l_shipdate AS shipdate
FROM lineitem""",
    "notifications": """
SELECT line_id AS notification_id, l_orderkey AS alert_id, suppkey AS receiver_id,
       CASE WHEN lstatus = 'O' THEN 'SMS' ELSE 'SYSTEM' END AS channel, shipdate AS sent_at,
       CASE rflag WHEN 'R' THEN 'DELIVERED' WHEN 'A' THEN 'SENT' ELSE 'FAILED' END AS receive_status
FROM lines""",
    "resources": """
SELECT p_partkey AS resource_id, CASE WHEN p_size % 2 = 0 THEN 'TREE' ELSE 'GRASS' END AS resource_type,
       p_partkey % 20 AS region_id, p_name AS species_name,
       CASE WHEN p_size % 2 = 0 THEN p_size END AS quantity,
       CASE WHEN p_size % 2 = 1 THEN CAST(p_retailprice AS DECIMAL(12,2)) END AS area,
       CASE p_size % 3 WHEN 0 THEN 'SEEDLING' WHEN 1 THEN 'GROWING' ELSE 'MATURE' END AS growth_stage
FROM part""",
    "resources_next": """
SELECT resource_id, resource_type, region_id, species_name,
       CASE WHEN resource_id % 5 = 0 THEN quantity + 1 ELSE quantity END AS quantity,
       CAST(CASE WHEN resource_id % 7 = 0 THEN area - 1 ELSE area END AS DECIMAL(12,2)) AS area,
       CASE WHEN resource_id % 11 = 0 THEN
            CASE growth_stage WHEN 'SEEDLING' THEN 'GROWING' WHEN 'GROWING' THEN 'MATURE' ELSE 'SEEDLING' END
            ELSE growth_stage END AS growth_stage
FROM resources
UNION ALL
SELECT g.resource_id, 'TREE', g.resource_id % 20, 'new planting ' || CAST(g.resource_id AS VARCHAR),
       CAST(g.resource_id % 50 AS INTEGER), CAST(NULL AS DECIMAL(12,2)), 'SEEDLING'
FROM (SELECT m.mx + k AS resource_id
      FROM (SELECT MAX(resource_id) AS mx FROM resources) m,
           (SELECT * FROM (VALUES (1),(2),(3),(4),(5),(6),(7),(8),(9),(10)) AS v(k)) ks) g""",
    "resource_changes": """
SELECT line_id AS change_id, partkey AS resource_id,
       CASE rflag WHEN 'A' THEN 'ADD' WHEN 'R' THEN 'REDUCE' ELSE 'STATUS_UPDATE' END AS change_type,
       CASE WHEN rflag <> 'N' THEN CAST(qty AS INT) END AS change_amount,
       CASE WHEN rflag <> 'N' THEN CAST(price AS DECIMAL(12,2)) END AS change_area,
       shipdate AS changed_at, suppkey AS operator_id
FROM lines""",
    "devices": """
SELECT s_suppkey AS device_id, s_name AS device_name,
       CASE s_suppkey % 4 WHEN 0 THEN 'SENSOR' WHEN 1 THEN 'CAMERA' WHEN 2 THEN 'ALERTER' ELSE 'OTHER' END AS device_type,
       CASE WHEN s_suppkey % 10 = 9 THEN NULL ELSE CAST(s_nationkey AS BIGINT) END AS install_region_id
FROM supplier""",
    "device_status_logs": """
SELECT line_id AS log_id, suppkey AS device_id, shipdate AS collected_at,
       CASE rflag WHEN 'N' THEN 'NORMAL' WHEN 'R' THEN 'FAULT' ELSE 'OFFLINE' END AS run_status,
       CASE WHEN lstatus = 'O' THEN CAST(qty AS INT) * 2 END AS battery_percent,
       CAST(qty AS INT) AS signal_strength
FROM lines""",
    "maintenance_records": """
SELECT o_orderkey AS maintenance_id,
       CAST(FLOOR(o_custkey / 15) AS BIGINT)
         + CASE WHEN CAST(FLOOR(o_custkey / 15) AS BIGINT) % 10 = 0 THEN 1 ELSE 0 END AS device_id,
       CASE o_orderstatus WHEN 'P' THEN 'INSPECTION' WHEN 'O' THEN 'REPAIR' ELSE 'REPLACE' END AS maintenance_type,
       o_orderdate AS maintenance_time, o_custkey AS maintainer_id, o_orderpriority AS content
FROM orders""",
    "report_templates": """
SELECT CAST(r_regionkey + 1 AS BIGINT) AS template_id, r_name AS template_name,
       CASE r_regionkey % 3 WHEN 0 THEN 'REGION' WHEN 1 THEN 'TIME' ELSE 'TYPE' END AS dimension,
       CASE r_regionkey % 3 WHEN 0 THEN 'DAY' WHEN 1 THEN 'WEEK' ELSE 'MONTH' END AS cycle,
       r_regionkey <> 3 AS is_active
FROM region""",
    "reports": """
SELECT o_orderkey AS report_id, CAST(1 + o_orderkey % 4 AS BIGINT) AS template_id,
       CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS period, o_orderdate AS generated_at
FROM orders""",
    "users": "SELECT c_custkey AS user_id, c_name AS real_name FROM customer",
    "user_roles": """
SELECT c_custkey AS user_id, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN CAST(1 AS BIGINT)
            WHEN 'BUILDING' THEN CAST(2 AS BIGINT) WHEN 'FURNITURE' THEN CAST(3 AS BIGINT)
            WHEN 'HOUSEHOLD' THEN CAST(4 AS BIGINT) ELSE CAST(5 AS BIGINT) END AS role_id
FROM customer
UNION ALL SELECT c_custkey, CAST(4 AS BIGINT) FROM customer WHERE c_custkey % 3 = 0 AND c_mktsegment <> 'HOUSEHOLD'""",
    "login_events": """
SELECT event_id, user_id, ts, event_type IN ('view', 'purchase') AS success FROM events""",
    "roles": "SELECT CAST(r_regionkey + 1 AS BIGINT) AS role_id, r_name AS role_name FROM region",
    "permissions": """
SELECT CAST(n_nationkey + 1 AS BIGINT) AS permission_id, n_name AS permission_name,
       ['alerts', 'reports', 'sensors', 'regions', 'devices'][n_nationkey % 5 + 1] AS resource,
       ['manage', 'view', 'create', 'update', 'delete'][n_nationkey // 5 + 1] AS action
FROM nation""",
    "role_permissions": """
SELECT CAST(n_regionkey + 1 AS BIGINT) AS role_id, CAST(n_nationkey + 1 AS BIGINT) AS permission_id FROM nation
UNION SELECT CAST(n_nationkey * 2 % 5 + 1 AS BIGINT), CAST(n_nationkey + 1 AS BIGINT) FROM nation""",
}

# Order in which projections may refer to earlier ones.
_ORDER = ["regions", "sensors", "raw_readings", "sensor_readings", "alert_rules", "alerts",
          "live_alerts", "lines", "notifications", "resources", "resources_next",
          "resource_changes", "devices", "device_status_logs", "maintenance_records",
          "report_templates", "reports", "users", "user_roles", "login_events", "roles",
          "permissions", "role_permissions"]

_DEPS = {"sensor_readings": ["raw_readings"], "notifications": ["lines"],
         "resource_changes": ["lines"], "device_status_logs": ["lines"],
         "resources_next": ["resources"]}


def _mentions(body: str, name: str) -> bool:
    return re.search(rf"\b{re.escape(name)}\b", body) is not None


def with_tables(body: str) -> str:
    """Prefix ``body`` with the projections it names (and their inputs)."""
    need: set[str] = set()
    stack = [n for n in _ORDER if _mentions(body, n)]
    while stack:
        n = stack.pop()
        if n in need:
            continue
        need.add(n)
        stack.extend(_DEPS.get(n, []))
    ctes = [f"{n} AS ({PROJECTIONS[n].strip()})" for n in _ORDER if n in need]
    body = body.strip()
    if not ctes:
        return body
    m = re.match(r"(?i)with\s+(recursive\s+)?", body)
    if m:  # merge with the body's own WITH list (keeping RECURSIVE in front)
        head = "WITH RECURSIVE " if m.group(1) else "WITH "
        return head + ",\n".join(ctes) + ",\n" + body[m.end():]
    return "WITH " + ",\n".join(ctes) + "\n" + body
