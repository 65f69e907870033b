"""Registered queries over kept layouts: a batch checked against a key index (R7), a sensor's newest readings
from readings laid out by sensor and time (W3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.common import CI_AI
from ..operators import filters, lifecycle
from ..session import new_path
from ..sources import clustered, key_index, versioned
from .catalog import REGISTRY, register, tables
from .q_admin import resource_changes_of

# The batch: error events sent as alerts; some name a rule that does not exist or a status that is not allowed,
# and event ids repeat alert ids.
_BATCH = """batch AS (
  SELECT alert_id, alert_id % 30 + 1 AS rule_id, region_id, IF(alert_id % 50 = 0, 'OPEN', status) AS status FROM live_alerts)"""


@register("batch_violations", f"""
WITH {_BATCH},
every AS (SELECT alert_id FROM alerts UNION ALL SELECT alert_id FROM batch)
SELECT 'alerts' AS table_name, '(alert_id)' AS constraint_name, 'DUPLICATE_KEY' AS kind, CAST(alert_id AS VARCHAR) AS key_value,
       COUNT(*) AS n
FROM every GROUP BY alert_id HAVING COUNT(*) > 1
UNION ALL
SELECT 'alerts', 'rule_id->alert_rules.rule_id', 'ORPHAN', CAST(rule_id AS VARCHAR), COUNT(*)
FROM batch ANTI JOIN alert_rules USING (rule_id) GROUP BY rule_id
UNION ALL
SELECT 'alerts', 'region_id->regions.region_id', 'ORPHAN', CAST(region_id AS VARCHAR), COUNT(*)
FROM batch ANTI JOIN regions USING (region_id) GROUP BY region_id
UNION ALL
SELECT 'alerts', 'status', 'NOT_ALLOWED', status, COUNT(*)
FROM batch WHERE status NOT IN ('PENDING', 'PROCESSING', 'CLOSED') GROUP BY status""")
def q_batch_violations(spark, d):
    t = tables(spark, d)
    indexes = {(name, (key,)): key_index.build_index(t[name], [key], new_path(spark, f"keys-{name}"))
               for name, key in (("alerts", "alert_id"), ("alert_rules", "rule_id"), ("regions", "region_id"))}
    batch = t["live_alerts"].select("alert_id", (F.col("alert_id") % 30 + 1).alias("rule_id"), "region_id",
                                    F.when(F.col("alert_id") % 50 == 0, "OPEN").otherwise(F.col("status")).alias("status"))
    return key_index.batch_violations(batch, "alerts", indexes)


@register("latest_of_busiest_sensor", """
WITH busiest AS (SELECT sensor_id FROM sensor_readings GROUP BY sensor_id ORDER BY COUNT(*) DESC, sensor_id LIMIT 1)
SELECT sensor_id, CAST(ROW_NUMBER() OVER (ORDER BY collected_at DESC, reading_id DESC) AS INTEGER) AS rank, reading_id, collected_at,
       reading_type, numeric_value, value_unit, data_status
FROM sensor_readings JOIN busiest USING (sensor_id) ORDER BY collected_at DESC, reading_id DESC LIMIT 1000""")
def q_latest_clustered(spark, d):
    t = tables(spark, d)
    path = clustered.write_clustered(t["sensor_readings"], new_path(spark, "clustered"))
    kept = spark.read.parquet(path)
    busiest = kept.groupBy("sensor_id").count().orderBy(F.desc("count"), "sensor_id").first()["sensor_id"]
    return clustered.latest_of_sensor(spark, path, busiest, 1000).select(
        "sensor_id", "rank", "reading_id", "collected_at", "reading_type", "numeric_value", "value_unit", "data_status")


# Names under the source's collation: every region name once more in another spelling, every third with an accent.
_SPELLED = """spelled AS (
  SELECT region_id, region_name FROM regions
  UNION ALL
  SELECT region_id + 1000, replace(lower(region_name), 'a', IF(region_id % 3 = 0, 'á', 'a')) FROM regions WHERE region_id % 2 = 0)"""


def _spelled(t):
    r = t["regions"].select("region_id", "region_name")
    accent = F.when(F.col("region_id") % 3 == 0, "á").otherwise("a")
    again = r.where("region_id % 2 = 0").select((F.col("region_id") + 1000).alias("region_id"),
                                                F.replace(F.lower("region_name"), F.lit("a"), accent).alias("region_name"))
    return r.unionByName(again)


@register("names_equal_under_collation", f"""
WITH {_SPELLED}
SELECT 'regions' AS table_name, '(region_name)' AS constraint_name, 'DUPLICATE_UNIQUE' AS kind, MIN(region_name) AS key_value,
       COUNT(*) AS n
FROM spelled GROUP BY strip_accents(lower(region_name)) HAVING COUNT(*) > 1""")
def q_collated_duplicates(spark, d):
    r = _spelled(tables(spark, d))
    return lifecycle.constraint_violations({"regions": r}, {"regions": ["region_id", "region_name"]}, collation=CI_AI)


@register("lookup_names_under_collation", f"""
WITH {_SPELLED}
SELECT region_id, region_name, region_type FROM regions
WHERE strip_accents(lower(region_name)) IN (SELECT strip_accents(lower(region_name)) FROM spelled WHERE region_id >= 1000)""")
def q_collated_lookup(spark, d):
    t = tables(spark, d)
    found, _ = filters.lookup_keys(t["regions"], _spelled(t).where("region_id >= 1000"), "region_name", collation=CI_AI)
    return found.select("region_id", "region_name", "region_type")


# S3 on a stored table: the oracles of upsert_snapshot and upsert_unmatched.
_RESOURCES = "resource_id BIGINT, resource_type STRING, region_id BIGINT, species_name STRING, quantity INT, area DECIMAL(12,2), growth_stage STRING"


def _upserted(spark, d):
    t, path = tables(spark, d), new_path(spark, "resources")
    names = [f.strip().split()[0] for f in _RESOURCES.replace("(12,2)", "").split(",")]
    versioned.create(t["resources"].select(*names), path, ["resource_id"], parts=16)
    unmatched = versioned.upsert(resource_changes_of(t), path, _RESOURCES, ["resource_id"], parts=16)
    return versioned.open_table(spark, path, _RESOURCES), unmatched


REGISTRY["upsert_store"] = (lambda spark, d: _upserted(spark, d)[0], REGISTRY["upsert_snapshot"][1])
REGISTRY["upsert_store_unmatched"] = (lambda spark, d: _upserted(spark, d)[1], REGISTRY["upsert_unmatched"][1])
