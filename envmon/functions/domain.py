"""Domain expressions: validity, anomaly class, air quality, alert type.

Each returns a Column built from built-in functions, so it stays inside
whole-stage code generation wherever it is used.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values of the monitoring rules ----------------------------------
# Validity: TEMPERATURE must lie in [-50, 50], HUMIDITY in [0, 100].
TEMPERATURE_RANGE = (-50, 50)
HUMIDITY_RANGE = (0, 100)
# Alert triggers: TEMPERATURE above 35 -> FIRE, HUMIDITY below 20 -> DROUGHT.
FIRE_ABOVE = 35
DROUGHT_BELOW = 20
# Anomaly classes: above 100 HIGH, below 0 LOW, else OUT_OF_RANGE; threshold 100.
ANOMALY_HIGH_ABOVE = 100
ANOMALY_LOW_BELOW = 0
ANOMALY_THRESHOLD = 100
# Air quality: AQI = int(PM25 * 2); levels at 50, 100, 150, 200, 300.
AQI_LEVELS = [(50, "优"), (100, "良"), (150, "轻度污染"), (200, "中度污染"), (300, "重度污染")]
AQI_TOP_LEVEL = "严重污染"
# Alert listing labels for a missing rule.
UNKNOWN_ALERT_TYPE = "未知类型"
UNKNOWN_SEVERITY = "未知"


def validity_status(reading_type: str = "reading_type", value: str = "numeric_value") -> Column:
    """VALID / INVALID as the insert trigger sets it; NULL values stay VALID."""
    t, v = F.col(reading_type), F.col(value)
    lo_t, hi_t = TEMPERATURE_RANGE
    lo_h, hi_h = HUMIDITY_RANGE
    bad = ((t == "TEMPERATURE") & ((v < lo_t) | (v > hi_t))) | \
          ((t == "HUMIDITY") & ((v < lo_h) | (v > hi_h)))
    return F.when(bad, F.lit("INVALID")).otherwise(F.lit("VALID"))


def anomaly_type(value: str = "numeric_value") -> Column:
    v = F.col(value)
    return (F.when(v > ANOMALY_HIGH_ABOVE, F.lit("HIGH"))
            .when(v < ANOMALY_LOW_BELOW, F.lit("LOW"))
            .otherwise(F.lit("OUT_OF_RANGE")))


def triggered_alert_type(reading_type: str = "reading_type", value: str = "numeric_value") -> Column:
    """FIRE / DROUGHT for a reading that trips a fixed threshold, else NULL."""
    t, v = F.col(reading_type), F.col(value)
    return (F.when((t == "TEMPERATURE") & (v > FIRE_ABOVE), F.lit("FIRE"))
            .when((t == "HUMIDITY") & (v < DROUGHT_BELOW), F.lit("DROUGHT")))


def aqi(pm25: Column) -> Column:
    """Integer part of PM25 * 2 (truncation toward zero, as a Go int cast)."""
    return (pm25 * F.lit(2.0)).cast("int")


def aqi_level(aqi_col: Column) -> Column:
    expr = None
    for bound, label in AQI_LEVELS:
        expr = (F.when(aqi_col < bound, F.lit(label)) if expr is None
                else expr.when(aqi_col < bound, F.lit(label)))
    return expr.otherwise(F.lit(AQI_TOP_LEVEL))
