"""Validity of readings (the insert trigger as a column expression)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.domain import validity_status
from ..schemas import conform


def validate_readings(raw: DataFrame) -> DataFrame:
    """Set data_status from type and value, overwriting what the caller sent.

    TEMPERATURE outside [-50, 50] or HUMIDITY outside [0, 100] is INVALID,
    everything else (other types, NULL values) VALID.  Narrow transformation:
    no shuffle, runs inside the scan stage.
    """
    cols = [c for c in raw.columns if c != "data_status"]
    out = raw.select(*cols, validity_status().alias("data_status"))
    return conform(out, "sensor_readings")

