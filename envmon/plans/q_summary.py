"""Registered queries over the kept reading statistics: the store is filled batch by batch, days out of order,
and answers what the statistics over all readings answer (the same oracles)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import new_path
from ..sources import summary
from .catalog import RA, REGISTRY, tables


def _kept(spark, d):
    """(summary, tables) after three batches that each hold a part of every day, one of them sent twice."""
    t, path = tables(spark, d), new_path(spark, "summary")
    deal = F.pmod(F.xxhash64("reading_id"), F.lit(3))
    for n in (2, 0, 1, 0):
        summary.merge_batch(t["sensor_readings"].where(deal == n), path, f"batch-{n}")
    return summary.read_summary(spark, path), t


def _like(key: str, name: str, fn):
    """Register ``fn`` under ``name`` with the oracle of ``key``, whose question it answers."""
    REGISTRY[name] = (fn, REGISTRY[key][1])


_like("region_daily_averages", "kept_region_daily_averages", lambda spark, d: summary.region_daily_averages(*_kept(spark, d), days=30, as_of=RA))
_like("environment_trend", "kept_environment_trend", lambda spark, d: summary.environment_trend(*_kept(spark, d), days=30, as_of=RA))
_like("monthly_stats", "kept_monthly_stats", lambda spark, d: summary.monthly_stats(*_kept(spark, d)))
_like("sensor_data_summary", "kept_sensor_data_summary", lambda spark, d: summary.sensor_data_summary(*_kept(spark, d)))
