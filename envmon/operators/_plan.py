"""Join-and-aggregate building blocks used by the operators.

``rollup_through`` is the one pattern behind most reports: facts are
aggregated to a group that lives on a dimension row (a region, a device
type).  The facts are pre-aggregated per join key first (map-side combine
collapses hot keys), the much smaller result is joined and combined again;
which join that is, Spark decides from the sizes it measures.  Only sum,
count, min and max are used, so this is exact.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_AGG = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
_COMBINE = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}


def rollup_through(fact: DataFrame, key: str, dim: DataFrame,
                   fact_groups: Sequence[Column], dim_groups: Sequence[str],
                   parts: Sequence[tuple[str, str, Column]]) -> DataFrame:
    """Aggregate ``fact`` to (fact_groups + dim_groups) through an inner join on ``key``.

    ``parts``: (output name, "sum"|"count"|"min"|"max", input column).
    """
    proj = fact.select(F.col(key), *fact_groups,
                       *[c.alias(f"__p{i}") for i, (_, _, c) in enumerate(parts)])
    gnames = [c for c in proj.columns if c != key and not c.startswith("__p")]
    dim = dim.select(key, *dim_groups)
    pre = proj.groupBy(key, *gnames).agg(
        *[_AGG[k](F.col(f"__p{i}")).alias(n) for i, (n, k, _) in enumerate(parts)])
    j = pre.join(dim, key)
    return j.groupBy(*gnames, *dim_groups).agg(
        *[_COMBINE[k](F.col(n)).alias(n) for (n, k, _) in parts])


def sensor_dim(tables: Mapping[str, DataFrame]) -> DataFrame:
    """sensor_id -> region_id, region_name, monitor_type (inner: sensors of known regions)."""
    s = tables["sensors"].select("sensor_id", "region_id", "monitor_type")
    r = tables["regions"].select("region_id", "region_name")
    out = s.join(r, "region_id")
    return out


def device_dim(tables: Mapping[str, DataFrame], how: str = "left") -> DataFrame:
    """device_id -> device_name, device_type, region_name (region optional)."""
    d = tables["devices"].select("device_id", "device_name", "device_type", "install_region_id")
    r = tables["regions"].select(F.col("region_id").alias("install_region_id"), "region_name")
    out = d.join(r, "install_region_id", how)
    return out


def ordered(df: DataFrame, *cols, sort: bool = True) -> DataFrame:
    """Final order of a listing (the source's ORDER BY), a range-partitioned sort; the caller may leave it out."""
    return df.orderBy(*cols) if sort else df
