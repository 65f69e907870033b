"""Registered queries: key -> (Spark builder, DuckDB oracle SQL or None).

Each builder takes (spark, sf_dir), maps the benchmark files onto the
monitoring tables (``sources.driver``) and calls one operator with fixed
parameters.  The oracle is the same question in plain SQL over the same
projections (``plans.fixture_sql``).  Column names match one to one.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.driver import HISTORY_AS_OF, READINGS_AS_OF, driver_tables
from .fixture_sql import with_tables

Builder = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Builder, str | None]] = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        REGISTRY[key] = (fn, with_tables(sql) if sql else None)
        return fn
    return deco


def since_sql(as_of: str, days: int) -> str:
    """SQL timestamp literal of midnight ``days`` before ``as_of``."""
    d = dt.date.fromisoformat(as_of) - dt.timedelta(days=days)
    return f"TIMESTAMP '{d.isoformat()} 00:00:00'"


def tables(spark: SparkSession, sf_dir: str):
    """The fixture tables of ``sf_dir`` (lazy; nothing is kept between calls, so a changed folder is read anew)."""
    return driver_tables(spark, sf_dir)


RA = READINGS_AS_OF
HA = HISTORY_AS_OF

# The modules below add their keys to REGISTRY when imported.
from . import q_readings  # noqa: E402,F401
from . import q_lists  # noqa: E402,F401
from . import q_alerts  # noqa: E402,F401
from . import q_assets  # noqa: E402,F401
from . import q_admin  # noqa: E402,F401
from . import q_streams  # noqa: E402,F401
from . import q_summary  # noqa: E402,F401
from . import q_store  # noqa: E402,F401
