"""Settings and small helpers of the streams with keyed state."""

from __future__ import annotations

import datetime as _dt
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Setting and value: keyed state with timers needs this state store.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass",
               "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_EPOCH = _dt.datetime(1970, 1, 1)


def time_of(us: int | None) -> _dt.datetime | None:
    """Zone-less time of microseconds since 1970."""
    return None if us is None else _EPOCH + _dt.timedelta(microseconds=us)


def micros_of(t: _dt.datetime | None) -> int | None:
    return None if t is None else (t - _EPOCH) // _dt.timedelta(microseconds=1)


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-less time, whatever the session's zone."""
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("bigint")
    whole = (days * 1440 + F.hour(ts) * 60 + F.minute(ts)) * 60
    return whole * 1_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")


def zoneless(us: Column) -> Column:
    """The zone-less time of microseconds since 1970."""
    seconds = (us.cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)")
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The session with the state store set; a query keeps the settings it starts with."""
    name, store = STATE_STORE
    before = spark.conf.get(name, None)
    spark.conf.set(name, store)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def start_append(out: DataFrame, sink: str, checkpoint: str, available_now: bool) -> StreamingQuery:
    """Append ``out``, a stream with keyed state, to parquet files below ``sink``."""
    w = out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    with state_store(out.sparkSession):
        return w.start(sink)


def read_state(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    """The rows of one state variable, from a stopped stream's checkpoint."""
    return spark.read.format("statestore").option("path", checkpoint).option("operatorId", 0).option("stateVarName", name).load()
