"""Streams that keep one row per key: resource changes (R4) and maintenance reminders.

* R4: row versions of resources come in any order.  The state is a resource's last version; a version newer than it
  gives the change rows between the two, by the batch operator's own expressions.  Repeats and older versions
  give nothing.  Nothing is joined with a full table.  Resources share state keys, a fixed number of buckets by the hash of
  their ids: a call into Python and its state costs milliseconds, a row in it microseconds.  A batch rewrites the buckets that it touches.
* R5: the state is a device's last maintenance.  An event-time timer stands at the midnight that follows
  the allowed number of calendar days; each record moves it.  When it goes off the device
  is due, a device without a record is due at once, and a record that makes it no longer due says so.

A key's state is read and written once per micro-batch in which it has rows or a timer goes off.
"""

from __future__ import annotations

import datetime as _dt
import json
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from ..functions.common import as_date
from ..operators._plan import device_dim
from ..operators.devices import MAINTENANCE_DUE_DAYS, reminders
from ..operators.resources import NEW_RESOURCE_REASON, change_entries
from ._state import micros, start_append, time_of

# -- R4 ----------------------------------------------------------------------
_PAIR = ("resource_id BIGINT, version BIGINT, added BOOLEAN, oq INT, oa STRING, os STRING, nq INT, na STRING, ns STRING")
AREA = "decimal(12,2)"
#: State keys that all resources share.  A checkpoint goes on only with the number it was begun with.
BUCKETS = 1 << 12


def _plain(x):
    return None if pd.isna(x) else x


class LastVersions(StatefulProcessor):
    """Pairs of successive versions of a bucket's resources; areas travel as text, exactly."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        # JSON rows of resource, version, quantity, area, stage
        self.held = handle.getValueState("held", "versions STRING")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new: dict[int, dict[int, tuple]] = {}
        for pdf in rows:
            for r, v, q, a, s in zip(pdf["resource_id"], pdf["version"], pdf["quantity"], pdf["area"], pdf["growth_stage"]):
                row, of = (None if pd.isna(q) else int(q), _plain(a), _plain(s)), new.setdefault(int(r), {})
                # of rows that repeat a version the smallest values count
                of[int(v)] = min(of.get(int(v), row), row, key=lambda r: tuple((x is None, str(x)) for x in r))
        held, out = self.held.get(), []
        last = {r: tuple(row) for r, *row in json.loads(held[0])} if held is not None else {}
        for resource, versions in new.items():
            before = last.get(resource)
            for version in sorted(versions):
                if before is not None and version <= before[0]:
                    continue
                old = before[1:] if before is not None else (None, None, None)
                out.append((resource, version, before is None, *old, *versions[version]))
                before = (version, *versions[version])
            last[resource] = before
        if out:
            self.held.update((json.dumps([(r, *row) for r, row in last.items()]),))
            f = pd.DataFrame(out, columns=["resource_id", "version", "added", "oq", "oa", "os", "nq", "na", "ns"])
            yield f.astype({"oq": "Int32", "nq": "Int32"})

    def close(self) -> None:
        pass


def resource_change_stream(versions: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Change rows of a stream of (resource_id, version, quantity, area, growth_stage).

    The first version of a resource gives the ADD row of a new resource.  Rows without a resource or a version are left out.
    """
    v = versions.where("resource_id IS NOT NULL AND version IS NOT NULL").select(
        F.col("resource_id").cast("bigint").alias("resource_id"), F.col("version").cast("bigint").alias("version"),
        F.col("quantity").cast("int").alias("quantity"), F.col("area").cast(AREA).cast("string").alias("area"), "growth_stage")
    v = v.withColumn("bucket", F.pmod(F.xxhash64("resource_id"), F.lit(buckets)))
    pairs = v.groupBy("bucket").transformWithStateInPandas(
        LastVersions(), StructType.fromDDL(_PAIR), outputMode="Append", timeMode="None")
    pairs = pairs.withColumns({"oa": F.col("oa").cast(AREA), "na": F.col("na").cast(AREA)})
    first = F.array(F.struct(F.lit("ADD").alias("change_type"), F.lit(NEW_RESOURCE_REASON).alias("change_reason"),
                             F.col("nq").alias("change_amount"), F.col("na").alias("change_area"), F.lit(0).alias("seq")))
    rows = pairs.select("resource_id", "version", F.explode(F.when(F.col("added"), first).otherwise(change_entries())).alias("e"))
    return rows.select("resource_id", "version", "e.change_type", "e.change_reason", "e.change_amount", "e.change_area")


def start_resource_changes(versions: DataFrame, sink: str, checkpoint: str, available_now: bool = True, buckets: int = BUCKETS) -> StreamingQuery:
    return start_append(resource_change_stream(versions, buckets), sink, checkpoint, available_now)


# -- R5 ----------------------------------------------------------------------
DUE, DONE = "DUE", "DONE"
_NEWS = "device_id BIGINT, nth BIGINT, news STRING, last_maintenance_time TIMESTAMP_NTZ"
_DAY_MS = 86_400_000


class MaintenanceTimer(StatefulProcessor):
    def __init__(self, days: int):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.device = handle.getValueState("device", "last LONG, told STRING, told_last LONG, nth LONG, wake LONG")

    def _turn(self, device: int, last: int | None, state: tuple, now_ms: int, woken: bool) -> Iterator[pd.DataFrame]:
        """Say what is new about a device, and set its timer."""
        _, told, told_last, nth, wake = state
        # midnight after ``days`` whole calendar days; the watermark has to be there
        due_ms = None if last is None else (last // 1000 // _DAY_MS + self.days + 1) * _DAY_MS
        due = due_ms is None or due_ms <= now_ms
        news = DUE if due and (told != DUE or told_last != last) else DONE if not due and told == DUE else None
        set_to, wake = None if due else due_ms - 1, None if woken else wake  # a timer goes off behind its time
        if wake != set_to:
            if wake is not None:
                self.handle.deleteTimer(wake)
            if set_to is not None:
                self.handle.registerTimer(set_to)
        if news is not None:
            nth, told, told_last = nth + 1, news, last
            yield pd.DataFrame({"device_id": [device], "nth": [nth], "news": [news],
                                "last_maintenance_time": pd.to_datetime([time_of(last)])})
        self.device.update((last, told, told_last, nth, set_to))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = self.device.get() or (None, None, None, 0, None)
        times = [int(t) for pdf in rows for t in pdf["ts"] if not pd.isna(t)]
        last = max([t for t in (state[0], *times) if t is not None], default=None)
        yield from self._turn(key[0], last, state, timerValues.getCurrentWatermarkInMs(), False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self.device.get()
        yield from self._turn(key[0], state[0], state, timerValues.getCurrentWatermarkInMs(), True)

    def close(self) -> None:
        pass


def maintenance_news(devices: DataFrame, records: DataFrame, days: int = MAINTENANCE_DUE_DAYS, lateness: str = "0 seconds") -> DataFrame:
    """News (DUE, DONE) of devices, numbered per device, of a stream of devices and one of maintenance records.

    A record counts whenever it comes: only the newest of a device decides.
    """
    none = F.lit(None).cast("timestamp_ntz")
    e = records.select(F.col("device_id").cast("bigint").alias("device_id"), F.col("maintenance_time").cast("timestamp_ntz").alias("at"))
    e = e.unionByName(devices.select(F.col("device_id").cast("bigint").alias("device_id"), none.alias("at"))).where("device_id IS NOT NULL")
    # event time: the zone-less clock read as UTC, in any session zone; devices come with none
    e = e.withColumn("event_time", F.timestamp_micros(F.coalesce(micros(F.col("at")), F.lit(0).cast("bigint")))).withWatermark("event_time", lateness)
    rows = e.select("device_id", F.when(F.col("at").isNotNull(), F.unix_micros("event_time")).alias("ts"))
    return rows.groupBy("device_id").transformWithStateInPandas(
        MaintenanceTimer(days), StructType.fromDDL(_NEWS), outputMode="Append", timeMode="EventTime")


def start_maintenance_news(devices: DataFrame, records: DataFrame, sink: str, checkpoint: str, days: int = MAINTENANCE_DUE_DAYS,
                           lateness: str = "0 seconds", available_now: bool = True) -> StreamingQuery:
    return start_append(maintenance_news(devices, records, days, lateness), sink, checkpoint, available_now)


def devices_due(news: DataFrame, tables: Mapping[str, DataFrame], as_of) -> DataFrame:
    """The reminders that stand after ``news``, with the columns of the batch operator at date ``as_of``.

    They are those of ``maintenance_due`` at the date the watermark has reached.
    """
    last = news.groupBy("device_id").agg(F.max_by(F.struct("news", "last_maintenance_time"), "nth").alias("s"))
    due = last.where(F.col("s.news") == DUE).select("device_id", "s.last_maintenance_time")
    return reminders(device_dim(tables, "left").join(due, "device_id"), as_date(as_of))


def watermark_date(query: StreamingQuery) -> _dt.date:
    """The date a finished stream's watermark has reached."""
    text = query.lastProgress["eventTime"]["watermark"]
    return _dt.datetime.fromisoformat(text.replace("Z", "+00:00")).date()
