"""Property tests: the minute-bucket interval join equals a brute-force scan on random data."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from envmon.operators import interval
from envmon.schemas import conform

BASE = dt.datetime(2024, 1, 10, 12, 0, 0)
FIVE = dt.timedelta(minutes=5)
OFFSETS = st.one_of(
    st.integers(min_value=-1800, max_value=1800).map(lambda s: dt.timedelta(seconds=s)),
    st.sampled_from([FIVE, -FIVE, FIVE + dt.timedelta(microseconds=1), -FIVE - dt.timedelta(microseconds=1),
                     FIVE - dt.timedelta(microseconds=1), dt.timedelta(0)]),
)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(alerts=st.lists(st.tuples(st.integers(0, 30), st.integers(1, 2)), min_size=1, max_size=8),
       readings=st.lists(st.tuples(st.integers(0, 30), OFFSETS, st.integers(10, 12), st.booleans()),
                         min_size=1, max_size=12))
def test_interval_join_random(spark, alerts, readings):
    # alert i at BASE + a minutes in region r; reading at (BASE + b minutes + offset), sensor s, valid flag
    arows = [(i, 1, r, BASE + dt.timedelta(minutes=a), "PENDING") for i, (a, r) in enumerate(alerts)]
    rrows = [(j, s, BASE + dt.timedelta(minutes=b) + off, "TEMPERATURE", None, "C", "VALID" if ok else "INVALID")
             for j, (b, off, s, ok) in enumerate(readings)]
    t = {
        "alerts": conform(spark.createDataFrame(arows, "alert_id BIGINT, rule_id BIGINT, region_id BIGINT, "
                                                "triggered_at TIMESTAMP_NTZ, status STRING"), "alerts"),
        "sensor_readings": conform(spark.createDataFrame(
            rrows, "reading_id BIGINT, sensor_id BIGINT, collected_at TIMESTAMP_NTZ, reading_type STRING, "
                   "numeric_value DECIMAL(10,2), value_unit STRING, data_status STRING"), "sensor_readings"),
        "sensors": conform(spark.createDataFrame([(10, 1), (11, 2), (12, 1)], "sensor_id BIGINT, region_id BIGINT"),
                           "sensors"),
        "regions": conform(spark.createDataFrame([(1, "a"), (2, "b")], "region_id BIGINT, region_name STRING"),
                           "regions"),
    }
    region_of = {10: 1, 11: 2, 12: 1}
    for same in (False, True):
        got = {r["alert_id"] for r in interval.alerts_near_readings(t["alerts"], t, "VALID", same).collect()}
        want = {i for i, _, r, ts, _ in arows
                if any(st_ == "VALID" and ts - FIVE <= c <= ts + FIVE and (not same or region_of[s] == r)
                       for _, s, c, _, _, _, st_ in rrows)}
        assert got == want
