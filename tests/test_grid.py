"""Regular series: which slots, and what they are filled with."""

import math
from datetime import datetime, timedelta, timezone

import pytest

from tidewatch.operators import grid

T0 = datetime(2025, 3, 1, 10, tzinfo=timezone.utc)
SCHEMA = "asset_id string, stream string, value double, at timestamp"


def series(spark, points, **kw):
    df = spark.createDataFrame([("a", "s", v, None if s is None else T0 + timedelta(seconds=s)) for s, v in points], SCHEMA)
    out = grid.regular_series(df, ("asset_id", "stream"), time="at", **kw).collect()
    return {r.slot_s - int(T0.timestamp()): (r.value, r.filled, r.readings) for r in out}


def test_slots_and_bridge(spark):
    out = series(spark, [(5, 1.0), (50, 3.0), (245, 6.0), (300, float("nan")), (310, None), (None, 9.0), (360, float("inf"))])
    assert {k: v[1] for k, v in out.items()} == {0: False, 60: True, 120: True, 180: True, 240: False}
    assert out[0][0] == 2.0 and out[0][2] == 2 and out[60][2] == 0
    assert all(1.5 < out[k][0] < 6.5 for k in (60, 120, 180))


def test_seasonal_signal_is_recovered(spark):
    f = lambda s: 10 + 3 * math.sin(2 * math.pi * s / 86400 + 1)
    base = int(T0.timestamp())
    points = [(60 * k, f(base + 60 * k)) for k in range(0, 800) if not 300 <= k < 420]
    out = series(spark, points)
    assert sum(v[1] for v in out.values()) == 120
    assert max(abs(out[60 * k][0] - f(base + 60 * k)) for k in range(300, 420)) < 0.05


def test_held_out_slots_are_filled_better_than_by_a_line(spark):
    f = lambda s: 10 + 3 * math.sin(2 * math.pi * s / 86400 * 2 + 1)
    base = int(T0.replace(hour=0).timestamp())
    rows = [("a", "s", f(base + 60 * k), T0.replace(hour=0) + timedelta(minutes=k)) for k in range(3 * 1440)]
    out = grid.held_out(spark.createDataFrame(rows, SCHEMA), ("asset_id", "stream"), time="at", stretch=7_200).first()
    assert out.held_out > 100 and out.model_error < 1e-3 < out.line_error
    assert grid.held_out(spark.createDataFrame([], SCHEMA), ("asset_id", "stream"), time="at").count() == 0


def test_days_are_not_joined_and_null_keys(spark):
    out = series(spark, [(0, 1.0), (86_400, 2.0), (86_520, 2.0)])
    assert sorted(k for k, v in out.items() if v[1]) == [86_460]
    df = spark.createDataFrame([(None, "s", 1.0, T0), (None, "s", 1.0, T0 + timedelta(seconds=125))], SCHEMA)
    assert grid.regular_series(df, ("asset_id", "stream"), time="at", only_filled=True).count() == 1


def test_empty_and_bad_step(spark):
    assert series(spark, []) == {}
    with pytest.raises(ValueError):
        series(spark, [(0, 1.0)], step=7)
