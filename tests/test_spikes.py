"""Spikes, stuck runs over block edges, bounds."""

import os
import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest

from tidewatch.operators import spikes
from tidewatch.plans import problems

T0 = datetime(2025, 3, 1, tzinfo=timezone.utc)
SCHEMA = "asset_id string, stream string, value double, event_time timestamp, delivery_id long, event_id string, block int"


def judged(spark, values, step=10, start=0, **kw):
    rows = [("a", "s", v, T0 + timedelta(seconds=start + step * i), i, f"e{i}", 0) for i, v in enumerate(values)]
    random.Random(0).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = spikes.suspicious(df, ("asset_id", "stream"), "event_time", "value", "delivery_id", carry=("event_id",), **kw).collect()
    assert all(r.event_id == f"e{r.delivery_id}" for r in out)
    return {r.delivery_id for r in out if r.spike}, {r.delivery_id for r in out if r.stuck}


def noisy(n, level=5.0, seed=1):
    return (level + 0.1 * np.random.RandomState(seed).randn(n)).round(4).tolist()


def test_single_and_short_spikes(spark):
    v = noisy(400)
    v[100], v[200:203], v[399], v[0] = 9.0, [1.0, 1.2, 1.1], 12.0, -3.0
    assert judged(spark, v) == ({0, 100, 200, 201, 202, 399}, set())


def test_states_and_levels_are_no_spikes(spark):
    v, on = [], False
    rnd = random.Random(4)
    while len(v) < 900:
        v += noisy(rnd.choice([2, 3, 4, 8, 20]), 8.0 if on else 0.0, len(v))
        on = not on
    v += noisy(200, 3.0)
    assert judged(spark, v)[0] == set()


def test_stuck_runs_also_over_block_edges_and_gaps(spark):
    v = noisy(100)
    v[20:30], v[50:59] = [5.5] * 10, [5.6] * 9
    assert judged(spark, v)[1] == set(range(20, 30))
    for start in (86_400 - 545, 86_400 - 505, 86_400 - 585):
        w = noisy(100)
        w[50:60] = [5.5] * 10
        assert judged(spark, w, start=start)[1] == set(range(50, 60)), start
    assert judged(spark, [2.0] * 12, step=40_000)[1] == set(range(12))  # blocks of two or three readings each
    assert judged(spark, [2.0] * 9, step=40_000)[1] == set()


def test_block_length_does_not_matter(spark):
    v = noisy(2000, seed=9)
    for i in (77, 500, 1300, 1301):
        v[i] = 20.0
    v[900:915] = [4.0] * 15
    a = judged(spark, v)
    assert a == judged(spark, v, block_seconds=7_200) == ({77, 500, 1300, 1301}, set(range(900, 915)))


def test_scatter_is_the_source_s_own_in_any_blocks(spark):
    """Quiet and noisy days, hours apart: what is odd for the source doesn't depend on how it is cut."""
    rnd = np.random.RandomState(3)
    v = np.concatenate([5 + s * rnd.randn(2_000) for s in (0.02, 1.0, 0.02, 1.0, 0.02)]).round(4).tolist()
    for i in (300, 4_500, 9_100):
        v[i] = 60.0
    v[1_000] = 5.5  # far for that hour, usual for the source
    whole = judged(spark, v, block_seconds=10**6, sources=1)
    assert whole[0] == {300, 4_500, 9_100}
    for seconds in (7_200, 20_000, 86_400):
        assert judged(spark, v, block_seconds=seconds, sources=1) == whole
    assert judged(spark, v, block_seconds=20_000) == whole  # scatters joined by shuffle


def test_quantile_points_stand_for_all_values():
    x, g = np.arange(1000.0), np.repeat([0, 1, 2], [3, 64, 933])
    at, values, weights = spikes._points(x[::-1].copy(), g[::-1].copy())
    assert np.bincount(at, weights).tolist() == [3, 64, 933] and [(at == i).sum() for i in range(3)] == [3, 64, 64]
    assert values[at == 2][-1] == 999.0 and spikes._points(x[:0], g[:0])[0].size == 0


def test_scatters_reach_null_sources_and_sparse_blocks(spark):
    rnd = np.random.RandomState(5)
    rows = []
    for asset, stream in ((None, "s"), ("a", None), (None, None), ("a", "s")):
        v = (5 + rnd.randn(600)).round(4)
        v[300] = 60.0
        rows += [(asset, stream, float(x), T0 + timedelta(seconds=60 * i), len(rows) + i, "e", 0) for i, x in enumerate(v)]
        rows += [(asset, stream, x, T0 + timedelta(days=9, seconds=60 * i), len(rows) + i, "e", 0) for i, x in enumerate([5.0, 5.0, 5.0, 5.1, 7.0])]  # usual for the source
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = [sorted(r.delivery_id for r in spikes.suspicious(df, ("asset_id", "stream"), "event_time", "value", "delivery_id", **kw).where("spike").collect()) for kw in ({}, {"sources": 4})]
    assert found[0] == found[1] == [r[4] for r in rows if r[2] == 60.0]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_no_table_that_grows_with_the_input_is_broadcast(spark, monkeypatch):
    """Neither scatters nor edge runs nor odd messages; the bounds are the one small table."""
    written, plans = spikes.written, []

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, name)

    monkeypatch.setattr(spikes, "written", seen)
    monkeypatch.setattr(problems, "written", seen)
    few = sorted(map(tuple, problems.p5_readings(spark, "/root/testdata/sf0.001").collect()))
    monkeypatch.setattr(problems, "SMALL_BYTES", -1)
    many = problems.p5_readings(spark, "/root/testdata/sf0.001")
    plans.append(many._jdf.queryExecution().executedPlan().toString())
    assert [p.count("BroadcastExchange") for p in plans] == [0, 0, 0, 0, 1] and few == sorted(map(tuple, many.collect()))


def test_unusable_values_few_readings_and_empty(spark):
    assert judged(spark, [1.0, None, float("nan"), float("inf"), 500.0]) == (set(), set())
    assert judged(spark, []) == (set(), set())


def test_bounds(spark):
    sent = spark.createDataFrame([(1, "s", 5.0), (2, "s", 5.1), (3, "s", -1.1), (4, "t", 99.0), (5, "s", None), (6, "s", float("nan")), (7, None, 99.0), (8, "u", 99.0)], "delivery_id long, stream string, value double")
    limits = spark.createDataFrame([("s", -1.0, 5.0), ("u", 0.0, None)], "stream string, phys_min double, phys_max double")
    assert sorted(r.delivery_id for r in spikes.out_of_bounds(sent, limits, "stream", "value").collect()) == [2, 3]
