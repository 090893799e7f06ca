"""Conflict-free counters: cut-off, corrections, and merging in any order and number."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import late

T0 = datetime(2025, 1, 1, tzinfo=timezone.utc)
SCHEMA = "asset_id string, stream string, value double, event_time timestamp, ingestion_time timestamp, batch_id long, delivery_id long, version string"
KEYS = ("asset_id", "stream")


def at(s):
    return T0 + timedelta(seconds=s)


def rows(spark, data):
    return spark.createDataFrame([("a", "s", v, at(e), None if i is None else at(i), b, d, "x") for d, (v, e, i, b) in enumerate(data)], SCHEMA)


def read(df):
    return {(r.asset_id, r.stream, r.window_s - int(T0.timestamp())): (r.readings, r.corrections, round(r.value_mean, 6)) for r in df.collect()}


def test_cut_off_and_first_report(spark):
    df = rows(spark, [(1.0, 10, 10, 1), (2.0, 20, 360, 1), (3.0, 30, 361, 2), (9.0, 0, 720, 2), (9.0, 0, 721, 2), (9.0, 50, 49, 2), (9.0, 60, None, 2), (float("nan"), 1, 2, 1), (None, 1, 2, 1), (float("inf"), 1, 2, 1), (5.0, 300, 300, 1)])
    assert read(late.corrected_windows(df, KEYS)) == {("a", "s", 0): (4, 2, 3.75), ("a", "s", 300): (1, 0, 5.0)}


def test_merging_is_idempotent_and_order_free(spark):
    rnd = random.Random(5)
    data = [(float(rnd.randrange(100)), rnd.randrange(1500), None, rnd.randrange(6)) for _ in range(300)]
    data = [(v, e, e + rnd.randrange(700), b) for v, e, _, b in data]
    df = rows(spark, data)
    whole = read(late.corrected_windows(df, KEYS))
    parts = [late.counter_entries(df.where(f"batch_id % 3 = {k}"), KEYS) for k in range(3)]
    prefix = late.counter_entries(df.where("delivery_id < 150"), KEYS)  # what the sources had said earlier
    for order in ([0, 1, 2], [2, 0, 1], [1, 1, 2, 0, 2, 0]):
        assert read(late.read_counters(late.merge_entries(KEYS, prefix, *[parts[k] for k in order]), KEYS)) == whole


def test_slices_that_divide_a_source_are_named_by_slice(spark):
    """One batch whose readings of a window lie in two slices: named by batch and slice, none is lost."""
    df = rows(spark, [(1.0, 10, 20, 1), (2.0, 20, 30, 1), (6.0, 30, 200, 1)]).withColumn("source", F.concat_ws("|", "batch_id", F.when(F.col("delivery_id") < 2, "early").otherwise("later")))
    parts = [late.counter_entries(df.where(w), KEYS, source="source") for w in ("delivery_id < 2", "delivery_id >= 2")]
    assert read(late.read_counters(late.merge_entries(KEYS, *parts), KEYS)) == read(late.corrected_windows(df, KEYS)) == {("a", "s", 0): (3, 0, 3.0)}


def test_registers_merge_for_any_slices(spark):
    """Slices that divide batches, overlap, come twice, and share messages: as if all had come at once."""
    rnd = random.Random(7)
    data = []
    for d in range(500):
        e = rnd.randrange(1500)
        seen = None if rnd.random() < 0.05 else at(e + rnd.randrange(700))
        data.append(("a", "s", rnd.choice([None, float("nan"), rnd.gauss(5, 1)]) if rnd.random() < 0.1 else rnd.gauss(5, 1), at(e), seen, rnd.randrange(6), d, None if rnd.random() < 0.1 else f"m{rnd.randrange(350)}"))
    df = spark.createDataFrame(data, SCHEMA.replace("version string", "event_id string"))
    ids = ("asset_id", "event_id")
    whole = read(late.corrected_windows(late.registers(df, ids), KEYS))
    parts = [late.registers(df.where(w), ids) for w in ("delivery_id < 250", "delivery_id BETWEEN 120 AND 300", "delivery_id % 2 = 0 AND delivery_id > 200", "delivery_id > 280")]
    for order in ([0, 1, 2, 3], [3, 1, 0, 2, 1, 3, 3]):
        assert read(late.corrected_windows(late.merge_registers(ids, *[parts[i] for i in order]), KEYS)) == whole
    once = late.merge_registers(ids, late.merge_registers(ids, parts[0], parts[1]), late.merge_registers(ids, parts[3], parts[1]))
    assert read(late.corrected_windows(once, KEYS)) == whole
    assert late.registers(df.where("false"), ids).count() == 0


def test_null_source_and_null_keys(spark):
    df = spark.createDataFrame([(None, "s", 1.0, at(1), at(2), None, None, "x"), (None, "s", 3.0, at(1), at(2), None, None, "x")], SCHEMA)
    assert [(r.asset_id, r.readings) for r in late.corrected_windows(df, KEYS).collect()] == [(None, 2)]


def test_values_of_any_size(spark):
    mean = lambda *vs: late.corrected_windows(rows(spark, [(v, i, i + 1, i % 2) for i, v in enumerate(vs)]), KEYS).first().value_mean
    assert mean(4e-7, 4e-7, 4e-7) == 4e-7
    assert mean(1e-9, 3e-9) == 2e-9
    assert mean(1e25, 3e25) == 2e25
    assert mean(1e308, 1.6e308, -2.0) == pytest.approx(1e308 / 3 + 1.6e308 / 3, rel=1e-15)
    assert mean(1.5, 2.25, 0.0000001) == pytest.approx(3.7500001 / 3, rel=1e-15)


def test_empty(spark):
    assert late.corrected_windows(rows(spark, []), KEYS).collect() == []
