"""The streaming job and the pane processor on one file per step."""

import os
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidewatch.config import EngineConfig
from tidewatch.operators import cdc
from tidewatch.streaming import pipeline

T0 = datetime(2026, 1, 5, 10, tzinfo=timezone.utc)
READING = "event_id string, asset_id string, stream string, unit string, value double, event_time timestamp, ingestion_time timestamp"
#: Event, event time, ingestion time, value; seconds from the first window's start; fixed values.
STEPS = [("E1", 20, 45, 4.0), ("E2", 70, 90, 4.4), ("E2", 70, 95, 4.4), ("E3", 290, 305, 5.0), ("E4", 150, 320, 4.2), ("E5", 370, 385, 5.6), ("E7", 450, 470, 5.2), ("E6", 220, 540, 6.0), ("E9", 1180, 1200, 5.1), ("E8", 110, 1320, 9.9)]


@pytest.fixture()
def steps(spark, tmp_path):
    folder = tmp_path / "steps"
    folder.mkdir()
    for i, (e, t, seen, v) in enumerate(STEPS):
        out = tmp_path / f"s{i}"
        spark.createDataFrame([(e, "a", "h1_pressure", "bar", v, T0 + timedelta(seconds=t), T0 + timedelta(seconds=seen))], READING).coalesce(1).write.parquet(str(out))
        part = next(out.glob("*.parquet"))
        target = folder / f"{i:02d}.parquet"
        part.rename(target)
        os.utime(target, (1_000_000 + i, 1_000_000 + i))
    return str(folder)


def test_panes(spark, steps):
    every = pipeline.run_panes(spark, steps, files_per_trigger=1)
    health = every.where("metric_type = 'apu_health_indicator' AND NOT is_last").collect()
    rows = every.where("metric_type = 'apu_signal_stats' AND NOT is_last").collect()
    first = sorted((r.pane_index, r.pane_timing, r.readings, r.value_mean) for r in rows if r.window_s == int(T0.timestamp()))
    assert first == [(0, "EARLY", 1, 4.0), (1, "EARLY", 2, 4.2), (2, "EARLY", 3, 4.4667), (3, "EARLY", 4, 4.4), (4, "ON_TIME", 4, 4.4), (5, "LATE", 5, 4.72)]
    second = max((r.pane_index, r.pane_timing, r.readings, r.value_mean) for r in rows if r.window_s == int(T0.timestamp()) + 300)
    assert second[1:] == ("ON_TIME", 2, 5.4)
    assert all(r.is_first == (r.pane_index == 0) for r in rows)
    assert sorted((r.window_s, r.pane_index, r.pane_timing) for r in rows) == sorted((r.window_s, r.pane_index, r.pane_timing) for r in health)  # one stream: both kinds fire together
    assert all((r.motor_readings, r.running_ratio, r.oil_temperature_mean, r.air_leak_suspected, r.readings) == (0, 0.0, 0.0, False, None) for r in health)


def test_running_totals_and_restart(spark, steps, tmp_path):
    root, checkpoint = f"file://{tmp_path}/serving", f"file://{tmp_path}/checkpoint"
    stream = lambda: spark.readStream.schema(READING).option("maxFilesPerTrigger", 1).parquet(steps)
    for _ in range(2):  # the second start finds nothing new and changes nothing
        pipeline.start(stream(), root, checkpoint, once=True).awaitTermination()
        rows = {r.aggregate_id: r for r in cdc.read_published(spark, root, "aggregates").collect()}
        w1 = rows["apu_signal_stats|a|h1_pressure|2026-01-05T10:00:00Z"]
        assert (w1.readings, w1.value_mean, w1.pane_index, w1.pane_timing) == (5, 4.72, 5, "LATE")
        assert len(rows) == 6 and rows["apu_health_indicator|a|2026-01-05T10:05:00Z"].motor_readings == 0


def test_wire_routes(spark, tmp_path):
    import json

    good = {"schema_version": 1, "event_id": "e1", "asset_id": "a1", "sensor": {"stream": "motor_current", "channel": "Motor_current", "unit": "A"}, "value": 1.5, "event_time": "2026-01-05T10:00:00Z", "ingestion_time": "2026-01-05T10:01:00Z"}
    payloads = [json.dumps(good), "{", json.dumps(good | {"ingestion_time": "2026-01-05T12:00:00Z"})]
    spark.createDataFrame([("k", p) for p in payloads], "kafka_key string, payload string").coalesce(1).write.parquet(f"{tmp_path}/wire")
    stream = spark.readStream.schema("kafka_key string, payload string").parquet(f"{tmp_path}/wire")
    pipeline.start_wire(stream, f"{tmp_path}/out", f"{tmp_path}/cp", once=True).awaitTermination()
    assert [spark.read.parquet(f"{tmp_path}/out/{n}").count() for n in ("admitted", "quarantine", "too_late")] == [1, 1, 1]


def test_counters(spark, steps, tmp_path):
    counters = pipeline.Counters()
    spark.streams.addListener(counters)
    try:
        stream = spark.readStream.schema(READING).option("maxFilesPerTrigger", 1).parquet(steps)
        pipeline.start(stream, f"file://{tmp_path}/s", f"file://{tmp_path}/c", once=True, with_panes=False).awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark.streams.removeListener(counters)
    assert counters.input_rows == len(STEPS) and counters.duplicates_dropped == 1


def test_replayed_panes_are_the_stream_s(spark, steps):
    """The steps' readings in one table give the panes that one step per trigger gives."""
    cols = ["metric_type", "asset_id", "stream", "window_s", "pane_index", "pane_timing", "is_first", "is_last", "readings", "value_mean", "value_min", "value_max", "value_stddev", "motor_readings", "running_ratio", "oil_temperature_mean", "air_leak_suspected"]
    rows = lambda df: sorted(map(str, (tuple(r) for r in df.select(*cols).collect())))
    feed = spark.read.schema(READING).parquet(steps).withColumn("delivery_id", F.monotonically_increasing_id())
    config = EngineConfig(early_firing_seconds=1)
    got = rows(pipeline.replay_panes(feed.repartition(3), config))
    assert got == rows(pipeline.run_panes(spark, steps, config, files_per_trigger=1))
    assert sum("'LATE'" in r for r in got) == 4 and sum("'ON_TIME'" in r for r in got) == 4  # two windows of both kinds


def test_random_feed_panes_are_the_stream_s(spark, tmp_path):
    """Both kinds, several streams and assets, repeats with other values, one file per step, against the replay of the whole."""
    import random

    rnd, rows = random.Random(3), []
    for i in range(400):
        t = rnd.randrange(2400)
        rows.append((f"e{rnd.randrange(330)}", rnd.choice("ab"), rnd.choice(["motor_current", "oil_temperature", "h1_pressure"]), rnd.choice(["A", None]), rnd.choice([0.2, 5.0, rnd.gauss(70, 9)]), T0 + timedelta(seconds=t), T0 + timedelta(seconds=t + rnd.choice([1, 5, 40, 300, 700])), i))
    rows.sort(key=lambda r: r[6])
    config = EngineConfig(early_firing_seconds=100)
    folder = tmp_path / "steps"
    folder.mkdir()
    for n, step in enumerate(sorted({int(r[6].timestamp()) // 100 for r in rows})):
        spark.createDataFrame([r for r in rows if int(r[6].timestamp()) // 100 == step], READING + ", delivery_id long").coalesce(1).write.parquet(f"{tmp_path}/p{n}")
        target = folder / f"{n:03d}.parquet"
        next((tmp_path / f"p{n}").glob("*.parquet")).rename(target)
        os.utime(target, (1_000_000 + n, 1_000_000 + n))
    cols = ["metric_type", "asset_id", "stream", "unit", "window_s", "pane_index", "pane_timing", "is_first", "is_last", "readings", "value_mean", "value_min", "value_max", "value_stddev", "motor_readings", "running_ratio", "oil_temperature_mean", "air_leak_suspected"]
    show = lambda df: sorted(map(str, (tuple(r) for r in df.select(*cols).collect())))
    got = show(pipeline.run_panes(spark, str(folder), config, files_per_trigger=1))
    assert got == show(pipeline.replay_panes(spark.createDataFrame(rows, READING + ", delivery_id long"), config))


def test_only_changed_buckets_are_written(spark, tmp_path):
    root = f"file://{tmp_path}"
    merge = lambda stored, new: stored.unionByName(new).groupBy("k").agg(F.max("v").alias("v"))
    put = lambda rows: cdc.upsert_buckets(spark.createDataFrame(rows, "k string, v int"), root, "t", "k", merge, buckets=16)
    read = lambda: {r.k: r.v for r in cdc.read_published(spark, root, "t").collect()}
    put([])
    assert read() == {}
    put([(f"k{i}", i) for i in range(100)])
    first = cdc.read_published(spark, root, "t")
    put([("k1", 500), ("new", 7), ("k2", 0)])
    assert read() == {**{f"k{i}": i for i in range(100)}, "k1": 500, "new": 7}
    assert {r.k: r.v for r in first.collect()} == {f"k{i}": i for i in range(100)}  # an earlier reader still has its versions
    written = [sum(1 for _ in p.glob("c_bucket=*")) for p in sorted(tmp_path.glob("t/v-*"), key=lambda p: p.stat().st_mtime)]
    assert written[-1] <= 3
    put([])
    for i in range(20):
        put([(f"k{j}", 1000 + i) for j in range(100)])
    assert len(list(tmp_path.glob("t/v-*"))) <= 4 and read()["k5"] == 1019


def test_topics_by_sinks(spark, tmp_path):
    import json

    good = {"schema_version": 1, "event_id": "e1", "asset_id": "a1", "sensor": {"stream": "motor_current", "channel": "Motor_current", "unit": "A"}, "value": 1.5, "event_time": "2026-01-05T10:00:00Z", "ingestion_time": "2026-01-05T10:01:00Z"}
    payloads = [json.dumps(good), "{", json.dumps(good | {"ingestion_time": "2026-01-05T12:00:00Z"})]
    spark.createDataFrame([("k", p) for p in payloads], "kafka_key string, payload string").coalesce(1).write.parquet(f"{tmp_path}/wire")
    sent = {"quarantine": [], "too_late": [], "features": []}
    sink = lambda name: lambda batch, n: sent[name].extend(batch.collect())
    raw = lambda: spark.readStream.schema("kafka_key string, payload string").parquet(f"{tmp_path}/wire")
    queries = pipeline.start_topics(raw, f"file://{tmp_path}/out", f"{tmp_path}/cp", EngineConfig(), once=True, sinks={n: sink(n) for n in ("quarantine", "too_late")}, features=sink("features"))
    for q in queries:
        q.awaitTermination()
    assert [r.reason for r in sent["quarantine"]] == ["invalid_json"] and [r.event_id for r in sent["too_late"]] == ["e1"]
    assert {(r.metric_type, r.pane_timing) for r in sent["features"]} == {("apu_signal_stats", "EARLY"), ("apu_health_indicator", "EARLY")}
    assert cdc.read_published(spark, f"file://{tmp_path}/out", "aggregates").count() == 2


def test_stream_panes_shows_corrections(spark):
    """A window that is corrected after its on-time pane has a late pane with more readings."""
    panes = entry.queries()["stream_panes"](spark, "/root/testdata/sf0.001").where("NOT is_last AND readings IS NOT NULL").collect()
    on_time = {(r.asset_id, r.stream, r.unit, r.window_s): r for r in panes if r.pane_timing == "ON_TIME"}
    late = [r for r in panes if r.pane_timing == "LATE"]
    assert late and all(r.readings > on_time[r.asset_id, r.stream, r.unit, r.window_s].readings for r in late)
    final = {}
    for r in sorted(panes, key=lambda r: r.pane_index):
        final[r.asset_id, r.stream, r.unit, r.window_s] = r.readings
    stats = entry.queries()["signal_stats_5m"](spark, "/root/testdata/sf0.001")
    assert sum(final.values()) == stats.agg(F.sum("readings")).first()[0]
