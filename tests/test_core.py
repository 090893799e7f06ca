"""Windows, aggregates, preparation, serving, replay, sources and functions on literal tables."""

import json
import random
import statistics
import zipfile
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidewatch.config import EngineConfig
from tidewatch.functions.numeric import ratio, round4, uniform
from tidewatch.functions.timestamps import format_iso, parse_iso
from tidewatch.operators import aggregates, prepare, serving
from tidewatch.sources import readers, replay

T0 = datetime(2026, 1, 5, 10, tzinfo=timezone.utc)
READING = "event_id string, asset_id string, stream string, unit string, value double, event_time timestamp, ingestion_time timestamp"


def at(s):
    return T0 + timedelta(seconds=s)


def readings(spark, rows):
    return spark.createDataFrame([(e, a, s, "u", v, at(t), at(t + lag)) for e, a, s, v, t, lag in rows], READING)


def test_stats_of_four_values(spark):
    df = aggregates.windowed(readings(spark, [(str(i), "a", "h1_pressure", v, 10 * i, 0) for i, v in enumerate((2.0, 4.0, 4.0, 6.0))]), 300)
    r = aggregates.signal_stats(df).first()
    assert (r.readings, r.value_mean, r.value_min, r.value_max, r.value_stddev) == (4, 4.0, 2.0, 6.0, 1.4142)


@pytest.mark.parametrize("motor, oil, want", [((0.04, 0.04, 1.2), (55.0,), (3, 0.3333, 55.0, False)), ((5.5, 5.8), (78.0,), (2, 1.0, 78.0, True)), ((), (), (0, 0.0, 0.0, False)), ((5.0,), (69.99999,), (1, 1.0, 70.0, False))])
def test_health(spark, motor, oil, want):
    rows = [(f"m{i}", "a", "motor_current", v, i, 0) for i, v in enumerate(motor)] + [(f"o{i}", "a", "oil_temperature", v, i, 0) for i, v in enumerate(oil)] + [("p", "a", "tp2_pressure", 1.0, 5, 0)]
    df = aggregates.windowed(readings(spark, rows), 300)
    r = aggregates.health_indicator(df).first()
    assert (r.motor_readings, r.running_ratio, r.oil_temperature_mean, r.air_leak_suspected) == want
    both = {x.metric_type: x for x in aggregates.formatted(aggregates.both(df)).collect()}
    h = both[aggregates.HEALTH]
    assert (h.motor_readings, h.running_ratio, h.oil_temperature_mean, h.air_leak_suspected, h.readings) == (*want, None)
    assert h.aggregate_id == "apu_health_indicator|a|2026-01-05T10:00:00Z" and h.corrections_close_at == "2026-01-05T10:17:00Z"


def test_windows_are_half_open_and_dedup_is_per_asset_and_window(spark):
    df = readings(spark, [("x", "a", "h1_pressure", 2.0, 60, 5), ("x", "a", "h1_pressure", 9.0, 60, 9), ("x", "a", "h1_pressure", 3.0, 360, 0), ("x", "b", "h1_pressure", 4.0, 60, 0), ("y", "a", "h1_pressure", 8.0, 300, 0), (None, "a", "h1_pressure", 1.0, 0, 0)])
    kept = aggregates.dedup_in_window(aggregates.windowed(df, 300))
    assert sorted((r.asset_id, r.value) for r in kept.collect()) == [("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", 8.0), ("b", 4.0)]
    starts = {(r.event_id, r.value): r.w.start for r in kept.collect()}
    assert starts["y", 8.0] == starts["x", 3.0] == datetime(2026, 1, 5, 10, 5)


def test_stats_against_python_in_any_partitioning(spark):
    rnd = random.Random(1)
    rows = [(str(i), rnd.choice("ab"), "h1_pressure", rnd.gauss(5, 2), rnd.randrange(900), 0) for i in range(500)]
    want = {}
    for _, a, _, v, t, _ in rows:
        want.setdefault((a, t // 300), []).append(v)
    for n in (1, 7):
        out = aggregates.signal_stats(aggregates.windowed(readings(spark, rows).repartition(n), 300)).collect()
        got = {(r.asset_id, (r.w.start.minute) // 5): (r.readings, r.value_mean, r.value_stddev) for r in out}
        assert {k: v[0] for k, v in got.items()} == {k: len(v) for k, v in want.items()}
        assert all(abs(got[k][1] - statistics.fmean(v)) < 1e-4 and abs(got[k][2] - statistics.pstdev(v)) < 1e-4 for k, v in want.items())


def test_empty_statistics_and_tables(spark):
    none = readings(spark, [])
    assert tuple(aggregates.empty_stats(none).first()) == (0, 0.0, None, None, 0.0)
    w = aggregates.windowed(none, 300)
    assert aggregates.both(aggregates.dedup_in_window(w)).collect() == []


def test_iso_times(spark):
    texts = ["2026-01-05T10:00:00Z", "2026-01-05 10:00:00", "2026-01-05T12:00:00+02:00", "2026-01-05T06:30:00-0330", "2026-01-05", "2026-01-05T10:00:00.25Z", "0000-00-00 00:00:00", "2026-02-30T00:00:00Z", "10:00:00", "2026", "n/a", "", None, " 2026-01-05T10:00:00Z "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", format_iso(parse_iso("t")).alias("z"))
    got = [r.z for r in df.orderBy("i").collect()]
    ten = "2026-01-05T10:00:00Z"
    assert got == [ten, ten, ten, ten, "2026-01-05T00:00:00Z", "2026-01-05T10:00:00.250000Z", *[None] * 7, ten]


def test_numbers(spark):
    df = spark.createDataFrame([(4.00005, 1, 2), (-4.00005, 0, 0), (1e300, 3, 4), (None, None, None)], "v double, a int, b int")
    got = [tuple(r) for r in df.select(round4("v"), ratio(F.col("a"), F.col("b"))).collect()]
    assert got == [(4.0001, 0.5), (-4.0001, 0.0), (1e300, 0.75), (None, 0.0)]
    u = [r[0] for r in spark.range(2000).select(uniform(3, "id")).collect()]
    assert 0 <= min(u) and max(u) < 1 and abs(sum(u) / 2000 - 0.5) < 0.03
    assert u == [r[0] for r in spark.range(2000).repartition(5).select("id", uniform(3, "id").alias("u")).orderBy("id").select("u").collect()]


WIDE = "asset_id string, source_event_time string, motor_current double, oil_temperature double, tp2 double, dv_pressure double, tp3 double, h1 double, reservoirs double"


def test_unpivot(spark):
    df = spark.createDataFrame([("a", "2026-01-05 10:00:00", 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0), ("a", "bad", *[1.0] * 7), ("a", "2026-01-05 10:00:10", None, float("nan"), float("inf"), 4.0, None, None, None)], WIDE)
    assert (prepare.unpivot(df, version=1).count(), prepare.unpivot(df, version=2).count()) == (5, 8)
    r = prepare.unpivot(df).where("stream = 'motor_current'").first()
    assert (r.event_id, r.unit, r.channel, r.value, r.source_event_time) == ("a|motor_current|2026-01-05T10:00:00Z", "A", "Motor_current", 1.0, "2026-01-05T10:00:00Z")
    assert r.event_time == r.ingestion_time


def test_segments_and_first_minutes(spark):
    rows = spark.createDataFrame([("a", f"2026-01-05 {h:02d}:{m:02d}:00", 1.0) for h in (8, 9, 23) for m in (0, 4, 5, 30)] + [("b", "2026-01-05 08:00:00", 1.0), ("a", None, 1.0)], "asset_id string, source_event_time string, x double")
    seg = spark.createDataFrame([("a", "2026-01-05 08:04:00", "2026-01-05 09:00:00", "ok", None)] * 2 + [("a", "2026-01-05 23:05:00", "2026-01-06 01:00:00", "bad", "f1"), ("b", "x", "y", "ok", None)], "asset_id string, starts_at string, ends_at string, condition_label string, failure_ref string")
    got = sorted((r.source_event_time[11:16], r.condition_label) for r in prepare.in_segments(rows, seg).collect())
    assert got == [("08:04", "ok"), ("08:05", "ok"), ("08:30", "ok"), ("23:05", "bad"), ("23:30", "bad")]
    assert prepare.in_segments(rows, seg, keep_all=True).count() == rows.count()
    assert sorted(r.rows for r in prepare.segment_counts(rows, seg).collect()) == [2, 3]
    timed = rows.withColumn("at", parse_iso("source_event_time"))
    assert sorted(r.source_event_time[11:16] for r in prepare.first_minutes(timed, 5).collect()) == ["08:00", "08:00", "08:04"]
    assert {r.asset_id for r in prepare.first_assets(timed, 1).collect()} == {"a"}
    span = {r.asset_id: r.duration_s for r in prepare.asset_span(timed).collect()}
    assert span == {"a": 55_800.0, "b": 0.0}


PANE = "aggregate_id string, pane_index int, arrival long, running_ratio double"


@pytest.mark.parametrize("sent, want, taken", [([(0, 0.1), (0, 0.2)], 0.2, [True, True]), ([(0, 0.5), (1, 0.9)], 0.9, [True, True]), ([(3, 0.3), (1, 0.9)], 0.3, [True, False])])
def test_monotone_upsert(spark, sent, want, taken):
    stored, got = spark.createDataFrame([], PANE), []
    for i, (p, v) in enumerate(sent):
        new = spark.createDataFrame([("k", p, i, v)], PANE)
        got.append(serving.applied(stored, new).first().applied)
        stored = serving.upsert(stored, new, "arrival")
    assert stored.count() == 1 and stored.first().running_ratio == want and got == taken


def test_upsert_in_any_batches_is_the_same(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["a", "b", "c", None]), rnd.choice([0, 1, 2, None]), i, rnd.random()) for i in range(200)]
    df = spark.createDataFrame(rows, PANE)
    once = sorted(map(tuple, serving.latest_panes(df, "arrival").collect()))
    stored = spark.createDataFrame([], PANE)
    for part in (df.where("arrival < 80"), df.where("arrival >= 80"), df.where("arrival >= 80")):
        stored = serving.upsert(stored, part, "arrival")
    assert sorted(map(tuple, stored.collect())) == once


def test_every_change_is_judged_in_order_of_arrival(spark):
    """Odd and even identifiers alike; a change below a higher one that came before is rejected, whatever its parity."""
    sent = [("a", 0, 2), ("a", 2, 3), ("a", 1, 5), ("a", 1, 6), ("a", 2, 8), ("b", 3, 1), ("b", None, 4), ("b", 0, 7), (None, 1, 9)]
    df = spark.createDataFrame(sent, "aggregate_id string, pane_index int, change_id long").repartition(3)
    got = {r.change_id: r.applied for r in serving.applied_in_order(df, "change_id").collect()}
    assert got == {2: True, 3: True, 5: False, 6: False, 8: True, 1: True, 4: False, 7: False, 9: False}


def test_upsert_queries_take_the_whole_feed(spark, tmp_path):
    from tidewatch.plans import registry

    feed = [(1, "a", 2), (2, "a", 0), (3, "a", 1), (4, "a", 2), (5, "b", 0), (7, "b", 1)]
    spark.createDataFrame([(c, a, p, "m", "insert") for c, a, p in feed], "change_id long, aggregate_id string, pane_index int, metric_type string, op string").write.parquet(f"{tmp_path}/aggregates.parquet")
    assert {r.applied: r.changes for r in registry.upsert_applied(spark, str(tmp_path)).collect()} == {True: 4, False: 2}
    assert sorted((r.aggregate_id, r.pane_index, r.change_id) for r in registry.upsert_twice(spark, str(tmp_path)).collect()) == [("a", 2, 4), ("b", 1, 7)]


def test_verdict(spark):
    rows = [("a", True, 1.0, 80.0)] * 3 + [("a", False, 0.5, 60.0)] * 2 + [("b", False, 0.3, 58.0)] * 3 + [("b", True, 1.0, 75.0)] * 3 + [("z", None, None, None)]
    verdict = serving.fleet_verdict(spark.createDataFrame(rows, "asset_id string, air_leak_suspected boolean, running_ratio double, oil_temperature_mean double"))
    got = {r.asset_id: tuple(r)[1:] for r in verdict.collect()}
    assert got == {"a": (5, 3, 0.8, 72.0, True), "b": (6, 3, 0.65, 66.5, False), "z": (1, 0, None, None, False)}
    want = spark.createDataFrame([("a", True), ("b", False), ("c", False)], "asset_id string, expected_air_leak boolean")
    checked = serving.checked_verdict(verdict, want)
    assert {r.asset_id: r.ok for r in checked.collect()} == {"a": True, "b": True, "c": False}
    extra = serving.unexpected_assets(verdict, want)
    assert [r.asset_id for r in extra.collect()] == ["z"]
    assert tuple(serving.fleet_checks(checked, extra).first()) == (False, True, 3, 1)
    assert "-" in {r.asset_id: r.line for r in serving.text_report(checked).collect()}["c"]


def test_history_views(spark):
    rows = [("a", i, t, "apu_signal_stats", "s", f"w{i}", 1.0) for i, t in enumerate(["EARLY", "ON_TIME", "LATE"])] + [("b", 0, "EARLY", "apu_health_indicator", None, "w0", None)]
    df = spark.createDataFrame(rows, "aggregate_id string, pane_index int, pane_timing string, metric_type string, stream string, window_start string, value_mean double")
    assert [(r.aggregate_id, r.pane_index) for r in serving.pane_timeline(df).collect()] == [("a", 0), ("a", 1), ("a", 2)]
    assert tuple(serving.count_by_metric(df).first()) == (4, 3, 1)
    assert [r.window_start for r in serving.last_rows(df, 2).collect()] == ["w2", "w1"]
    assert [r.pane_index for r in aggregates.panes(df).where("is_last AND aggregate_id = 'a'").collect()] == [2]
    diff = serving.key_differences(df.where("pane_index < 2"), df.where("pane_index > 0"), "aggregate_id", "pane_index")
    assert sorted((r.aggregate_id, r.pane_index, r.side) for r in diff.collect()) == [("a", 0, "missing"), ("a", 2, "extra"), ("b", 0, "missing")]
    full = df.withColumns({"asset_id": F.lit("x"), "window_end": F.lit("e"), "is_last": F.lit(None).cast("boolean"), "emitted_at": F.lit("t")})
    row = serving.serving_rows(full).where("aggregate_id = 'b'").first()
    assert row.is_last == 0 and json.loads(row.payload)["value_mean"] is None and row.updated_at == "t"


def replayed(spark, scenario, **kw):
    wide = spark.createDataFrame([(a, (T0 + timedelta(seconds=10 * i)).strftime("%Y-%m-%d %H:%M:%S"), *[1.0] * 7) for a in ("a", "b") for i in range(300)], WIDE)
    return replay.replay(prepare.unpivot(wide, version=1), scenario, target_start=T0, **kw)


def test_replay(spark):
    quiet = replayed(spark, replay.SCENARIOS["normal"])
    assert tuple(replay.fault_counts(quiet).first()) == (2400, 0, 0, 0, 0)
    adverse = replayed(spark, replay.SCENARIOS["adverse"])
    n = replay.fault_counts(adverse).first()
    assert n.events == 2400 + n.duplicates and 20 < n.duplicates < 90 and 60 < n.out_of_order < 180 and n.late > 15 and n.too_late > 2
    rows = adverse.collect()
    assert {(r.ingestion_time - r.event_time).total_seconds() for r in rows if r.fault == "too_late"} == {1800.0}
    assert all(r.ingestion_time >= r.event_time for r in rows)
    again = replayed(spark, replay.SCENARIOS["adverse"])
    assert sorted(map(str, rows)) == sorted(map(str, again.repartition(9).collect()))
    assert replay.fault_counts(adverse.where("false")).first().events == 0
    assert [r.delivery_s for r in replay.in_delivery_order(adverse).collect()] == sorted(r.delivery_s for r in rows)
    with pytest.raises(ValueError):
        replayed(spark, replay.SCENARIOS["normal"], speedup=0)
    ends = replay.replay(prepare.unpivot(spark.createDataFrame([("a", "2020-01-01 00:00:00", *[1.0] * 7), ("a", "2020-01-01 04:00:00", *[1.0] * 7)], WIDE)))
    assert ends.agg(F.max("event_time")).first()[0] <= datetime.now(timezone.utc).replace(tzinfo=None)


def test_sources_and_sinks(spark, tmp_path):
    csv = tmp_path / "m.csv"
    csv.write_text("n,timestamp,TP2,TP3,H1,DV_pressure,Reservoirs,Oil_temperature,Motor_current,other\n0,2020-02-01 00:00:00,1.5,2,3,4,5,6,x,9\n")
    with zipfile.ZipFile(tmp_path / "m.zip", "w") as z:
        z.write(csv, "m.csv")
    r = readers.wide_csv_in_zip(spark, str(tmp_path / "m.zip"), "m.csv", str(tmp_path / "un")).first()
    assert (r.TP2, r.Reservoirs, r.Motor_current, r.timestamp) == (1.5, 5.0, None, datetime(2020, 2, 1))
    lines = tmp_path / "e.jsonl"
    lines.write_text('{"event_id":"e","asset_id":"a","sensor":{"stream":"s","unit":"u"},"value":2,"event_time":"t"}\n\n   \n{"event_id":"f","asset_id":"a","stream":"q","value":1,"event_time":"t","ingestion_time":"i","schema_version":2}\n')
    got = [(r.schema_version, r.stream, r.unit, r.channel, r.ingestion_time, r.source_event_time) for r in readers.json_lines(spark, str(lines)).orderBy("event_id").collect()]
    assert got == [(1, "s", "u", "", "t", "t"), (2, "q", "", "", "i", "t")]
    readers.write_json_lines(spark.createDataFrame([("x",), ("y",)], "v string"), "v", str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["x", "y"]
    assert readers.manifest(spark.range(4), str(tmp_path / "m.json"), sha=readers.sha256_file(str(csv)))["rows_total"] == 4
    assert readers.fetch(csv.as_uri(), str(tmp_path / "copy.csv")) and (tmp_path / "copy.csv").read_text() == csv.read_text()
    if not readers.kafka_available(spark):
        with pytest.raises(RuntimeError):
            readers.kafka_stream(spark, "s", "t")


def test_config_from_env(monkeypatch):
    monkeypatch.setenv("TIDEWATCH_WINDOW_SECONDS", "60")
    monkeypatch.setenv("TIDEWATCH_RAW_TOPIC", "t")
    c = EngineConfig.from_env()
    assert (c.window_seconds, c.raw_topic, c.allowed_lateness_seconds) == (60, "t", 720)


def test_core_does_not_import_the_llm_package():
    from pathlib import Path

    root = Path(aggregates.__file__).parents[1]
    assert [p for p in root.rglob("*.py") if "llm" not in p.parts and ("tidewatch.llm" in p.read_text() or "from tidewatch import llm" in p.read_text())] == []
