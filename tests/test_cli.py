"""Commands from a raw record to a verdict, in one session."""

import json
import math

import pytest

from tidewatch.__main__ import main
from tidewatch.operators import cdc
from tidewatch.streaming import pipeline


def say(capsys, *args):
    code = main([str(a) for a in args])
    return code, json.loads(capsys.readouterr().out.strip().splitlines()[-1])


@pytest.fixture()
def record(spark, tmp_path):
    """A day of one machine: running hot from noon on."""
    lines = ["timestamp,TP2,TP3,H1,DV_pressure,Reservoirs,Oil_temperature,Motor_current"]
    for s in range(0, 86_400, 60):
        hot = s >= 43_200
        lines.append(f"2020-02-01 {s // 3600:02d}:{s // 60 % 60:02d}:00,1,2,3,4,5,{80 if hot else 55 + math.sin(s)},{5 if hot or s % 600 < 120 else 0.04}")
    (tmp_path / "m.csv").write_text("\n".join(lines) + "\n")
    rows = [("a1", "2020-02-01 08:00:00", "2020-02-01 09:00:00", "sano", None), ("a2", "2020-02-01 13:00:00", "2020-02-01 14:30:00", "fault", "f1")]
    spark.createDataFrame(rows, "asset_id string, starts_at string, ends_at string, condition_label string, failure_ref string").write.parquet(str(tmp_path / "segments"))
    return tmp_path


def test_from_record_to_verdict(spark, record, capsys):
    t = record
    (t / "rows.json").write_text('{"a1": 60, "a2": 91}')
    code, made = say(capsys, "prepare", "--csv", t / "m.csv", "--segments", t / "segments", "--out", t / "wrong", "--expect", t / "rows.json")
    assert code == 1 and made["rows_by_asset"] == {"a1": 60, "a2": 90} and not made["ok"]
    _, made = say(capsys, "prepare", "--csv", t / "m.csv", "--segments", t / "segments", "--out", t / "data")
    assert made["rows_total"] == 60 + 90 and spark.read.text(str(t / "data/sample")).count() == 2 * 5 * 4
    _, sent = say(capsys, "replay", "--wide", t / "data/fleet", "--out", t / "steps", "--step-seconds", 1800)
    assert sent == {"duplicates": 0, "events": 600, "late": 0, "out_of_order": 0, "too_late": 0}
    say(capsys, "run", "--source", t / "steps", "--root", f"file://{t}/root", "--checkpoint", t / "cp", "--once")
    say(capsys, "verdict", "--root", f"file://{t}/root", "--segments", t / "segments", "--only-last")
    code, verdict = say(capsys, "verdict", "--root", f"file://{t}/root", "--segments", t / "segments")
    assert code == 0 and verdict == {"ok": True, "separation_observed": True, "assets": 2, "unexpected": 0}


def test_smoke(record, capsys):
    say(capsys, "prepare", "--csv", record / "m.csv", "--segments", record / "segments", "--out", record / "data")
    code, out = say(capsys, "smoke", "--wide", record / "data/fleet")
    assert code == 0 and out["ok"] and out["routes"]["too_late"] > 0


def test_materializer_skips_what_it_cannot_read(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    message = lambda i, p, v: json.dumps({"aggregate_id": i, "pane_index": p, "metric_type": "apu_signal_stats", "value_mean": v})
    (tmp_path / "in/1.txt").write_text("\n".join([message("k", 1, 1.0), "no json", "{}", message("k", 0, 9.0), message("j", 0, 2.0)]))
    args = ("materialize", "--source", tmp_path / "in", "--root", f"file://{tmp_path}/root", "--checkpoint", tmp_path / "cp")
    _, out = say(capsys, *args)
    assert out == {"messages_seen": 5, "errors": 2, "aggregates": 2, "signal_stats": 2, "health_indicators": 0}
    (tmp_path / "in/2.txt").write_text(message("k", 1, 3.0))
    say(capsys, *args)
    got = {r.aggregate_id: r.value_mean for r in cdc.read_published(spark, f"file://{tmp_path}/root", "aggregates").collect()}
    assert got == {"k": 3.0, "j": 2.0}


def test_sink_in_place_of_the_table(spark, tmp_path):
    seen = []
    spark.createDataFrame([("e", "a", "h1_pressure", None, 1.0)], "event_id string, asset_id string, stream string, unit string, value double").selectExpr("*", "timestamp'2026-01-05 10:00:00' AS event_time", "timestamp'2026-01-05 10:00:01' AS ingestion_time").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    pipeline.start(stream, "", f"{tmp_path}/cp", once=True, sink=lambda batch, n: seen.extend(r.aggregate_id for r in batch.collect())).awaitTermination()
    assert sorted(seen) == ["apu_health_indicator|a|2026-01-05T10:00:00Z", "apu_signal_stats|a|h1_pressure|2026-01-05T10:00:00Z"]
