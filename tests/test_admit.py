"""Contract rules against a reading of the JSON by Python itself."""

import json
import math
from datetime import datetime, timedelta, timezone

import pytest

from tidewatch.operators import admit
from tidewatch.schema import REQUIRED, STREAM_NAMES

T0 = datetime(2026, 1, 5, 10, tzinfo=timezone.utc)
GOOD = {"schema_version": 1, "event_id": "e1", "asset_id": "a1", "sensor": {"stream": "motor_current", "channel": "Motor_current", "unit": "A"}, "value": 1.5, "event_time": "2026-01-05T10:00:00Z", "ingestion_time": "2026-01-05T10:01:00Z"}


def z(lag):
    return (T0 + timedelta(seconds=lag)).isoformat().replace("+00:00", "Z")


def brute(payload):
    try:
        e = json.loads(payload.decode())
    except (ValueError, UnicodeDecodeError):
        return "invalid_json"
    if not isinstance(e, dict):
        return "invalid_json"
    if any(k not in e for k in REQUIRED):
        return "missing_field"
    if not isinstance(e["schema_version"], int) or not 1 <= e["schema_version"] <= 2:
        return "unsupported_schema_version"
    s = e["sensor"].get("stream") if isinstance(e["sensor"], dict) else None
    if s not in STREAM_NAMES:
        return "unknown_stream"
    try:
        ok = math.isfinite(float(e["value"]))
    except (TypeError, ValueError):
        ok = False
    if not ok:
        return "non_finite_value"
    try:
        a, b = (datetime.fromisoformat(e[k].replace("Z", "+00:00")) for k in ("event_time", "ingestion_time"))
        a, b = (t.replace(tzinfo=t.tzinfo or timezone.utc) for t in (a, b))
    except (AttributeError, ValueError):
        return "invalid_timestamp"
    lag = (b - a).total_seconds()
    return "future_event_time" if lag < 0 else "stale_event_time" if lag > 86400 else "dropped_by_horizon" if lag > 720 else None


CASES = [
    *[{k: v for k, v in GOOD.items() if k != gone} for gone in REQUIRED], *[GOOD | {"schema_version": v} for v in (0, 1, 2, 3, "1", 1.0, True, False, None, [1])], *[GOOD | {"value": v} for v in (1, "2.5", " 3 ", "1_000", "5d", "abc", "", None, True, [1], {"a": 1}, float("nan"), float("inf"), -0.0, 1e308, "1e400", "nan")],
    *[GOOD | {"sensor": v} for v in (None, "x", [], {}, {"stream": None}, {"stream": "nope"}, {"stream": "h1_pressure"})], *[GOOD | {"event_time": v} for v in ("2026-01-05 10:00:00", "2026-01-05T10:00:00.5+00:00", "2026-01-05T12:00:00+02:00", "10:00:00", "2026", "soon", None, 5, "2026-02-31T00:00:00Z", "")],
    *[GOOD | {"event_time": z(0), "ingestion_time": z(lag)} for lag in (0, -1, -0.001, 720, 720.001, 86400, 86400.001, 300)], GOOD | {"extra": {"a": [1]}}, GOOD | {"asset_id": None}, [GOOD], 5, "text", None, {},
]
RAW = [json.dumps(c).encode() for c in CASES] + [b"", b"{", b"\xff\xfe{\x00", json.dumps(GOOD).encode() + b" x", json.dumps(GOOD).encode() * 2, b"  " + json.dumps(GOOD).encode() + b"\n", b"{'a': 1}", b"[]", json.dumps(GOOD).encode() + b"," + json.dumps(GOOD).encode()]


@pytest.mark.parametrize("as_text", [False, True])
def test_reasons(spark, as_text):
    raws = [r for r in RAW if not as_text or b"\xff" not in r]
    df = spark.createDataFrame([(i, "key", r.decode() if as_text else bytearray(r)) for i, r in enumerate(raws)], f"i int, kafka_key string, payload {'string' if as_text else 'binary'}")
    got = {r.i: r.reason for r in admit.decode_wire(df).collect()}
    assert {i: (r, got[i]) for i, r in enumerate(raws) if got[i] != brute(r)} == {}


def test_null_payload_routes_and_laterals(spark):
    df = spark.createDataFrame([("k", None), (None, bytearray(b"{")), ("k", bytearray(json.dumps(GOOD).encode())), ("k", bytearray(json.dumps(GOOD | {"ingestion_time": "2026-01-05T11:00:00Z"}).encode()))], "kafka_key string, payload binary")
    routed = admit.decode_wire(df)
    assert {r.route: r.n for r in routed.groupBy("route").count().withColumnRenamed("count", "n").collect()} == {"quarantine": 2, "main": 1, "too_late": 1}
    assert sorted((r.key, r.reason) for r in admit.quarantined(routed).collect()) == [("", "invalid_json"), ("k", "invalid_json")]
    late = admit.too_late(routed).first()
    assert (late.key, late.reason, late.event_lag_seconds, late.event_id) == ("a1", "dropped_by_horizon", 3600.0, "e1")
    main = admit.admitted(routed).first()
    assert (main.stream, main.unit, main.value, main.lag_s) == ("motor_current", "A", 1.5, 60.0)


def test_details_name_the_cause(spark):
    df = spark.createDataFrame([(None, bytearray(json.dumps(c).encode())) for c in ({}, GOOD | {"schema_version": 3}, GOOD | {"value": "abc"})], "kafka_key string, payload binary")
    assert sorted(r.detail for r in admit.decode_wire(df).collect()) == ["missing_field: schema_version", "non_finite_value: abc", "unsupported_schema_version: 3"]


def test_encoding_round_trip(spark):
    rows = spark.createDataFrame([("a1", "type", "e1", "2026-01-05T10:00:00Z", "2026-01-05T10:01:00Z", 1, None, 1.5, "motor_current", "Motor_current", "A")], "asset_id string, asset_type string, event_id string, event_time string, ingestion_time string, schema_version int, source_event_time string, value double, stream string, channel string, unit string")
    text = rows.select(admit.encode_event(rows).alias("t")).first().t
    assert text.startswith('{"asset_id":"a1","asset_type":"type","event_id"') and json.loads(text)["sensor"]["unit"] == "A"
    again = admit.decode_wire(spark.createDataFrame([("k", text)], "kafka_key string, payload string")).first()
    assert again.route == "main" and again.value == 1.5
    record = admit.kafka_record(spark.createDataFrame([(None, "x")], "b string, a string"), admit.lateral_key("a", "b")).first()
    assert (bytes(record.key), bytes(record.value)) == (b"x", b'{"a":"x","b":null}')


def test_columns_empty_and_nulls(spark):
    schema = "event_id string, asset_id string, stream string, value double, event_time timestamp, ingestion_time timestamp, route string"
    df = spark.createDataFrame([("e", "a", "h1_pressure", 1.0, T0, T0, "mine"), (None, "a", "h1_pressure", 1.0, T0, T0, ""), ("e", "a", None, 1.0, T0, T0, ""), ("e", "a", "h1_pressure", None, T0, T0, "")], schema)
    assert sorted(str(r.reason) for r in admit.admit_columns(df).collect()) == ["None", "missing_field", "non_finite_value", "unknown_stream"]
    assert admit.route_counts(admit.admit_columns(df.where("false"))).collect() == []
