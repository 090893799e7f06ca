"""Contract validation and three-way routing of raw records, in one pass of native expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.config import EngineConfig
from tidewatch.functions.timestamps import lag_seconds, parse_iso
from tidewatch.operators.late import finite
from tidewatch.schema import REQUIRED, STREAM_NAMES, STREAMS

MAIN, QUARANTINE, TOO_LATE = "main", "quarantine", "too_late"
JSON = {"allowSingleQuotes": "false"}
NUMBER = r"^\s*[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+)?\s*$"


def first_of(rules: Sequence[tuple[str, Column, Column | None]]) -> tuple[Column, Column]:
    """Reason and detail of the first rule whose condition holds; both null where none does."""
    reason = F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for r, c, _ in rules])
    said = F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.concat_ws(": ", F.lit(r), d) if d is not None else F.lit(r)) for r, c, d in rules])
    return reason, said


def time_rules(event: Column, ingestion: Column, config: EngineConfig) -> list[tuple[str, Column, Column | None]]:
    return [("future_event_time", event > ingestion, None), ("stale_event_time", lag_seconds(event, ingestion) > config.stale_event_seconds, None)]


def decode_wire(records: DataFrame, payload: str = "payload", key: str = "kafka_key", config: EngineConfig = EngineConfig()) -> DataFrame:
    """Raw records with ``route``, ``reason``, ``detail``, ``lag_s``, ``payload_text`` and the event's fields.

    ``payload`` is text or bytes holding a JSON object. The first rule broken gives the reason: invalid_json,
    missing_field (the first in order), unsupported_schema_version (must be the JSON integer 1 or 2, or
    true, which counts as 1), unknown_stream, non_finite_value (numeric text is accepted),
    invalid_timestamp, future_event_time, stale_event_time: these go to ``quarantine``. Of the others, those
    later than the allowed lateness go to ``too_late`` and the rest to ``main``. A null or empty payload
    is no JSON; bytes that aren't UTF-8 neither, and show replacement signs in ``payload_text``; a field that
    is there but null counts as there. Additional fields are ignored here and stay in ``payload_text``.
    """
    raw = F.col(payload)
    is_text = dict(records.dtypes)[payload] == "string"
    text = raw if is_text else raw.cast("string")
    valid = F.is_valid_utf8(text)
    safe = F.make_valid_utf8(text)
    parsed = F.from_json(F.concat(F.lit("["), safe, F.lit("]")), "array<map<string,string>>", JSON)
    one = F.when(valid & (F.size(parsed) == 1) & safe.rlike(r"^\s*\{") & safe.rlike(r"\}\s*$"), parsed[0])
    with_map = records.withColumns({"payload_text": safe, "w_map": one})
    m = F.col("w_map")
    get = lambda k: F.element_at(m, F.lit(k))
    typed = lambda k, pattern: F.col("payload_text").rlike(rf'"{k}"\s*:\s*({pattern})\s*[,}}]')
    sensor = F.from_json(get("sensor"), "stream string, channel string, unit string", JSON)
    number = F.when(get("value").rlike(NUMBER), F.regexp_replace(F.trim(get("value")), "_", "").try_cast("double")).when(typed("value", "true"), F.lit(1.0)).when(typed("value", "false"), F.lit(0.0))
    fields = with_map.withColumns({
        "schema_version": F.when(typed("schema_version", "1|2|true"), F.when(get("schema_version") == "true", F.lit(1)).otherwise(get("schema_version").try_cast("int"))),
        "event_id": get("event_id"), "asset_id": get("asset_id"), "asset_type": get("asset_type"), "stream": F.coalesce(get("stream"), sensor["stream"]), "w_stream": sensor["stream"],
        "channel": F.coalesce(get("channel"), sensor["channel"]), "unit": F.coalesce(get("unit"), sensor["unit"]), "value": number,
        "event_time": parse_iso(get("event_time")), "ingestion_time": parse_iso(get("ingestion_time")), "source_event_time": get("source_event_time"),
    })
    missing = F.coalesce(*[F.when(~F.map_contains_key(m, F.lit(k)), F.lit(k)) for k in REQUIRED])
    e, i = F.col("event_time"), F.col("ingestion_time")
    reason, said = first_of([
        ("invalid_json", m.isNull(), None), ("missing_field", missing.isNotNull(), missing), ("unsupported_schema_version", F.col("schema_version").isNull(), F.coalesce(get("schema_version"), F.lit("null"))),
        ("unknown_stream", ~F.coalesce(F.col("w_stream").isin(*STREAM_NAMES), F.lit(False)), F.coalesce(F.col("w_stream"), F.lit("null"))), ("non_finite_value", ~finite("value"), F.coalesce(F.regexp_replace(get("value"), r'^"([+-]?\w+)"$', "$1"), F.lit("null"))),  # bare NaN comes in quotes
        ("invalid_timestamp", e.isNull() | i.isNull(), None), *time_rules(e, i, config),
    ])
    out = fields.withColumns({"reason": reason, "detail": said, "lag_s": lag_seconds(e, i)})
    return _routed(out, config).drop("w_map", "w_stream")


def admit_columns(readings: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """The same rules for readings that are columns already; adds ``route``, ``reason``, ``detail``, ``lag_s``.

    A null ``event_id``, ``asset_id``, ``event_time`` or ``ingestion_time`` is a missing field.
    """
    missing = F.coalesce(*[F.when(F.col(c).isNull(), F.lit(c)) for c in ("event_id", "asset_id", "event_time", "ingestion_time")])
    e, i = F.col("event_time"), F.col("ingestion_time")
    reason, said = first_of([("missing_field", missing.isNotNull(), missing), ("unknown_stream", ~F.coalesce(F.col("stream").isin(*STREAM_NAMES), F.lit(False)), F.col("stream")), ("non_finite_value", ~finite("value"), F.coalesce(F.col("value").cast("string"), F.lit("null"))), *time_rules(e, i, config)])
    return _routed(readings.withColumns({"reason": reason, "detail": said, "lag_s": lag_seconds(e, i)}), config)


def _routed(df: DataFrame, config: EngineConfig) -> DataFrame:
    late = F.col("lag_s") > config.allowed_lateness_seconds
    route = F.when(F.col("reason").isNotNull(), QUARANTINE).when(late, TOO_LATE).otherwise(MAIN)
    return df.withColumn("route", route).withColumn("reason", F.when(F.col("route") == TOO_LATE, F.lit("dropped_by_horizon")).otherwise(F.col("reason")))


def with_units(readings: DataFrame) -> DataFrame:
    """A null ``unit`` becomes the registry's unit of the stream, so that one window has one aggregate."""
    known = F.create_map(*[F.lit(x) for s in STREAMS for x in (s[0], s[2])])
    return readings.withColumn("unit", F.coalesce("unit", known[F.col("stream")]))


def lateral_key(asset: str = "asset_id", key: str = "kafka_key") -> Column:
    """Key of a quarantined or overdue record: asset, else transport key, else empty; empty text counts as none."""
    return F.coalesce(F.nullif(F.col(asset), F.lit("")), F.nullif(F.col(key), F.lit("")), F.lit(""))


def quarantined(routed: DataFrame) -> DataFrame:
    """``key`` and ``reason, detail, payload, kafka_key`` of the quarantined records."""
    return routed.where(F.col("route") == QUARANTINE).select(F.coalesce(F.nullif(F.col("kafka_key"), F.lit("")), F.lit("")).alias("key"), "reason", F.coalesce("detail", "reason").alias("detail"), F.col("payload_text").alias("payload"), "kafka_key")


def too_late(routed: DataFrame) -> DataFrame:
    """``key`` and ``reason, event_id, asset_id, event_lag_seconds, payload, kafka_key`` of the overdue records."""
    return routed.where(F.col("route") == TOO_LATE).select(lateral_key().alias("key"), "reason", "event_id", "asset_id", F.col("lag_s").alias("event_lag_seconds"), F.col("payload_text").alias("payload"), "kafka_key")


def admitted(routed: DataFrame) -> DataFrame:
    return routed.where(F.col("route") == MAIN).drop("route", "reason", "detail")


def route_counts(routed: DataFrame) -> DataFrame:
    """Counters of the router."""
    return routed.groupBy("route", F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count("*").alias("records"))


def canonical_json(cols: dict[str, Column]) -> Column:
    """JSON with keys in order and nothing between; a key whose value is null is kept."""
    return F.to_json(F.struct(*[cols[k].alias(k) for k in sorted(cols)]), {"ignoreNullFields": "false"})


def kafka_record(df: DataFrame, key: Column) -> DataFrame:
    """``key`` and ``value`` of any record frame."""
    cols = {c: F.col(c) for c in df.columns if c != "key"}
    return df.select(key.cast("binary").alias("key"), canonical_json(cols).cast("binary").alias("value"))


def encode_event(readings: DataFrame) -> Column:
    """The wire form of a reading."""
    sensor = F.struct(F.col("channel").alias("channel"), F.col("stream").alias("stream"), F.col("unit").alias("unit"))
    names = ("asset_id", "asset_type", "event_id", "event_time", "ingestion_time", "schema_version", "source_event_time", "value")
    return canonical_json({**{n: F.col(n) for n in names if n in readings.columns}, "sensor": sensor})

