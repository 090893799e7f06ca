"""Queries of the engine's own operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.numeric import round4
from tidewatch.functions.timestamps import format_iso, parse_iso
from tidewatch.operators import admit, aggregates, cdc, prepare, serving
from tidewatch.sources import replay as replays

Query = Callable[[SparkSession, str], DataFrame]
REPLAY_START = datetime(2026, 1, 1, tzinfo=timezone.utc)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ("delivery_id", "event_id", "asset_id", "stream", "unit", "value", "event_time", "ingestion_time")
    return table(spark, sf_dir, "sensor_readings").select(*cols)


def in_windows(spark: SparkSession, sf_dir: str, seconds: int) -> DataFrame:
    """Admitted readings in windows, each message once per window."""
    main = admit.admitted(admit.admit_columns(readings(spark, sf_dir))).drop("lag_s")
    return aggregates.dedup_in_window(aggregates.windowed(main, seconds), "delivery_id")


def wire(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admit.decode_wire(table(spark, sf_dir, "wire_records"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All panes that were sent, deletes left out."""
    return table(spark, sf_dir, "aggregates").where(~cdc.is_delete("op"))


def feed(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """All changes in columns ``cols``, with ``deleted`` true for deletes."""
    return table(spark, sf_dir, "aggregates").select("aggregate_id", "pane_index", "change_id", *cols, cdc.is_delete("op").alias("deleted"))


def served(state: DataFrame) -> DataFrame:
    """What a reader of the serving table sees: no tombstones."""
    return state.where("NOT deleted").drop("deleted")


def serving_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ("metric_type", "asset_id", "stream", "window_start", "window_end", "pane_timing", "is_last", "value_mean", "value_min", "value_max", "running_ratio", "oil_temperature_mean", "air_leak_suspected")
    return served(serving.latest_panes(feed(spark, sf_dir, *cols), "change_id"))


def expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the segments say of an asset: whether most of its sessions are labelled as a fault."""
    labels = table(spark, sf_dir, "fleet_segments").distinct()
    fault = F.count_if(F.col("condition_label") != "sano")
    return labels.groupBy("asset_id").agg((fault * 2 > F.count("*")).alias("expected_air_leak"))


# --- the queries -------------------------------------------------------------------------------------


def admit_reasons(spark, sf_dir):
    return admit.route_counts(admit.admit_columns(readings(spark, sf_dir)))


def admit_wire(spark, sf_dir):
    return admit.route_counts(wire(spark, sf_dir))


def quarantine_records(spark, sf_dir):
    return admit.quarantined(wire(spark, sf_dir))


def too_late_wire(spark, sf_dir):
    return admit.too_late(wire(spark, sf_dir))


def too_late_records(spark, sf_dir):
    routed = admit.admit_columns(table(spark, sf_dir, "sensor_readings").select("delivery_id", "event_id", "asset_id", "stream", "value", "event_time", "ingestion_time", "kafka_key"))
    late = routed.where(F.col("route") == admit.TOO_LATE)
    return late.select("delivery_id", "event_id", admit.lateral_key().alias("key"), F.col("lag_s").alias("event_lag_seconds"))


def flatten_wire(spark, sf_dir):
    main = admit.admitted(wire(spark, sf_dir))
    return main.select("wire_id", "schema_version", "event_id", "asset_id", "asset_type", "stream", "channel", "unit", "value", format_iso("event_time").alias("event_time"), format_iso("ingestion_time").alias("ingestion_time"), "source_event_time", "kafka_key")


def encode_readings(spark, sf_dir):
    """The wire form of every delivery, as the text of its key and value."""
    rows = table(spark, sf_dir, "sensor_readings").withColumns({"event_time": format_iso("event_time"), "ingestion_time": format_iso("ingestion_time")})
    sent = admit.kafka_record(rows.select("delivery_id", "asset_id", admit.encode_event(rows).alias("event")), F.coalesce("asset_id", F.lit("")))
    return sent.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def dedup_counts(spark, sf_dir):
    main = aggregates.windowed(admit.admitted(admit.admit_columns(readings(spark, sf_dir))), 300)
    each = main.groupBy("asset_id", "w", "event_id").agg(F.count("*").alias("n"))
    return each.groupBy("asset_id").agg(F.sum("n").alias("admitted"), F.count("*").alias("kept"), F.sum(F.col("n") - 1).alias("duplicates_dropped"))


def _signal(seconds: int) -> Query:
    return lambda spark, sf_dir: aggregates.formatted(aggregates.signal_stats(in_windows(spark, sf_dir, seconds)), metric_type=aggregates.SIGNAL_STATS)


def _health(seconds: int) -> Query:
    return lambda spark, sf_dir: aggregates.formatted(aggregates.health_indicator(in_windows(spark, sf_dir, seconds)), metric_type=aggregates.HEALTH)


def combined_aggregates(spark, sf_dir):
    return aggregates.formatted(aggregates.both(in_windows(spark, sf_dir, 300)))


def empty_stats(spark, sf_dir):
    return aggregates.empty_stats(readings(spark, sf_dir).where("false"))


def unpivot_wide(spark, sf_dir):
    long = prepare.unpivot(table(spark, sf_dir, "wide_readings"))
    return long.select("schema_version", "event_id", "asset_id", "stream", "channel", "unit", "value", "source_event_time", format_iso("event_time").alias("event_time"), format_iso("ingestion_time").alias("ingestion_time"))


def unpivot_v1(spark, sf_dir):
    return prepare.unpivot(table(spark, sf_dir, "wide_readings"), version=1).groupBy("stream").agg(F.count("*").alias("readings"), F.count_distinct("asset_id").alias("assets"))


def registry_join(spark, sf_dir):
    """Readings by what the registry says of their channel, in whatever spelling it came."""
    reg = table(spark, sf_dir, "stream_registry").select(F.lower("channel").alias("r_channel"), F.col("stream").alias("r_stream"), F.col("unit").alias("r_unit"), "schema_version")
    sent = table(spark, sf_dir, "sensor_readings").select("stream", F.lower(F.trim("channel")).alias("c"))
    joined = sent.join(reg, F.col("c") == F.col("r_channel"), "left")
    return joined.groupBy("r_stream", "r_unit").agg(F.count("*").alias("readings"), F.count_if(F.col("stream") == F.col("r_stream")).alias("agreeing"))


def segment_range_join(spark, sf_dir):
    rows = prepare.in_segments(table(spark, sf_dir, "wide_readings"), table(spark, sf_dir, "fleet_segments"))
    known = lambda c: F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c)
    return rows.select("asset_id", "source_event_time", "condition_label", "failure_ref", known("motor_current"), known("oil_temperature"))


def segment_row_counts(spark, sf_dir):
    return prepare.segment_counts(table(spark, sf_dir, "wide_readings"), table(spark, sf_dir, "fleet_segments"))


def _wide_at(spark, sf_dir):
    return table(spark, sf_dir, "wide_readings").withColumn("at", parse_iso("source_event_time"))


def first_minutes(spark, sf_dir):
    return prepare.first_minutes(_wide_at(spark, sf_dir), 5).select("asset_id", "source_event_time", "tp2", "h1")


def first_assets(spark, sf_dir):
    return prepare.first_assets(_wide_at(spark, sf_dir), 3).groupBy("asset_id").agg(F.count("*").alias("rows"))


def asset_span(spark, sf_dir):
    return prepare.asset_span(_wide_at(spark, sf_dir))


def latest_pane(spark, sf_dir):
    return serving_table(spark, sf_dir).select("aggregate_id", "pane_index", "change_id", "metric_type", "running_ratio", "value_mean")


def upsert_twice(spark, sf_dir):
    """The first half of the feed stored, then all of it upserted: as if it had come once."""
    cols = feed(spark, sf_dir, "metric_type")
    half = cols.agg(F.percentile_approx("change_id", 0.5).alias("half_id"))
    first = cols.join(F.broadcast(half), F.col("change_id") <= F.col("half_id"), "left_semi")
    return served(serving.upsert(serving.latest_panes(first, "change_id"), cols, "change_id"))


def upsert_applied(spark, sf_dir):
    """How many of all changes are taken and how many rejected, as they come one after the other."""
    cols = history(spark, sf_dir).select("aggregate_id", "pane_index", "change_id")
    return serving.applied_in_order(cols, "change_id").groupBy("applied").agg(F.count("*").alias("changes"))


def upsert_verdicts(spark, sf_dir):
    """Every change, deletes too, and whether it is taken."""
    return serving.applied_in_order(feed(spark, sf_dir), "change_id").select("change_id", "aggregate_id", "pane_index", "applied")


def serving_rows(spark, sf_dir):
    return serving.serving_rows(history(spark, sf_dir))


def count_by_metric(spark, sf_dir):
    return serving.count_by_metric(serving_table(spark, sf_dir))


def multi_pane_ids(spark, sf_dir):
    return serving.multi_pane_ids(history(spark, sf_dir))


def pane_timeline(spark, sf_dir):
    return serving.pane_timeline(history(spark, sf_dir))


def pane_marks(spark, sf_dir):
    """Every pane of the history and whether it is its aggregate's first or last."""
    return aggregates.panes(history(spark, sf_dir).select("change_id", "aggregate_id", "pane_index"))


def health_table(spark, sf_dir):
    return serving.health_table(serving_table(spark, sf_dir))


def health_last(spark, sf_dir):
    return serving.health_rows(serving_table(spark, sf_dir), only_last=True).select("aggregate_id", "asset_id", "running_ratio")


def motor_series(spark, sf_dir):
    return serving.stream_series(serving_table(spark, sf_dir))


def last_200(spark, sf_dir):
    return serving.last_rows(serving_table(spark, sf_dir), 200).select("aggregate_id", "window_start", "value_mean")


def fleet_verdict(spark, sf_dir):
    return serving.fleet_verdict(serving.health_rows(serving_table(spark, sf_dir)))


def verdict_checked(spark, sf_dir):
    return serving.checked_verdict(fleet_verdict(spark, sf_dir), expected(spark, sf_dir))


def unexpected_assets(spark, sf_dir):
    """Assets with a verdict that are not among those expected to leak."""
    return serving.unexpected_assets(fleet_verdict(spark, sf_dir), expected(spark, sf_dir).where("expected_air_leak"))


def fleet_checks(spark, sf_dir):
    verdict, want = fleet_verdict(spark, sf_dir), expected(spark, sf_dir)
    return serving.fleet_checks(serving.checked_verdict(verdict, want), serving.unexpected_assets(verdict, want))


def verdict_report(spark, sf_dir):
    return serving.text_report(verdict_checked(spark, sf_dir))


def top_readings(spark, sf_dir):
    """The 50 highest finite readings in a fixed order."""
    rows = readings(spark, sf_dir).where("value < double('infinity') AND value = value AND NOT isnan(value)")
    return rows.orderBy(F.col("value").desc(), "delivery_id").limit(50).select("delivery_id", "asset_id", "stream", "value")


def distinct_keys(spark, sf_dir):
    """Union of the assets of three tables."""
    of = lambda n: table(spark, sf_dir, n).select("asset_id")
    return of("sensor_readings").union(of("wide_readings")).union(of("fleet_segments")).distinct()


def key_differences(spark, sf_dir):
    """Signal windows that only the readings or only the change feed have."""
    made = _signal(300)(spark, sf_dir).select("aggregate_id")
    kept = serving_table(spark, sf_dir).where(F.col("metric_type") == aggregates.SIGNAL_STATS)
    return serving.key_differences(made, kept, "aggregate_id").groupBy("side").agg(F.count("*").alias("keys"))


def _replayed(spark, sf_dir):
    return replays.replay(prepare.unpivot(table(spark, sf_dir, "wide_readings").distinct(), version=1), replays.SCENARIOS["adverse"], seed=7, target_start=REPLAY_START)


def replay_counts(spark, sf_dir):
    return replays.fault_counts(_replayed(spark, sf_dir))


def replay_events(spark, sf_dir):
    return _replayed(spark, sf_dir).select("event_id", "value", "fault", "copy", format_iso("event_time").alias("event_time"), format_iso("ingestion_time").alias("ingestion_time"), round4("delivery_s").alias("delivery_s"))


def iso_times(spark, sf_dir):
    rows = table(spark, sf_dir, "sensor_readings")
    return rows.select("delivery_id", F.unix_millis(parse_iso("source_event_time")).alias("source_ms"), format_iso("ingestion_time").alias("ingestion_iso"))


def stream_signal_stats(spark, sf_dir):
    """Windows and their statistics by the streaming job with panes, run to its source's end."""
    from tidewatch.streaming import pipeline

    stats = pipeline.run_to_end(spark, f"{sf_dir}/sensor_readings.parquet").where("readings IS NOT NULL")
    return stats.select("aggregate_id", "readings", "value_mean", "value_min", "value_max", "value_stddev")


def stream_panes(spark, sf_dir):
    """Panes of every window's signals and health in the order the feed was ingested: early, on time, late and last."""
    from tidewatch.streaming import pipeline

    return pipeline.replay_panes(readings(spark, sf_dir))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _health(3600)(spark, sf_dir)


def queries() -> dict[str, Query]:
    own = (admit_reasons, admit_wire, quarantine_records, too_late_wire, too_late_records, flatten_wire, encode_readings, dedup_counts, combined_aggregates, empty_stats, unpivot_wide, unpivot_v1, registry_join, segment_range_join, segment_row_counts, first_minutes, first_assets, asset_span, latest_pane, upsert_twice, upsert_applied, upsert_verdicts, serving_rows, count_by_metric, multi_pane_ids, pane_timeline, pane_marks, health_table, health_last, motor_series, last_200, fleet_verdict, verdict_checked, unexpected_assets, fleet_checks, verdict_report, top_readings, distinct_keys, key_differences, replay_counts, replay_events, iso_times, stream_signal_stats, stream_panes)
    named = {"health_indicator_1h": flagship, "health_indicator_5m": _health(300), "signal_stats_5m": _signal(300), "signal_stats_1h": _signal(3600)}
    return named | {f.__name__: f for f in own}


# --- the SQL -----------------------------------------------------------------------------------------


def r4(x: str) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(30, 10)), 4) AS DOUBLE)"


STREAM_LIST = "('motor_current', 'oil_temperature', 'tp2_pressure', 'dv_pressure', 'tp3_pressure', 'h1_pressure', 'reservoirs_pressure')"
ROUTED = f"""routed AS (SELECT *, (epoch_us(ingestion_time) - epoch_us(event_time)) / 1e6 AS lag_s,
  CASE WHEN event_id IS NULL OR asset_id IS NULL OR event_time IS NULL OR ingestion_time IS NULL THEN 'missing_field'
       WHEN stream IS NULL OR stream NOT IN {STREAM_LIST} THEN 'unknown_stream'
       WHEN value IS NULL OR NOT isfinite(value) THEN 'non_finite_value'
       WHEN event_time > ingestion_time THEN 'future_event_time'
       WHEN epoch_us(ingestion_time) - epoch_us(event_time) > 86400000000 THEN 'stale_event_time'
       WHEN epoch_us(ingestion_time) - epoch_us(event_time) > 720000000 THEN 'dropped_by_horizon' END AS reason FROM sensor_readings)"""


def windows(seconds: int) -> str:
    return f"""{ROUTED}, deduped AS (SELECT * FROM (
  SELECT *, epoch_us(event_time) // {seconds * 1_000_000} * {seconds} AS ws,
    row_number() OVER (PARTITION BY asset_id, epoch_us(event_time) // {seconds * 1_000_000}, event_id ORDER BY ingestion_time, value, delivery_id) AS rn
  FROM routed WHERE reason IS NULL) WHERE rn = 1)"""


def iso(seconds: str) -> str:
    return f"strftime(make_timestamp(CAST({seconds} AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%SZ')"


def iso_us(us: str) -> str:
    return f"strftime(make_timestamp({us}), '%Y-%m-%dT%H:%M:%S') || CASE WHEN ({us}) % 1000000 = 0 THEN '' ELSE '.' || lpad(CAST(({us}) % 1000000 AS VARCHAR), 6, '0') END || 'Z'"


def parsed(col: str) -> str:
    """Microseconds of ISO-8601 text, null where it is no time."""
    text = f"trim({col})"
    return f"epoch_us(TRY_CAST(CASE WHEN NOT regexp_matches({text}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}([T ].*)?$') THEN NULL WHEN regexp_matches(substr({text}, 11), '(Z|z|[+-]\\d{{2}}:?\\d{{2}})$') THEN {text} ELSE {text} || 'Z' END AS TIMESTAMPTZ))"


def times(seconds: int) -> str:
    return f"{iso('ws')} AS window_start, {iso(f'ws + {seconds}')} AS window_end, {iso(f'ws + {seconds} + 720')} AS corrections_close_at"


STATS = f"count(*) AS readings, {r4('avg(value)')} AS value_mean, {r4('min(value)')} AS value_min, {r4('max(value)')} AS value_max, {r4('stddev_pop(value)')} AS value_stddev"
MOTOR = "count(*) FILTER (WHERE stream = 'motor_current')"
SHARE = f"coalesce(count(*) FILTER (WHERE stream = 'motor_current' AND value >= 1.0) / nullif({MOTOR}, 0), 0.0)"
OIL = "coalesce(avg(value) FILTER (WHERE stream = 'oil_temperature'), 0.0)"
INDICATOR = f"{MOTOR} AS motor_readings, {r4(SHARE)} AS running_ratio, {r4(OIL)} AS oil_temperature_mean, {SHARE} >= 0.95 AND {OIL} >= 70.0 AS air_leak_suspected"


def signal_sql(seconds: int) -> str:
    return f"""WITH {windows(seconds)} SELECT 'apu_signal_stats|' || asset_id || '|' || stream || '|' || {iso('ws')} AS aggregate_id, 'apu_signal_stats' AS metric_type,
  asset_id, stream, unit, {times(seconds)}, {STATS} FROM deduped GROUP BY asset_id, stream, unit, ws"""


def health_sql(seconds: int) -> str:
    return f"""WITH {windows(seconds)} SELECT 'apu_health_indicator|' || asset_id || '|' || {iso('ws')} AS aggregate_id, 'apu_health_indicator' AS metric_type,
  asset_id, {times(seconds)}, {INDICATOR} FROM deduped GROUP BY asset_id, ws"""


DELETE = "coalesce(lower(trim(op)) IN ('d', 'del', 'delete', 'remove'), false)"
HISTORY = f"history AS (SELECT * FROM aggregates WHERE NOT {DELETE})"
SERVED = f"""{HISTORY}, served AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY aggregate_id ORDER BY pane_index DESC, change_id DESC) AS rn FROM aggregates) WHERE rn = 1 AND NOT {DELETE})"""
VERDICT = f"""{SERVED}, verdict AS (SELECT asset_id, count(*) AS windows, count(*) FILTER (WHERE air_leak_suspected) AS flagged_windows, {r4('avg(running_ratio)')} AS running_ratio,
  {r4('avg(oil_temperature_mean)')} AS oil_temperature_mean, count(*) FILTER (WHERE air_leak_suspected) * 2 > count(*) AS air_leak_suspected
  FROM served WHERE metric_type = 'apu_health_indicator' GROUP BY asset_id)"""
EXPECTED = """expected AS (SELECT asset_id, count(*) FILTER (WHERE condition_label <> 'sano') * 2 > count(*) AS expected_air_leak
  FROM (SELECT DISTINCT * FROM fleet_segments) GROUP BY asset_id)"""
CHECKED = """checked AS (SELECT e.asset_id, expected_air_leak, air_leak_suspected AS observed_air_leak, windows, flagged_windows,
  air_leak_suspected IS NOT DISTINCT FROM expected_air_leak AS ok FROM expected e LEFT JOIN verdict v ON e.asset_id = v.asset_id)"""
WIDE = f"wide AS (SELECT *, {parsed('source_event_time')} AS us FROM wide_readings)"
SEGMENTS = f"""segments AS (SELECT DISTINCT asset_id, {parsed('starts_at')} AS s_from, {parsed('ends_at')} AS s_to, condition_label, failure_ref FROM fleet_segments)"""


def long_sql(source: str, version: int) -> str:
    cells = [("motor_current", "Motor_current", "A", 1), ("oil_temperature", "Oil_temperature", "degC", 1), ("tp2_pressure", "TP2", "bar", 1), ("dv_pressure", "DV_pressure", "bar", 1), ("tp3_pressure", "TP3", "bar", 2), ("h1_pressure", "H1", "bar", 2), ("reservoirs_pressure", "Reservoirs", "bar", 2)]
    return "long AS (" + " UNION ALL ".join(f"SELECT asset_id, us, '{s}' AS stream, '{c}' AS channel, '{u}' AS unit, {c.lower()} AS value FROM {source} WHERE us IS NOT NULL AND {c.lower()} IS NOT NULL AND isfinite({c.lower()})" for s, c, u, v in cells if v <= version) + ")"


def _uniform(seed: int) -> str:
    return f"(CAST('0x' || substr(md5('{seed}|' || event_id), 1, 13) AS BIGINT) / 4503599627370496.0)"


REPLAYED = f"""wide AS (SELECT DISTINCT *, {parsed('source_event_time')} AS us FROM wide_readings), {long_sql('wide', 1)},
  named AS (SELECT *, asset_id || '|' || stream || '|' || {iso_us('us')} AS event_id FROM long),
  drawn AS (SELECT *, (us - min(us) OVER (PARTITION BY asset_id)) / 1e6 AS offset_s, {_uniform(7)} AS roll, {_uniform(8)} AS again FROM named),
  faulted AS (SELECT *, CASE WHEN roll < 0.005 THEN 'too_late' WHEN roll < 0.005 + 0.02 THEN 'late' WHEN roll < 0.005 + 0.02 + 0.05 THEN 'out_of_order' ELSE 'none' END AS fault FROM drawn),
  lagged AS (SELECT *, CASE fault WHEN 'too_late' THEN 1800 WHEN 'late' THEN 300 WHEN 'out_of_order' THEN 60 ELSE 0 END AS lag, {int(REPLAY_START.timestamp()) * 1_000_000} + CAST(offset_s * 1000000 AS BIGINT) AS event_us FROM faulted),
  copied AS (SELECT *, unnest(CASE WHEN again < 0.02 THEN [0, 1] ELSE [0] END) AS copy FROM lagged)"""


def _wire_cte() -> str:
    number = "CASE json_type(o, '$.value') WHEN 'BOOLEAN' THEN CASE o->>'$.value' WHEN 'true' THEN 1.0 ELSE 0.0 END ELSE TRY_CAST(o->>'$.value' AS DOUBLE) END"
    missing = " ".join(f"WHEN NOT json_exists(o, '$.{k}') THEN '{k}'" for k in ("schema_version", "event_id", "asset_id", "sensor", "value", "event_time", "ingestion_time"))
    return f"""texts AS (SELECT *, TRY(decode(payload)) AS txt FROM wire_records),
objects AS (SELECT *, CASE WHEN txt IS NOT NULL AND json_valid(txt) AND json_type(txt) = 'OBJECT' THEN CAST(txt AS JSON) END AS o FROM texts),
fields AS (SELECT *, CASE {missing} END AS missing, o->>'$.sensor.stream' AS stream, {number} AS num, {parsed("(o->>'$.event_time')")} AS e_us, {parsed("(o->>'$.ingestion_time')")} AS i_us FROM objects),
judged AS (SELECT *, CASE WHEN o IS NULL THEN 'invalid_json' WHEN missing IS NOT NULL THEN 'missing_field'
  WHEN NOT coalesce((json_type(o, '$.schema_version') IN ('UBIGINT', 'BIGINT') AND o->>'$.schema_version' IN ('1', '2')) OR o->>'$.schema_version' = 'true', false) THEN 'unsupported_schema_version'
  WHEN stream IS NULL OR stream NOT IN {STREAM_LIST} THEN 'unknown_stream' WHEN num IS NULL OR NOT isfinite(num) THEN 'non_finite_value'
  WHEN e_us IS NULL OR i_us IS NULL THEN 'invalid_timestamp' WHEN e_us > i_us THEN 'future_event_time' WHEN i_us - e_us > 86400000000 THEN 'stale_event_time'
  WHEN i_us - e_us > 720000000 THEN 'dropped_by_horizon' END AS reason FROM fields)"""


def oracle_sql() -> dict[str, str]:
    return {
        "health_indicator_1h": health_sql(3600),
        "health_indicator_5m": health_sql(300),
        "signal_stats_5m": signal_sql(300),
        "signal_stats_1h": signal_sql(3600),
        "admit_reasons": f"WITH {ROUTED} SELECT CASE WHEN reason IS NULL THEN 'main' WHEN reason = 'dropped_by_horizon' THEN 'too_late' ELSE 'quarantine' END AS route, coalesce(reason, '') AS reason, count(*) AS records FROM routed GROUP BY ALL",
        "admit_wire": f"WITH {_wire_cte()} SELECT CASE WHEN reason IS NULL THEN 'main' WHEN reason = 'dropped_by_horizon' THEN 'too_late' ELSE 'quarantine' END AS route, coalesce(reason, '') AS reason, count(*) AS records FROM judged GROUP BY ALL",
        "flatten_wire": f"""WITH {_wire_cte()} SELECT wire_id, CAST(CASE o->>'$.schema_version' WHEN 'true' THEN '1' ELSE o->>'$.schema_version' END AS INTEGER) AS schema_version, o->>'$.event_id' AS event_id, o->>'$.asset_id' AS asset_id, o->>'$.asset_type' AS asset_type,
  coalesce(o->>'$.stream', stream) AS stream, coalesce(o->>'$.channel', o->>'$.sensor.channel') AS channel, coalesce(o->>'$.unit', o->>'$.sensor.unit') AS unit, num AS value, {iso_us('e_us')} AS event_time, {iso_us('i_us')} AS ingestion_time,
  o->>'$.source_event_time' AS source_event_time, kafka_key FROM judged WHERE reason IS NULL""",
        "too_late_wire": f"WITH {_wire_cte()} SELECT coalesce(nullif(o->>'$.asset_id', ''), nullif(kafka_key, ''), '') AS key, reason, o->>'$.event_id' AS event_id, o->>'$.asset_id' AS asset_id, (i_us - e_us) / 1e6 AS event_lag_seconds, txt AS payload, kafka_key FROM judged WHERE reason = 'dropped_by_horizon'",
        "too_late_records": f"WITH {ROUTED} SELECT delivery_id, event_id, coalesce(nullif(asset_id, ''), nullif(kafka_key, ''), '') AS key, lag_s AS event_lag_seconds FROM routed WHERE reason = 'dropped_by_horizon'",
        "dedup_counts": f"WITH {ROUTED} SELECT asset_id, CAST(sum(n) AS BIGINT) AS admitted, count(*) AS kept, CAST(sum(n - 1) AS BIGINT) AS duplicates_dropped FROM (SELECT asset_id, epoch_us(event_time) // 300000000 AS ws, event_id, count(*) AS n FROM routed WHERE reason IS NULL GROUP BY ALL) GROUP BY asset_id",
        "combined_aggregates": f"""WITH {windows(300)} SELECT 'apu_signal_stats|' || asset_id || '|' || stream || '|' || {iso('ws')} AS aggregate_id, 'apu_signal_stats' AS metric_type, asset_id, stream, unit, {times(300)}, {STATS},
  CAST(NULL AS BIGINT) AS motor_readings, CAST(NULL AS DOUBLE) AS running_ratio, CAST(NULL AS DOUBLE) AS oil_temperature_mean, CAST(NULL AS BOOLEAN) AS air_leak_suspected FROM deduped GROUP BY asset_id, stream, unit, ws
UNION ALL SELECT 'apu_health_indicator|' || asset_id || '|' || {iso('ws')}, 'apu_health_indicator', asset_id, NULL, NULL, {times(300)}, NULL, NULL, NULL, NULL, NULL, {INDICATOR} FROM deduped GROUP BY asset_id, ws""",
        "empty_stats": "SELECT CAST(0 AS BIGINT) AS readings, CAST(0.0 AS DOUBLE) AS value_mean, CAST(NULL AS DOUBLE) AS value_min, CAST(NULL AS DOUBLE) AS value_max, CAST(0.0 AS DOUBLE) AS value_stddev",
        "unpivot_wide": f"WITH {WIDE}, {long_sql('wide', 2)} SELECT CAST(2 AS INTEGER) AS schema_version, asset_id || '|' || stream || '|' || {iso_us('us')} AS event_id, asset_id, stream, channel, unit, value, {iso_us('us')} AS source_event_time, {iso_us('us')} AS event_time, {iso_us('us')} AS ingestion_time FROM long",
        "unpivot_v1": f"WITH {WIDE}, {long_sql('wide', 1)} SELECT stream, count(*) AS readings, count(DISTINCT asset_id) AS assets FROM long GROUP BY stream",
        "registry_join": "SELECT r.stream AS r_stream, r.unit AS r_unit, count(*) AS readings, count(*) FILTER (WHERE s.stream = r.stream) AS agreeing FROM sensor_readings s LEFT JOIN stream_registry r ON lower(trim(s.channel)) = lower(r.channel) GROUP BY ALL",
        "segment_range_join": f"WITH {WIDE}, {SEGMENTS} SELECT w.asset_id, source_event_time, condition_label, failure_ref, CASE WHEN NOT isnan(motor_current) THEN motor_current END AS motor_current, CASE WHEN NOT isnan(oil_temperature) THEN oil_temperature END AS oil_temperature FROM wide w JOIN segments s ON w.asset_id = s.asset_id AND us >= s_from AND us < s_to",
        "segment_row_counts": f"WITH {WIDE}, {SEGMENTS} SELECT w.asset_id, {iso_us('s_from')} AS starts_at, condition_label, count(*) AS rows FROM wide w JOIN segments s ON w.asset_id = s.asset_id AND us >= s_from AND us < s_to GROUP BY ALL",
        "first_minutes": f"WITH {WIDE} SELECT asset_id, source_event_time, tp2, h1 FROM (SELECT *, min(us) OVER (PARTITION BY asset_id) AS start_us FROM wide) WHERE us < start_us + 300000000",
        "first_assets": "SELECT asset_id, count(*) AS rows FROM wide_readings WHERE asset_id IN (SELECT DISTINCT asset_id FROM wide_readings ORDER BY asset_id LIMIT 3) GROUP BY asset_id",
        "asset_span": f"WITH {WIDE} SELECT asset_id, {iso_us('min(us)')} AS first_time, {iso_us('max(us)')} AS last_time, (max(us) - min(us)) / 1e6 AS duration_s FROM wide GROUP BY asset_id",
        "latest_pane": f"WITH {SERVED} SELECT aggregate_id, pane_index, change_id, metric_type, running_ratio, value_mean FROM served",
        "upsert_twice": f"WITH {SERVED} SELECT aggregate_id, pane_index, change_id, metric_type FROM served",
        "upsert_applied": f"""WITH {HISTORY}, judged AS (SELECT coalesce(pane_index >= max(pane_index) OVER (PARTITION BY aggregate_id ORDER BY change_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS applied FROM history)
SELECT applied, count(*) AS changes FROM judged GROUP BY applied""",
        "upsert_verdicts": """SELECT change_id, aggregate_id, pane_index, coalesce(pane_index >= max(pane_index) OVER (PARTITION BY aggregate_id ORDER BY change_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS applied FROM aggregates""",
        "count_by_metric": f"WITH {SERVED} SELECT count(*) AS aggregates, count(*) FILTER (WHERE metric_type = 'apu_signal_stats') AS signal_stats, count(*) FILTER (WHERE metric_type = 'apu_health_indicator') AS health_indicators FROM served",
        "multi_pane_ids": f"WITH {HISTORY} SELECT aggregate_id, count(DISTINCT pane_index) AS panes FROM history GROUP BY aggregate_id HAVING count(DISTINCT pane_index) > 1",
        "pane_timeline": f"WITH {HISTORY} SELECT aggregate_id, pane_index, pane_timing, window_start FROM history WHERE aggregate_id IN (SELECT aggregate_id FROM history GROUP BY aggregate_id HAVING count(DISTINCT pane_index) > 1)",
        "pane_marks": f"WITH {HISTORY} SELECT change_id, aggregate_id, pane_index, pane_index = min(pane_index) OVER w AS is_first, pane_index = max(pane_index) OVER w AS is_last FROM history WINDOW w AS (PARTITION BY aggregate_id)",
        "health_table": f"WITH {SERVED} SELECT asset_id, window_start, running_ratio, oil_temperature_mean, air_leak_suspected, pane_index, pane_timing FROM served WHERE metric_type = 'apu_health_indicator'",
        "health_last": f"WITH {SERVED} SELECT aggregate_id, asset_id, running_ratio FROM served WHERE metric_type = 'apu_health_indicator' AND is_last",
        "motor_series": f"WITH {SERVED} SELECT asset_id, window_start, value_mean, value_min, value_max FROM served WHERE metric_type = 'apu_signal_stats' AND stream = 'motor_current'",
        "last_200": f"WITH {SERVED} SELECT aggregate_id, window_start, value_mean FROM served WHERE metric_type = 'apu_signal_stats' ORDER BY window_start DESC, aggregate_id DESC LIMIT 200",
        "fleet_verdict": f"WITH {VERDICT} SELECT * FROM verdict",
        "verdict_checked": f"WITH {VERDICT}, {EXPECTED}, {CHECKED} SELECT * FROM checked",
        "unexpected_assets": f"WITH {VERDICT}, {EXPECTED} SELECT asset_id FROM verdict WHERE asset_id NOT IN (SELECT asset_id FROM expected WHERE expected_air_leak)",
        "fleet_checks": f"""WITH {VERDICT}, {EXPECTED}, {CHECKED} SELECT coalesce(bool_and(ok), true) AND (SELECT count(*) FROM verdict WHERE asset_id NOT IN (SELECT asset_id FROM expected)) = 0 AS ok,
  count(DISTINCT observed_air_leak) = 2 AS separation_observed, count(*) AS assets, (SELECT count(*) FROM verdict WHERE asset_id NOT IN (SELECT asset_id FROM expected)) AS unexpected FROM checked""",
        "verdict_report": f"WITH {VERDICT}, {EXPECTED}, {CHECKED} SELECT asset_id, format('{{:<10}} {{:<8}} {{:<8}} {{:>6}}', asset_id, coalesce(CAST(expected_air_leak AS VARCHAR), '-'), coalesce(CAST(observed_air_leak AS VARCHAR), '-'), coalesce(CAST(windows AS VARCHAR), '-')) AS line FROM checked",
        "top_readings": "SELECT delivery_id, asset_id, stream, value FROM sensor_readings WHERE value IS NOT NULL AND NOT isnan(value) AND value < 'infinity'::DOUBLE ORDER BY value DESC, delivery_id LIMIT 50",
        "distinct_keys": "SELECT asset_id FROM sensor_readings UNION SELECT asset_id FROM wide_readings UNION SELECT asset_id FROM fleet_segments",
        "key_differences": f"""WITH {windows(300)}, {SERVED}, made AS (SELECT DISTINCT 'apu_signal_stats|' || asset_id || '|' || stream || '|' || {iso('ws')} AS aggregate_id FROM deduped),
  kept AS (SELECT aggregate_id FROM served WHERE metric_type = 'apu_signal_stats')
SELECT side, count(*) AS keys FROM (SELECT 'missing' AS side, aggregate_id FROM (SELECT aggregate_id FROM made EXCEPT SELECT aggregate_id FROM kept) UNION ALL SELECT 'extra', aggregate_id FROM (SELECT aggregate_id FROM kept EXCEPT SELECT aggregate_id FROM made)) GROUP BY side""",
        "replay_counts": f"WITH {REPLAYED} SELECT count(*) AS events, count(*) FILTER (WHERE copy = 1) AS duplicates, " + ", ".join(f"count(*) FILTER (WHERE copy = 0 AND fault = '{f}') AS {f}" for f in ("out_of_order", "late", "too_late")) + " FROM copied",
        "replay_events": f"WITH {REPLAYED} SELECT event_id, value, fault, CAST(copy AS INTEGER) AS copy, {iso_us('event_us')} AS event_time, {iso_us('(event_us + lag * 1000000)')} AS ingestion_time, {r4('offset_s + lag')} AS delivery_s FROM copied",
        "iso_times": f"SELECT delivery_id, {parsed('source_event_time')} // 1000 AS source_ms, {iso_us('epoch_us(ingestion_time)')} AS ingestion_iso FROM sensor_readings",
        "stream_signal_stats": f"WITH {windows(300)} SELECT 'apu_signal_stats|' || asset_id || '|' || stream || '|' || {iso('ws')} AS aggregate_id, {STATS} FROM deduped GROUP BY asset_id, stream, ws",
        "stream_panes": panes_sql(),
        "quarantine_records": f"""WITH {_wire_cte()} SELECT coalesce(kafka_key, '') AS key, reason, CASE reason WHEN 'missing_field' THEN reason || ': ' || missing WHEN 'unsupported_schema_version' THEN reason || ': ' || coalesce(o->>'$.schema_version', 'null')
  WHEN 'unknown_stream' THEN reason || ': ' || coalesce(stream, 'null') WHEN 'non_finite_value' THEN reason || ': ' || coalesce(o->>'$.value', 'null') ELSE reason END AS detail, txt AS payload, kafka_key
  FROM judged WHERE reason IS NOT NULL AND reason <> 'dropped_by_horizon'""",
        "encode_readings": f"""WITH events AS (SELECT delivery_id, asset_id, {json_sql({"asset_id": "asset_id", "asset_type": "asset_type", "event_id": "event_id", "event_time": iso_us("epoch_us(event_time)"), "ingestion_time": iso_us("epoch_us(ingestion_time)"), "schema_version": "schema_version", "sensor": "{channel, stream, unit}", "source_event_time": "source_event_time", "value": "value"})} AS event FROM sensor_readings)
SELECT coalesce(asset_id, '') AS key, {json_sql({"asset_id": "asset_id", "delivery_id": "delivery_id", "event": "event"})} AS value FROM events""",
        "serving_rows": f"""WITH {HISTORY} SELECT aggregate_id, metric_type, asset_id, stream, window_start, window_end, pane_index, pane_timing, CAST(coalesce(is_last, false) AS INTEGER) AS is_last, {serving_json()} AS payload,
  coalesce(regexp_replace(strftime(emitted_at, '%Y-%m-%d %H:%M:%S.%f'), '\\.?0+$', ''), '') AS updated_at FROM history""",
    }


#: Columns of the change feed by kind.
FEED_TEXT = ("aggregate_id", "asset_id", "corrections_close_at", "metric_type", "op", "pane_timing", "stream", "unit", "window_end", "window_start")
FEED_WHOLE = ("change_id", "motor_readings", "pane_index", "readings", "schema_version", "is_first", "is_last", "air_leak_suspected")
FEED_NUMBER = ("oil_temperature_mean", "running_ratio", "value_max", "value_mean", "value_min", "value_stddev")
FEED_TIME = ("arrived_at", "emitted_at")


def json_sql(fields: dict[str, str]) -> str:
    """A JSON object with the fields in order; nulls are kept, numbers as Java writes them."""
    parts = []
    for name, x in sorted(fields.items()):
        if x == "{channel, stream, unit}":
            text = json_sql({"channel": "channel", "stream": "stream", "unit": "unit"})
        elif name in ("value", *FEED_NUMBER) and x != "event":
            text = f"CASE WHEN isnan({x}) THEN '\"NaN\"' WHEN isinf({x}) THEN CASE WHEN {x} > 0 THEN '\"Infinity\"' ELSE '\"-Infinity\"' END ELSE {java_double(x)} END"
        else:
            text = f"CAST(to_json({x}) AS VARCHAR)"
        parts.append(f"'\"{name}\":' || coalesce({text}, 'null')")
    return "('{' || " + " || ',' || ".join(parts) + " || '}')"


def java_double(x: str) -> str:
    """A finite double's text with Java's exponents: from 10**7 on and below 10**-3."""
    exponent = f"CAST(floor(log10(abs({x}))) AS INTEGER)"
    return f"CASE WHEN {x} = 0 OR (abs({x}) >= 1e-3 AND abs({x}) < 1e7) THEN CAST({x} AS VARCHAR) ELSE CAST(round({x} / pow(10.0, {exponent}), 15) AS VARCHAR) || 'E' || {exponent} END"


def serving_json() -> str:
    times = {c: f"strftime({c}, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'" for c in FEED_TIME}
    return json_sql({**{c: c for c in (*FEED_TEXT, *FEED_WHOLE, *FEED_NUMBER)}, **times})


def panes_sql() -> str:
    """Panes by the rule: early per step that changes a window before the watermark passes its end, on time then, late per step after, and the last again."""
    base = f"""{windows(300)}, units AS (SELECT d.* REPLACE (coalesce(d.unit, r.unit) AS unit), epoch_us(ingestion_time) // 10000000 AS step FROM deduped d LEFT JOIN stream_registry r ON d.stream = r.stream),
tops AS (SELECT epoch_us(ingestion_time) // 10000000 AS step, max(epoch_us(event_time) // 1000) AS top FROM routed WHERE reason IS NULL GROUP BY 1),
marks AS (SELECT step, greatest(coalesce(max(top) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 720000, 0), 0) AS mark, (SELECT max(top) FROM tops) - 720000 AS end_mark FROM tops),
arrived AS (SELECT *, (ws + 300) * 1000 AS closes, (ws + 300) * 1000 - 720000 AS due FROM units JOIN marks USING (step) WHERE mark < (ws + 300) * 1000)"""

    def kind(name: str, key: str, values: str) -> str:
        return f"""{name}_steps AS (SELECT DISTINCT {key}, step, mark, end_mark, closes, due, {values} FROM arrived WINDOW upto AS (PARTITION BY {key} ORDER BY step RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
{name}_numbered AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY step) AS i, count(*) FILTER (WHERE mark < due) OVER (PARTITION BY {key}) AS e, count(*) OVER (PARTITION BY {key}) AS n FROM {name}_steps),
{name}_panes AS (
  SELECT *, CASE WHEN mark < due OR (e = 0 AND i = 1) THEN i - 1 ELSE i END AS idx, CASE WHEN mark < due OR (e = 0 AND i = 1) THEN 'EARLY' ELSE 'LATE' END AS pane_timing, false AS is_last FROM {name}_numbered
  UNION ALL SELECT *, i, 'ON_TIME', false FROM {name}_numbered WHERE (e = 0 AND i = 1) OR (i = e AND (due <= end_mark OR e < n))
  UNION ALL SELECT *, i, CASE WHEN mark < due OR (e = 0 AND i = 1) THEN 'ON_TIME' ELSE 'LATE' END, true FROM {name}_numbered WHERE i = n AND closes <= end_mark)"""

    signal = kind("signal", "asset_id, stream, unit, ws", "count(*) OVER upto AS readings, avg(value) OVER upto AS a, min(value) OVER upto AS lo, max(value) OVER upto AS hi, stddev_pop(value) OVER upto AS sd")
    health = kind("health", "asset_id, ws", "count(*) FILTER (WHERE stream = 'motor_current') OVER upto AS motor, count(*) FILTER (WHERE stream = 'motor_current' AND value >= 1.0) OVER upto AS running, coalesce(avg(value) FILTER (WHERE stream = 'oil_temperature') OVER upto, 0.0) AS oil")
    pane = "CAST(idx AS INTEGER) AS pane_index, pane_timing, idx = 0 AS is_first, is_last"
    share = "coalesce(running / nullif(motor, 0), 0.0)"
    return f"""WITH {base}, {signal}, {health}
SELECT 'apu_signal_stats' AS metric_type, asset_id, stream, unit, ws AS window_s, {pane}, readings, {r4('a')} AS value_mean, {r4('lo')} AS value_min, {r4('hi')} AS value_max, {r4('sd')} AS value_stddev,
  CAST(NULL AS BIGINT) AS motor_readings, CAST(NULL AS DOUBLE) AS running_ratio, CAST(NULL AS DOUBLE) AS oil_temperature_mean, CAST(NULL AS BOOLEAN) AS air_leak_suspected FROM signal_panes
UNION ALL SELECT 'apu_health_indicator', asset_id, NULL, NULL, ws, {pane}, NULL, NULL, NULL, NULL, NULL, motor, {r4(share)}, {r4('oil')}, {share} >= 0.95 AND oil >= 70.0 FROM health_panes"""
