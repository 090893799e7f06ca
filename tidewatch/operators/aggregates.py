"""Fixed event-time windows, per-window deduplication and the two aggregations over one deduplicated input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.config import EngineConfig
from tidewatch.functions.numeric import ratio, round4
from tidewatch.functions.timestamps import format_iso
from tidewatch.schema import HEALTH, SIGNAL_STATS

MOTOR, OIL = "motor_current", "oil_temperature"


def windowed(readings: DataFrame, seconds: int, time: str = "event_time") -> DataFrame:
    """Adds ``w``: the half-open, epoch-aligned window of the event time."""
    return readings.withColumn("w", F.window(time, f"{seconds} seconds"))


def dedup_in_window(readings: DataFrame, *tie: str) -> DataFrame:
    """One reading per asset, window and ``event_id``: the first to be ingested, then by value, then by ``tie``.

    Works on batches; the same identifier in another window or of another asset stays. A null identifier
    is an identifier like any other. Streams use ``dropDuplicates`` on the same key.
    """
    # min_by aggregates before the shuffle, so an identifier repeated without end sends one row per task
    others = [c for c in readings.columns if c not in ("asset_id", "w", "event_id")]
    first = F.min_by(F.struct(*others), F.struct(F.col("ingestion_time").isNull(), "ingestion_time", "value", *tie))
    return readings.groupBy("asset_id", "w", "event_id").agg(first.alias("kept")).select("asset_id", "w", "event_id", "kept.*")


def signal_metrics() -> list[Column]:
    """Count, mean, min, max and population deviation, rounded to four decimals."""
    v = F.col("value")
    return [F.count("*").alias("readings"), round4(F.avg(v)).alias("value_mean"), round4(F.min(v)).alias("value_min"), round4(F.max(v)).alias("value_max"), round4(F.stddev_pop(v)).alias("value_stddev")]


def health_metrics(config: EngineConfig = EngineConfig()) -> list[Column]:
    """Share of motor readings that run, mean oil temperature, and whether both pass their alert (judged unrounded)."""
    motor = F.count_if(F.col("stream") == MOTOR)
    running = F.count_if((F.col("stream") == MOTOR) & (F.col("value") >= config.motor_running_threshold))
    oil = F.coalesce(F.avg(F.when(F.col("stream") == OIL, F.col("value"))), F.lit(0.0))
    share = ratio(running, motor)
    return [motor.alias("motor_readings"), round4(share).alias("running_ratio"), round4(oil).alias("oil_temperature_mean"), ((share >= config.running_ratio_alert) & (oil >= config.oil_temperature_alert)).alias("air_leak_suspected")]


def signal_stats(readings: DataFrame) -> DataFrame:
    """Statistics per asset, stream, unit and window."""
    return readings.groupBy("asset_id", "stream", "unit", "w").agg(*signal_metrics())


def health_indicator(readings: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Indicator per asset and window; a window with neither motor nor oil readings has ratio and mean 0."""
    return readings.groupBy("asset_id", "w").agg(*health_metrics(config))


def both(readings: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Both aggregations by grouping sets: one input, one shuffle.

    ``metric_type`` tells the rows apart; columns of the other kind are null.
    """
    level = F.grouping("stream")
    # expressions over the grouped columns would see their nulls, so the aggregates read copies
    copied = readings.withColumn("s", F.col("stream"))
    m = F.count_if(F.col("s") == MOTOR)
    run = F.count_if((F.col("s") == MOTOR) & (F.col("value") >= config.motor_running_threshold))
    oil = F.avg(F.when(F.col("s") == OIL, F.col("value")))
    asset, stream, unit, w = (F.col(c) for c in ("asset_id", "stream", "unit", "w"))
    grouped = copied.groupingSets([[asset, stream, unit, w], [asset, w]], asset, stream, unit, w).agg(level.alias("g"), *signal_metrics(), m.alias("m"), run.alias("run"), oil.alias("oil"))
    health, share, mean = F.col("g") == 1, ratio(F.col("run"), F.col("m")), F.coalesce("oil", F.lit(0.0))
    alert = (share >= config.running_ratio_alert) & (mean >= config.oil_temperature_alert)
    stats = [F.when(~health, F.col(c)).alias(c) for c in ("readings", "value_mean", "value_min", "value_max", "value_stddev")]
    return grouped.select(F.when(health, HEALTH).otherwise(SIGNAL_STATS).alias("metric_type"), "asset_id", "stream", "unit", "w", *stats, F.when(health, F.col("m")).alias("motor_readings"), F.when(health, round4(share)).alias("running_ratio"), F.when(health, round4(mean)).alias("oil_temperature_mean"), F.when(health, alert).alias("air_leak_suspected"))


def formatted(aggregates: DataFrame, config: EngineConfig = EngineConfig(), metric_type: str | None = None) -> DataFrame:
    """Records with identifier and window texts: ``metric|asset[|stream]|start``; corrections close after the lateness."""
    kind = F.lit(metric_type) if metric_type else F.col("metric_type")
    start = format_iso(F.col("w.start"))
    stream = [F.col("stream")] if "stream" in aggregates.columns else []
    close = F.timestamp_micros(F.unix_micros(F.col("w.end")) + F.lit(config.allowed_lateness_seconds * 1_000_000))
    head = [F.concat_ws("|", kind, "asset_id", *stream, start).alias("aggregate_id"), kind.alias("metric_type"), "asset_id", *(["stream", "unit"] if stream else []), start.alias("window_start"), format_iso(F.col("w.end")).alias("window_end"), format_iso(close).alias("corrections_close_at")]
    rest = [c for c in aggregates.columns if c not in ("metric_type", "asset_id", "stream", "unit", "w")]
    return aggregates.select(*head, *rest)


def empty_stats(readings: DataFrame) -> DataFrame:
    """Statistics of a whole table; of an empty one: 0 readings, mean and deviation 0.0, no extremes."""
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return readings.agg(*signal_metrics()).select("readings", zero("value_mean"), "value_min", "value_max", zero("value_stddev"))


def panes(aggregates: DataFrame) -> DataFrame:
    """Adds ``is_first`` and ``is_last`` to a history of panes by the lowest and highest index of each identifier."""
    ends = aggregates.groupBy(F.col("aggregate_id").alias("e_id")).agg(F.min("pane_index").alias("e_first"), F.max("pane_index").alias("e_last"))
    marks = {"is_first": F.col("pane_index") == F.col("e_first"), "is_last": F.col("pane_index") == F.col("e_last")}
    return aggregates.join(ends, F.col("aggregate_id").eqNullSafe(F.col("e_id"))).withColumns(marks).drop("e_id", "e_first", "e_last")
