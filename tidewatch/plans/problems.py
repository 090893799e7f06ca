"""Queries of the general problems (p1, p2, p4, p5, p6) and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.timestamps import parse_iso
from tidewatch.operators import cdc, grid, late, spikes
from tidewatch.operators.dedup import extra_copies, kept_once
from tidewatch.shared import hashed_bytes, scratch_path, written

MESSAGE = ("asset_id", "event_id")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every delivery but the kept one of each message."""
    sent = table(spark, sf_dir, "sensor_readings").select(*MESSAGE, "ingestion_time", "delivery_id")
    return extra_copies(sent, MESSAGE, "ingestion_time", "delivery_id").select("delivery_id")


SOURCE = ("asset_id", "stream")


def _sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "sensor_readings").select(*MESSAGE, "ingestion_time", "delivery_id", "stream", "value", "event_time", "batch_id")


def _corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return late.corrected_windows(late.registers(_sent(spark, sf_dir), MESSAGE), SOURCE)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that a late message corrected after their first report."""
    return _corrected(spark, sf_dir).where("corrections > 0").select(*SOURCE, late.PERIOD)


def p1_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-minute statistics by event time, corrected up to the cut-off."""
    return _corrected(spark, sf_dir).drop("last_seen")


def p1_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from states made apart: an earlier and a later part of the feed that overlap and divide batches, one of them sent twice."""
    sent = _sent(spark, sf_dir)
    top = F.col("top")
    cut = sent.join(F.broadcast(sent.agg(F.max("delivery_id").alias("top"))))  # one row
    earlier, later = (written(late.registers(cut.where(w).drop("top"), MESSAGE), "late-slice") for w in (F.col("delivery_id") <= top * 0.6, F.col("delivery_id") > top * 0.4))
    return late.corrected_windows(late.merge_registers(MESSAGE, later, earlier, later), SOURCE).drop("last_seen")


CHANGE = ("pane_index", "change_id")


def _serving(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Apply the feed, publish the state, and read what is published."""
    feed = table(spark, sf_dir, "aggregates").select("aggregate_id", *CHANGE, "op", *more)
    root = scratch_path(spark, "serving")
    cdc.publish(cdc.apply_changes(feed, "aggregate_id", CHANGE, "op"), root, "aggregates")
    return cdc.read_published(spark, root, "aggregates").where(~F.col("deleted"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregates present after all changes, each with the change it shows."""
    return _serving(spark, sf_dir).select("aggregate_id", "change_id")


SHOWN = ("metric_type", "asset_id", "stream", "unit", "window_start", "window_end", "is_last", "emitted_at", "readings", "value_mean", "value_min", "value_max", "value_stddev", "motor_readings", "running_ratio", "oil_temperature_mean", "air_leak_suspected")


def p2_serving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The serving table with its contents."""
    rows = _serving(spark, sf_dir, *SHOWN)
    return rows.select("aggregate_id", *CHANGE, *[F.unix_micros(c).alias(c + "_us") if c == "emitted_at" else c for c in SHOWN])


def _series(spark: SparkSession, sf_dir: str, **kw) -> DataFrame:
    sent = table(spark, sf_dir, "sensor_readings").select(*SOURCE, "value", parse_iso("source_event_time").alias("at"))
    return grid.regular_series(sent, SOURCE, time="at", **kw)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes without a usable reading between the first and the last of a day, each filled by the model."""
    return _series(spark, sf_dir, only_filled=True).where(F.col("value").isNotNull()).select(*SOURCE, "slot_s")


def p4_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole regular series, filled slots marked and predicted."""
    return _series(spark, sf_dir)


def p4_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: observed slots left out and filled again, and the errors of the model and of a straight line."""
    sent = table(spark, sf_dir, "sensor_readings").select(*SOURCE, "value", parse_iso("source_event_time").alias("at"))
    return grid.held_out(sent, SOURCE, time="at")


COPY_SALTS = 8
#: A table that takes at most so many bytes in memory is broadcast.
SMALL_BYTES = 32 << 20


def p5_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Implausible deliveries with the reasons."""
    everything = table(spark, sf_dir, "sensor_readings")
    sent = everything.select(*MESSAGE, "ingestion_time", "delivery_id", "stream", "value", "event_time")
    kept = kept_once(sent, MESSAGE, "ingestion_time", "delivery_id").drop("ingestion_time")
    odd = written(spikes.suspicious(kept, SOURCE, "event_time", "value", "delivery_id", carry=("event_id",)), "odd-readings")
    rows = odd.select("delivery_id", "spike", "stuck", F.lit(False).alias("impossible"))
    # the other deliveries of an odd message with its value are its copies
    others = everything.where(F.col("event_id").isNotNull()).select(*MESSAGE, "value", "delivery_id")
    named = odd.where(F.col("event_id").isNotNull()).select(*[F.col(c).alias("o_" + c) for c in (*MESSAGE, "value", "delivery_id")], "spike", "stuck")
    same = [*MESSAGE, "value"]
    if hashed_bytes(named) <= SMALL_BYTES:
        named = F.broadcast(named)
    else:  # odd messages meet their copies once per salt, so that a message with very many is split
        # and are never broadcast: Spark would go by the size of their packed files, a hundredth of what they take in memory
        named = named.withColumn("o_salt", F.explode(F.sequence(F.lit(0), F.lit(COPY_SALTS - 1)))).hint("merge")
        others = others.withColumn("salt", F.pmod("delivery_id", F.lit(COPY_SALTS)).cast("int"))
        same.append("salt")
    met = others.join(named, [F.col(c).eqNullSafe(F.col("o_" + c)) for c in same])
    rows = rows.unionByName(met.select("delivery_id", "spike", "stuck", F.lit(False).alias("impossible")))
    impossible = spikes.out_of_bounds(everything.select("delivery_id", "stream", "value"), table(spark, sf_dir, "stream_registry"), "stream", "value")
    rows = rows.unionByName(impossible.select("delivery_id", F.lit(False).alias("spike"), F.lit(False).alias("stuck"), F.lit(True).alias("impossible")))
    return rows.groupBy("delivery_id").agg(*[F.bool_or(c).alias(c) for c in ("spike", "stuck", "impossible")])


def p5_stuck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of these, the frozen ones."""
    return p5_readings(spark, sf_dir).where("stuck").select("delivery_id")


def p5_impossible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of these, those outside their stream's bounds."""
    return p5_readings(spark, sf_dir).where("impossible").select("delivery_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Implausible deliveries."""
    return p5_readings(spark, sf_dir).select("delivery_id")


#: Messages p6 keeps, as SQL; others build on it.
KEPT = """kept AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asset_id, event_id ORDER BY ingestion_time NULLS LAST, delivery_id) AS rn
                 FROM sensor_readings WHERE event_id IS NOT NULL) WHERE rn = 1
  UNION ALL SELECT *, 1 FROM sensor_readings WHERE event_id IS NULL)"""

P6_FOUND = """SELECT delivery_id FROM (
  SELECT delivery_id, row_number() OVER (PARTITION BY asset_id, event_id ORDER BY ingestion_time NULLS LAST, delivery_id) AS rn
  FROM sensor_readings WHERE event_id IS NOT NULL) WHERE rn > 1"""


COUNTED = """counted AS (
  SELECT asset_id, stream, value, epoch_us(ingestion_time) AS ing, CAST(floor(epoch_us(event_time) / 300000000) AS BIGINT) * 300 AS window_s
  FROM kept WHERE value IS NOT NULL AND isfinite(value) AND ingestion_time IS NOT NULL
    AND epoch_us(ingestion_time) - epoch_us(event_time) BETWEEN 0 AND 720000000)"""

P1_FOUND = f"""WITH {KEPT}, {COUNTED}
SELECT DISTINCT asset_id, stream, window_s FROM counted WHERE ing > (window_s + 360) * 1000000"""

P1_WINDOWS = f"""WITH {KEPT}, {COUNTED}
SELECT asset_id, stream, window_s, count(*) AS readings, count(*) FILTER (WHERE ing > (window_s + 360) * 1000000) AS corrections,
  CAST(sum(CAST(value AS DECIMAL(26, 6))) AS DOUBLE) / count(*) AS value_mean, min(value) AS value_min, max(value) AS value_max
FROM counted GROUP BY ALL"""

NEWEST = """newest AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY aggregate_id ORDER BY pane_index DESC, change_id DESC) AS rn FROM aggregates)
  WHERE rn = 1 AND lower(trim(op)) NOT IN ('d', 'delete'))"""

P2_FOUND = f"WITH {NEWEST} SELECT aggregate_id, change_id FROM newest"

P2_SERVING = f"""WITH {NEWEST} SELECT aggregate_id, pane_index, change_id, metric_type, asset_id, stream, unit, window_start, window_end, is_last,
  epoch_us(emitted_at) AS emitted_at_us, readings, value_mean, value_min, value_max, value_stddev, motor_readings, running_ratio, oil_temperature_mean,
  air_leak_suspected FROM newest"""


P5_STUCK = f"""WITH {KEPT}, usable AS (SELECT asset_id, stream, event_id, value, delivery_id, event_time FROM kept WHERE value IS NOT NULL AND isfinite(value)),
stepped AS (SELECT *, value IS DISTINCT FROM lag(value) OVER w AS starts, row_number() OVER w AS pos FROM usable WINDOW w AS (PARTITION BY asset_id, stream ORDER BY event_time, delivery_id)),
runs AS (SELECT *, sum(CAST(starts AS INTEGER)) OVER (PARTITION BY asset_id, stream ORDER BY pos) AS run FROM stepped),
stuck AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY asset_id, stream, run) AS n FROM runs) WHERE n >= 10)
SELECT delivery_id FROM stuck UNION SELECT c.delivery_id FROM sensor_readings c JOIN stuck s ON c.asset_id = s.asset_id AND c.event_id = s.event_id AND c.value = s.value"""

P5_IMPOSSIBLE = """SELECT delivery_id FROM sensor_readings JOIN stream_registry USING (stream)
WHERE value IS NOT NULL AND isfinite(value) AND (value < phys_min OR value > phys_max)"""

P4_FOUND = r"""WITH slots AS (
  SELECT DISTINCT asset_id, stream, CAST(epoch(moment) AS BIGINT) // 60 * 60 AS slot_s FROM (
    SELECT asset_id, stream, value, date_trunc('minute', TRY_CAST(CASE WHEN regexp_matches(source_event_time, '(Z|[+-]\d\d:?\d\d)$') AND length(source_event_time) > 10
      THEN source_event_time ELSE source_event_time || 'Z' END AS TIMESTAMPTZ)) AS moment
    FROM sensor_readings WHERE value IS NOT NULL AND isfinite(value)) WHERE moment IS NOT NULL),
steps AS (SELECT *, lead(slot_s) OVER (PARTITION BY asset_id, stream, slot_s // 86400 ORDER BY slot_s) AS next_s FROM slots)
SELECT asset_id, stream, unnest(range(slot_s + 60, next_s, 60)) AS slot_s FROM steps WHERE next_s - slot_s > 60"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_windows": p1_windows, "p1_slices": p1_slices, "p2_found": p2_found, "p2_serving": p2_serving, "p4_found": p4_found, "p4_series": p4_series, "p4_holdout": p4_holdout, "p5_found": p5_found, "p5_readings": p5_readings, "p5_stuck": p5_stuck, "p5_impossible": p5_impossible, "p6_found": p6_found}


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND, "p1_windows": P1_WINDOWS, "p1_slices": P1_WINDOWS, "p2_found": P2_FOUND, "p2_serving": P2_SERVING, "p4_found": P4_FOUND, "p5_stuck": P5_STUCK, "p5_impossible": P5_IMPOSSIBLE, "p6_found": P6_FOUND}
