"""Replay with injected faults, as one batch plan; a written replay is a stream's source."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta, timezone
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.numeric import uniform
from tidewatch.functions.timestamps import parse_iso


#: Faults by scenario: class, share of the readings, lag in seconds; drawn in this order, repeats apart from the rest. Fixed values.
SCENARIOS: dict[str, tuple[tuple[str, float, int], ...]] = {
    "normal": (),
    "adverse": (("too_late", 0.005, 1800), ("late", 0.02, 300), ("out_of_order", 0.05, 60), ("duplicate", 0.02, 0)),
}


def replay(readings: DataFrame, scenario: Sequence[tuple[str, float, int]] = SCENARIOS["normal"], *, seed: int = 7, target_start: datetime | None = None, speedup: float = 120.0) -> DataFrame:
    """Readings on one common timeline with faults: new ``event_time``, ``ingestion_time``, and delivery columns.

    ``scenario`` has rows as in ``SCENARIOS``. Every asset starts at ``target_start`` (by default so that the longest asset ends now). One draw per
    reading picks too late, late, out of order or none; another, independent draw a second delivery, which
    has the same ``event_id``. Draws depend on ``event_id`` and ``seed`` only, not on partitions or order.
    ``offset_s`` is the event's place on the timeline, ``delivery_s`` with its lag, ``due_s`` the same at
    ``speedup``, ``fault`` the class, ``copy`` 0 or 1. Readings without a valid source time are left out.
    """
    if speedup <= 0:
        raise ValueError("speedup must be positive")
    timed = readings.withColumn("r_at", parse_iso("source_event_time")).where(F.col("r_at").isNotNull())
    span = timed.groupBy(F.col("asset_id").alias("r_asset")).agg(F.min("r_at").alias("r_start"), F.max("r_at").alias("r_end"))
    if target_start is None:
        longest = span.agg(F.max((F.unix_micros("r_end") - F.unix_micros("r_start")) / F.lit(1e6))).first()[0] or 0.0
        target_start = datetime.now(timezone.utc) - timedelta(seconds=longest)
    placed = timed.join(span, F.col("asset_id").eqNullSafe(F.col("r_asset"))).withColumn("offset_s", (F.unix_micros("r_at") - F.unix_micros("r_start")) / F.lit(1e6))
    roll, again = uniform(seed, "event_id"), uniform(seed + 1, "event_id")
    own = [f for f in scenario if f[0] != "duplicate"]
    fault, lag = F.lit("none"), F.lit(0)
    for (name, _, seconds), edge in reversed(list(zip(own, accumulate(f[1] for f in own)))):
        fault, lag = F.when(roll < edge, name).otherwise(fault), F.when(roll < edge, seconds).otherwise(lag)
    repeats = sum(f[1] for f in scenario if f[0] == "duplicate")
    start_us = int(target_start.replace(tzinfo=target_start.tzinfo or timezone.utc).timestamp() * 1_000_000)
    event_us = F.lit(start_us) + (F.col("offset_s") * 1_000_000).cast("long")
    planned = placed.withColumns({"fault": fault, "lag_s": lag}).withColumns({"event_time": F.timestamp_micros(event_us), "ingestion_time": F.timestamp_micros(event_us + F.col("lag_s") * 1_000_000), "delivery_s": F.col("offset_s") + F.col("lag_s")})
    copies = F.when(again < repeats, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return planned.withColumn("copy", F.explode(copies)).withColumn("due_s", F.col("delivery_s") / F.lit(speedup)).drop("r_at", "r_asset", "r_start", "r_end")


def in_delivery_order(replayed: DataFrame) -> DataFrame:
    return replayed.orderBy("delivery_s", "event_id", "copy")


def fault_counts(replayed: DataFrame) -> DataFrame:
    """One row of counters; all zero for an empty replay."""
    first = F.col("copy") == 0
    count = lambda f: F.count_if(first & (F.col("fault") == f)).alias(f)
    return replayed.agg(F.count("*").alias("events"), F.count_if(F.col("copy") == 1).alias("duplicates"), count("out_of_order"), count("late"), count("too_late"))


def write_steps(replayed: DataFrame, path: str, step_s: int) -> None:
    """The replay as one file per step of the timeline, for a file stream that takes one file a trigger."""
    stepped = replayed.withColumn("step", F.floor(F.col("delivery_s") / step_s).cast("int"))
    stepped.repartition("step").sortWithinPartitions("step", "delivery_s").write.partitionBy("step").parquet(path)
