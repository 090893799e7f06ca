"""Reads over the serving table and the history of panes: upsert rule, counts, verdicts, views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.numeric import round4
from tidewatch.operators.admit import canonical_json
from tidewatch.schema import HEALTH, SIGNAL_STATS


def latest_panes(records: DataFrame, arrival: str) -> DataFrame:
    """The row per ``aggregate_id`` that monotone upserts leave: highest pane, among equals the last to arrive.

    ``arrival`` orders the records as they came. Aggregated before the shuffle, so one identifier with a
    third of all panes sends one row per task. Rows without identifier or pane are no upserts.
    """
    others = [c for c in records.columns if c != "aggregate_id"]
    best = F.max_by(F.struct(*others), F.struct("pane_index", arrival)).alias("best")
    return records.where(F.col("aggregate_id").isNotNull() & F.col("pane_index").isNotNull()).groupBy("aggregate_id").agg(best).select("aggregate_id", "best.*")


def upsert(stored: DataFrame, incoming: DataFrame, arrival: str) -> DataFrame:
    """The table after ``incoming`` is upserted; an equal pane replaces the stored one, a lower one is rejected."""
    both = stored.withColumn("u_new", F.lit(0)).unionByName(incoming.withColumn("u_new", F.lit(1)), allowMissingColumns=True)
    ordered = both.withColumn("u_at", F.struct("u_new", arrival))
    return latest_panes(ordered, "u_at").drop("u_new", "u_at")


def applied(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """``incoming`` with ``applied``: whether each would be taken, as its pane is not below the stored one."""
    was = stored.select(F.col("aggregate_id").alias("w_id"), F.col("pane_index").alias("w_pane"))
    return incoming.join(was, F.col("aggregate_id") == F.col("w_id"), "left").withColumn("applied", F.coalesce(F.col("pane_index") >= F.col("w_pane"), F.lit(True))).drop("w_id", "w_pane")


def applied_in_order(records: DataFrame, arrival: str) -> DataFrame:
    """``records`` with ``applied``: whether each is taken when they come one by one in the order of ``arrival``.

    A record is taken if its pane isn't below the highest that came before it for its ``aggregate_id``; one
    without identifier or pane is no upsert.
    """
    before = Window.partitionBy("aggregate_id").orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    taken = F.col("aggregate_id").isNotNull() & F.coalesce(F.col("pane_index") >= F.max("pane_index").over(before), F.col("pane_index").isNotNull())
    return records.withColumn("applied", taken)


def serving_rows(records: DataFrame) -> DataFrame:
    """Records as rows of the serving table: ``is_last`` as a number and the whole record as JSON."""
    payload = canonical_json({c: F.col(c) for c in records.columns})
    last = F.coalesce(F.col("is_last").cast("int"), F.lit(0)).alias("is_last")
    stream = F.col("stream") if "stream" in records.columns else F.lit(None).cast("string").alias("stream")
    return records.select("aggregate_id", "metric_type", "asset_id", stream, "window_start", "window_end", "pane_index", "pane_timing", last, payload.alias("payload"), F.coalesce(F.col("emitted_at").cast("string"), F.lit("")).alias("updated_at"))


def count_by_metric(table: DataFrame) -> DataFrame:
    """Rows of all kinds and of each kind."""
    return table.agg(F.count("*").alias("aggregates"), F.count_if(F.col("metric_type") == SIGNAL_STATS).alias("signal_stats"), F.count_if(F.col("metric_type") == HEALTH).alias("health_indicators"))


def health_rows(table: DataFrame, only_last: bool = False) -> DataFrame:
    """Health indicators by asset; ``only_last`` keeps rows marked as the last pane."""
    rows = table.where(F.col("metric_type") == HEALTH)
    return (rows.where(F.coalesce(F.col("is_last").cast("boolean"), F.lit(False))) if only_last else rows).orderBy("asset_id")


def fleet_verdict(health: DataFrame) -> DataFrame:
    """Per asset: windows, flagged ones, mean ratio, mean oil temperature, and whether most windows are flagged."""
    flagged = F.count_if(F.coalesce("air_leak_suspected", F.lit(False)))
    return health.groupBy("asset_id").agg(F.count("*").alias("windows"), flagged.alias("flagged_windows"), round4(F.avg("running_ratio")).alias("running_ratio"), round4(F.avg("oil_temperature_mean")).alias("oil_temperature_mean"), (flagged * 2 > F.count("*")).alias("air_leak_suspected"))


def checked_verdict(verdict: DataFrame, expected: DataFrame) -> DataFrame:
    """Each expected asset with its observed verdict; a missing one is not ``ok``. ``expected``: asset_id, expected_air_leak."""
    seen = verdict.select(F.col("asset_id").alias("v_asset"), F.col("air_leak_suspected").alias("observed_air_leak"), "windows", "flagged_windows")
    joined = expected.join(seen, F.col("asset_id") == F.col("v_asset"), "left").drop("v_asset")
    return joined.withColumn("ok", F.col("observed_air_leak").eqNullSafe(F.col("expected_air_leak")))


def unexpected_assets(verdict: DataFrame, expected: DataFrame) -> DataFrame:
    return verdict.select("asset_id").join(expected, "asset_id", "left_anti")


def fleet_checks(checked: DataFrame, unexpected: DataFrame) -> DataFrame:
    """One row: whether all is as expected, and whether both verdicts occur."""
    rows = checked.select("ok", "observed_air_leak", F.lit(False).alias("extra"))
    rows = rows.unionByName(unexpected.select(F.lit(None).cast("boolean").alias("ok"), F.lit(None).cast("boolean").alias("observed_air_leak"), F.lit(True).alias("extra")))
    extra = F.count_if(F.col("extra"))
    return rows.agg((F.coalesce(F.bool_and("ok"), F.lit(True)) & (extra == 0)).alias("ok"), (F.count_distinct("observed_air_leak") == 2).alias("separation_observed"), F.count_if(~F.col("extra")).alias("assets"), extra.alias("unexpected"))


def multi_pane_ids(history: DataFrame) -> DataFrame:
    """Identifiers with more than one pane, and how many."""
    return history.groupBy("aggregate_id").agg(F.count_distinct("pane_index").alias("panes")).where("panes > 1")


def pane_timeline(history: DataFrame) -> DataFrame:
    """The panes of these identifiers in order."""
    named = history.select("aggregate_id", "pane_index", "pane_timing", "window_start")
    return named.join(multi_pane_ids(history).select("aggregate_id"), "aggregate_id", "left_semi").orderBy("aggregate_id", "pane_index")


def health_table(table: DataFrame) -> DataFrame:
    return health_rows(table).select("asset_id", "window_start", "running_ratio", "oil_temperature_mean", "air_leak_suspected", "pane_index", "pane_timing").orderBy("asset_id", "window_start")


def stream_series(table: DataFrame, stream: str = "motor_current") -> DataFrame:
    """Mean, minimum and maximum of one stream by asset and window."""
    return table.where((F.col("metric_type") == SIGNAL_STATS) & (F.col("stream") == stream)).select("asset_id", "window_start", "value_mean", "value_min", "value_max").orderBy("asset_id", "window_start")


def last_rows(table: DataFrame, n: int = 200) -> DataFrame:
    """The ``n`` signal rows with the latest windows."""
    rows = table.where(F.col("metric_type") == SIGNAL_STATS)
    return rows.orderBy(F.col("window_start").desc(), F.col("aggregate_id").desc()).limit(n)


def key_differences(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Keys that only one side has, with ``side`` 'missing' (only in ``a``) or 'extra' (only in ``b``)."""
    x, y = a.select(*keys), b.select(*keys)
    return x.subtract(y).withColumn("side", F.lit("missing")).unionByName(y.subtract(x).withColumn("side", F.lit("extra")))


def text_report(checked: DataFrame) -> DataFrame:
    """Fixed-width lines of a verdict; nulls show as a dash."""
    show = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    return checked.select("asset_id", F.format_string("%-10s %-8s %-8s %6s", "asset_id", show("expected_air_leak"), show("observed_air_leak"), show("windows")).alias("line"))
