"""Early, on-time and late panes per window, as a stateful processor with event-time timers.

One asset's window is a key, so an asset with a third of all readings spreads over its windows and a trigger
reads only the windows it changes. Accumulating panes of each signal (stream, unit) and of the asset's health:
an early pane whenever a micro-batch changes them before the watermark passes the window's end, an on-time
pane when it does (also without new data), a late pane per micro-batch that corrects them until the allowed
lateness is over, and then the last pane once more, marked as last. Identifiers are kept per window, so a
message counts once: its first copy by ingestion.

:func:`replayed` gives a stored feed's panes as the stream would, one trigger per step of ingestion time.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidewatch.config import EngineConfig
from tidewatch.functions.numeric import ratio, round4
from tidewatch.operators.aggregates import MOTOR, OIL, dedup_in_window
from tidewatch.schema import HEALTH, SIGNAL_STATS

OUTPUT = "metric_type string, asset_id string, stream string, unit string, window_s long, pane_index int, pane_timing string, is_first boolean, is_last boolean, readings long, value_mean double, value_min double, value_max double, value_stddev double, motor_readings long, running_ratio double, oil_temperature_mean double, air_leak_suspected boolean"
NAMES = [c.strip().split(" ")[0] for c in OUTPUT.split(",")]
SIGNAL = "readings long, mean double, m2 double, low double, high double, panes int, timing string"
ASSET = "on_time boolean, motor long, running long, oil long, oil_sum double, panes int, timing string"


def four(x: float) -> float:
    """As :func:`tidewatch.functions.numeric.round4`."""
    if not np.isfinite(x) or abs(x) >= 1e20:
        return float(x)
    return float(Decimal(repr(float(x))).quantize(Decimal("1e-10"), ROUND_HALF_UP).quantize(Decimal("1e-4"), ROUND_HALF_UP))


class PaneProcessor(StatefulProcessor):
    """One instance per task; state per asset and window: its identifiers, its signals' statistics and its health's sums."""

    def __init__(self, config: EngineConfig = EngineConfig()) -> None:
        self.config = config

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ids = handle.getListState("ids", "ids array<string>")
        self.signals = handle.getMapState("signals", "stream string, unit string", SIGNAL)
        self.asset = handle.getValueState("asset", ASSET)

    def _times(self, key: tuple) -> tuple[int, int]:
        """When the on-time pane is due and when the window closes, in milliseconds of the watermark."""
        end = int(key[1]) + self.config.window_seconds
        return (end - self.config.allowed_lateness_seconds) * 1000, end * 1000

    def _signal(self, key: tuple, of: tuple, s: list, timing: str, index: int, last: bool = False) -> tuple:
        n, mean, m2, low, high = s[:5]
        return (SIGNAL_STATS, key[0], *of, int(key[1]), index, timing, index == 0, last, n, four(mean), four(low), four(high), four((max(m2, 0.0) / n) ** 0.5), None, None, None, None)

    def _health(self, key: tuple, a: list, timing: str, index: int, last: bool = False) -> tuple:
        c = self.config
        share, oil = (a[2] / a[1] if a[1] else 0.0), (a[4] / a[3] if a[3] else 0.0)
        return (HEALTH, key[0], None, None, int(key[1]), index, timing, index == 0, last, None, None, None, None, None, a[1], four(share), four(oil), share >= c.running_ratio_alert and oil >= c.oil_temperature_alert)

    def _on_time(self, key: tuple, a: list) -> list[tuple]:
        out = []
        for of, s in [(tuple(k), list(v)) for k, v in self.signals.iterator()]:
            out.append(self._signal(key, of, s, "ON_TIME", s[5]))
            self.signals.updateValue(of, (*s[:5], s[5] + 1, "ON_TIME"))
        out.append(self._health(key, a, "ON_TIME", a[5]))
        a[0], a[5], a[6] = True, a[5] + 1, "ON_TIME"
        self.asset.update(tuple(a))
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        due, end = self._times(key)
        if mark >= end:
            return
        out: list[tuple] = []
        known = self.asset.exists()
        a = list(self.asset.get()) if known else [False, 0, 0, 0, 0.0, 0, ""]
        if known and not a[0] and mark >= due:
            # rows come before timers, so a pane that is due is given out first
            self.handle.deleteTimer(due)
            out += self._on_time(key, a)
        new = pd.concat(list(rows)).sort_values(["seen", "value", "arrival"], kind="stable").drop_duplicates("event_id")
        if known:
            new = new[~new["event_id"].isin({i for (ids,) in self.ids.get() for i in ids})]
        if len(new):
            if not known:
                self.handle.registerTimer(due)
                self.handle.registerTimer(end)
            self.ids.appendValue((new["event_id"].tolist(),))
            out += self._changed(key, a, new)
        if out:
            yield pd.DataFrame(out, columns=NAMES)

    def _changed(self, key: tuple, a: list, new: pd.DataFrame) -> list[tuple]:
        out, timing = [], "LATE" if a[0] else "EARLY"
        for of, g in new.groupby(["stream", "unit"], dropna=False):
            v = g["value"].to_numpy(float)
            n, mean = len(v), float(v.mean())
            m2 = float(((v - mean) ** 2).sum())
            s = list(self.signals.getValue(of)) if self.signals.containsKey(of) else [0, 0.0, 0.0, np.inf, -np.inf, 0, ""]
            total, apart = s[0] + n, mean - s[1]
            # a signal first seen after the window's on-time pane has an early one, and its on-time one with it
            given = ["EARLY", "ON_TIME"] if a[0] and not s[5] else [timing]
            s = [total, s[1] + apart * n / total, s[2] + m2 + apart * apart * s[0] * n / total, float(min(s[3], v.min())), float(max(s[4], v.max())), s[5], given[-1]]
            for kind in given:
                out.append(self._signal(key, of, s, kind, s[5]))
                s[5] += 1
            self.signals.updateValue(of, tuple(s))
        motor, oil = new.loc[new["stream"] == MOTOR, "value"], new.loc[new["stream"] == OIL, "value"]
        a[1:5] = [a[1] + len(motor), a[2] + int((motor >= self.config.motor_running_threshold).sum()), a[3] + len(oil), a[4] + float(oil.sum())]
        out.append(self._health(key, a, timing, a[5]))
        a[5], a[6] = a[5] + 1, timing
        self.asset.update(tuple(a))
        return out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.asset.exists():
            return
        a, out = list(self.asset.get()), []
        if not a[0]:
            out += self._on_time(key, a)
        if expiredTimerInfo.getExpiryTimeInMs() >= self._times(key)[1]:
            out += [self._signal(key, tuple(of), list(s), s[6], s[5] - 1, last=True) for of, s in self.signals.iterator()]
            out.append(self._health(key, a, a[6], a[5] - 1, last=True))
            self.signals.clear()
            self.ids.clear()
            self.asset.clear()
        if out:
            yield pd.DataFrame(out, columns=NAMES)

    def close(self) -> None:
        pass


def panes(readings: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Panes of a stream of ``asset_id, window_s, stream, unit, event_id, value, seen, arrival, event_time`` with a watermark on ``event_time``.

    ``seen`` and ``arrival`` order the copies of a message that come in one trigger. The watermark's delay
    must be the allowed lateness. Needs the RocksDB state store.
    """
    return readings.groupBy("asset_id", "window_s").transformWithStateInPandas(statefulProcessor=PaneProcessor(config), outputStructType=OUTPUT, outputMode="Update", timeMode="EventTime")


def replayed(readings: DataFrame, config: EngineConfig = EngineConfig(), arrival: str = "delivery_id") -> DataFrame:
    """Panes of a stored feed, as :func:`panes` gives them out with one step of ``ingestion_time`` per trigger.

    ``readings`` are admitted ones in windows (``w``), with ``arrival`` to order equal ingestion times. A step
    is the early firing interval. Each step's watermark is the maximum event time of all earlier steps, of
    whatever source, less the allowed lateness; the last one fires what is still open. Everything is native:
    running aggregates over a window's steps, whose panes are then written out.
    """
    lateness, size = config.allowed_lateness_seconds * 1000, config.window_seconds
    step = F.floor(F.unix_micros("ingestion_time") / F.lit(config.early_firing_seconds * 1_000_000)).cast("long")
    tops = readings.groupBy(step.alias("step")).agg(F.max(F.unix_millis("event_time")).alias("top"))
    before = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)  # a row per step, whatever the readings
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    marks = tops.select("step", F.greatest(F.coalesce(F.max("top").over(before) - lateness, zero), zero).alias("mark"), (F.max("top").over(whole) - lateness).alias("end_mark"))
    once = dedup_in_window(readings, arrival).select("asset_id", "stream", "unit", F.unix_seconds(F.col("w.start").cast("timestamp")).alias("window_s"), "value", step.alias("step"))
    marked = once.join(marks, "step").where(F.col("mark") < (F.col("window_s") + size) * 1000)

    def run(key: list[str], columns: dict[str, Column]) -> DataFrame:
        """The running values of each key after each of its steps."""
        upto = Window.partitionBy(*key).orderBy("step").rangeBetween(Window.unboundedPreceding, 0)
        rows = marked.withColumns({n: c.over(upto) for n, c in columns.items()})
        return rows.select(*key, "step", "mark", "end_mark", *columns).dropDuplicates([*key, "step"])

    v = F.col("value")
    is_motor, is_oil = F.col("stream") == MOTOR, F.col("stream") == OIL
    signals = run(["asset_id", "stream", "unit", "window_s"], {"readings": F.count("*"), "value_mean": F.avg(v), "value_min": F.min(v), "value_max": F.max(v), "value_stddev": F.stddev_pop(v)})
    signals = _steps_to_panes(signals, ["asset_id", "stream", "unit", "window_s"], size, lateness).select(F.lit(SIGNAL_STATS).alias("metric_type"), "asset_id", "stream", "unit", "window_s", "p.*", "readings", *[round4(c).alias(c) for c in ("value_mean", "value_min", "value_max", "value_stddev")])
    health = run(["asset_id", "window_s"], {"motor_readings": F.count(F.when(is_motor, v)), "running": F.count(F.when(is_motor & (v >= config.motor_running_threshold), v)), "oil": F.avg(F.when(is_oil, v))})
    share, oil = ratio(F.col("running"), F.col("motor_readings")), F.coalesce("oil", F.lit(0.0))
    alert = (share >= config.running_ratio_alert) & (oil >= config.oil_temperature_alert)
    health = _steps_to_panes(health, ["asset_id", "window_s"], size, lateness).select(F.lit(HEALTH).alias("metric_type"), "asset_id", "window_s", "p.*", "motor_readings", round4(share).alias("running_ratio"), round4(oil).alias("oil_temperature_mean"), alert.alias("air_leak_suspected"))
    return signals.unionByName(health, allowMissingColumns=True).select(*NAMES)


def _steps_to_panes(steps: DataFrame, key: list[str], size: int, lateness: int) -> DataFrame:
    """Each step's panes as ``p``: its own, the on-time one after the last early step, and the last once more."""
    by_key = Window.partitionBy(*key)
    end = (F.col("window_s") + size) * 1000
    due = end - lateness
    early = F.col("mark") < due
    numbered = steps.withColumns({"i": F.row_number().over(by_key.orderBy("step")), "early": early, "e": F.count_if(early).over(by_key), "n": F.count("*").over(by_key)})
    pane = lambda index, timing, last=False: F.struct(index.cast("int").alias("pane_index"), F.lit(timing).alias("pane_timing"), (index == 0).alias("is_first"), F.lit(last).alias("is_last"))
    i, e, n = F.col("i"), F.col("e"), F.col("n")
    # a window first seen when its pane is due has an early pane, and the on-time one with it
    own = F.when(F.col("early") | ((e == 0) & (i == 1)), pane(i - 1, "EARLY")).otherwise(pane(i, "LATE"))
    passes = (due <= F.col("end_mark")) | (e < n)
    first_late = (e == 0) & (i == 1)
    on_time = F.when(first_late, pane(i, "ON_TIME")).when((i == e) & passes, pane(e, "ON_TIME"))
    closes = (i == n) & (end <= F.col("end_mark"))
    last = F.when(closes & (F.col("early") | first_late), pane(i, "ON_TIME", True)).when(closes, pane(i, "LATE", True))
    return numbered.withColumn("p", F.explode(F.array_compact(F.array(own, on_time, last))))
