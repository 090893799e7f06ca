"""Irregular readings onto a regular grid.

Slots without a reading are predicted by a trend plus harmonics of a season, fitted per source by normal
equations: each task sums products, the sums add up, and one small linear system per source is solved.
The residuals at a gap's two observed ends are bridged linearly, so the filled series meets both ends.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tidewatch.functions.numeric import uniform
from tidewatch.operators.late import finite

YEAR = 31_557_600.0
EPOCH = 1_640_995_200  # the trend counts years from 2022


def features(slot: Column, season: int, harmonics: int) -> list[Column]:
    """Intercept, trend, and cosine and sine of each harmonic of the season."""
    turn = F.lit(2 * np.pi / season) * F.pmod(slot, F.lit(season)).cast("double")
    waves = [f(F.lit(float(k)) * turn) for k in range(1, harmonics + 1) for f in (F.cos, F.sin)]
    return [F.lit(1.0), (slot.cast("double") - F.lit(float(EPOCH))) / F.lit(YEAR), *waves]


def fit(observed: DataFrame, keys: Sequence[str], *, slot: str, value: str, season: int = 86_400, harmonics: int = 2, ridge: float = 1e-8) -> DataFrame:
    """Coefficients per source, as an array in the order of :func:`features`.

    The ridge, relative to the largest diagonal entry, makes systems of few or coinciding slots solvable.
    """
    x, y = features(F.col(slot), season, harmonics), F.col(value)
    m = len(x)
    pairs = [(i, j) for i in range(m) for j in range(i, m)]
    sums = observed.groupBy(*keys).agg(*[F.sum(x[i] * x[j]).alias(f"a{i}_{j}") for i, j in pairs], *[F.sum(x[i] * y).alias(f"b{i}") for i in range(m)])
    packed = sums.select(*keys, F.array(*[f"a{i}_{j}" for i, j in pairs], *[f"b{i}" for i in range(m)]).alias("sums"))

    @pandas_udf("array<double>")
    def solve(packed: pd.Series) -> pd.Series:
        s = np.stack(packed.to_numpy()) if len(packed) else np.empty((0, len(pairs) + m))
        a = np.zeros((len(s), m, m))
        for k, (i, j) in enumerate(pairs):
            a[:, i, j] = a[:, j, i] = s[:, k]
        scale = np.maximum(np.abs(np.einsum("gii->gi", a)).max(axis=1), 1e-12) if len(s) else np.empty(0)
        a += ridge * scale[:, None, None] * np.eye(m)
        return pd.Series(list(np.linalg.solve(a, s[:, len(pairs) :, None])[..., 0]))

    return packed.select(*keys, solve("sums").alias("coefficients"))


def slot_means(readings: DataFrame, keys: Sequence[str], *, time: str, value: str, step: int, day: str, slot: str) -> DataFrame:
    """Mean, count per source and slot of the usable readings; ``time`` is a timestamp."""
    us = F.unix_micros(time)
    at = F.floor(us / F.lit(step * 1_000_000)).cast("long") * F.lit(step)
    usable = readings.where(finite(value) & F.col(time).isNotNull())
    return usable.select(*keys, at.alias(slot), F.col(value).alias("v")).groupBy(*keys, F.floor(F.col(slot) / 86_400).cast("long").alias(day), slot).agg(F.avg("v").alias("value"), F.count("*").alias("readings"))


def regular_series(readings: DataFrame, keys: Sequence[str], *, time: str, value: str = "value", step: int = 60, season: int = 86_400, harmonics: int = 2, only_filled: bool = False) -> DataFrame:
    """One row per source and slot from the first to the last observed slot of each UTC day.

    Columns: ``keys``, ``slot_s`` (start, epoch seconds), ``value``, ``readings`` (0 where filled),
    ``filled``. A reading is usable if its value is finite and its time not null; every usable delivery
    counts, repeats too. Between two days nothing is filled. A null key is a key like any other. Values so
    large that their mean overflows pass as they are. Columns beside the named ones are ignored, an empty
    table gives an empty series. ``step`` must divide a day.
    """
    if 86_400 % step:
        raise ValueError("step must divide a day")
    observed = slot_means(readings, keys, time=time, value=value, step=step, day="day_n", slot="slot_s")
    filled = fill(observed, keys, step=step, season=season, harmonics=harmonics).select(*keys, "slot_s", "value", F.lit(0).cast("long").alias("readings"), F.lit(True).alias("filled"))
    if only_filled:
        return filled
    return observed.select(*keys, "slot_s", "value", "readings", F.lit(False).alias("filled")).unionByName(filled)


def fill(observed: DataFrame, keys: Sequence[str], *, step: int = 60, season: int = 86_400, harmonics: int = 2) -> DataFrame:
    """The slots missing between the observed ones of a day: ``keys``, ``slot_s``, ``value`` by the model, ``line`` by a straight line."""
    by_day = Window.partitionBy(*keys, "day_n").orderBy("slot_s")
    with_next = observed.withColumns({"next_s": F.lead("slot_s").over(by_day), "next_value": F.lead("value").over(by_day)})
    gaps = with_next.where(F.col("next_s") - F.col("slot_s") > step)
    model = fit(observed, keys, slot="slot_s", value="value", season=season, harmonics=harmonics)
    model = model.select(*[F.col(k).alias("m_" + k) for k in keys], "coefficients")
    same = [F.col(k).eqNullSafe(F.col("m_" + k)) for k in keys]
    joined = gaps.join(model, same, "inner")

    def predicted(slot: Column) -> Column:
        terms = [F.col("coefficients")[i] * x for i, x in enumerate(features(slot, season, harmonics))]
        return sum(terms[1:], terms[0])

    ends = joined.withColumns({"r0": F.col("value") - predicted(F.col("slot_s")), "r1": F.col("next_value") - predicted(F.col("next_s"))})
    each = ends.withColumn("at", F.explode(F.sequence(F.col("slot_s") + step, F.col("next_s") - step, F.lit(step).cast("long"))))
    share = (F.col("at") - F.col("slot_s")) / (F.col("next_s") - F.col("slot_s"))
    line = F.col("value") + (F.col("next_value") - F.col("value")) * share
    return each.select(*keys, F.col("at").alias("slot_s"), (predicted(F.col("at")) + F.col("r0") + (F.col("r1") - F.col("r0")) * share).alias("value"), line.alias("line"))


def held_out(readings: DataFrame, keys: Sequence[str], *, time: str, value: str = "value", step: int = 60, stretch: int = 1_800, rate: float = 0.1, seed: int = 11, **kw) -> DataFrame:
    """How well the model fills what is known: stretches of observed slots are left out, filled and compared.

    A stretch of ``stretch`` seconds is left out by a draw that depends on source and stretch only. Columns:
    ``keys``, ``held_out`` (slots left out that lie between others of their day), ``model_error`` and
    ``line_error`` (mean absolute errors of the model and of a straight line between a gap's ends).
    """
    observed = slot_means(readings, keys, time=time, value=value, step=step, day="day_n", slot="slot_s")
    drawn = observed.withColumn("stretch", F.floor(F.col("slot_s") / stretch).cast("long"))
    drawn = drawn.withColumn("out", uniform(seed, *keys, "stretch") < rate)
    model = fill(drawn.where("NOT out"), keys, step=step, **kw)
    truth = drawn.where("out").select(*[F.col(k).alias("t_" + k) for k in keys], F.col("slot_s").alias("t_slot"), F.col("value").alias("truth"))
    met = model.join(truth, [*[F.col(k).eqNullSafe(F.col("t_" + k)) for k in keys], F.col("slot_s") == F.col("t_slot")])
    return met.groupBy(*keys).agg(F.count("*").alias("held_out"), F.avg(F.abs(F.col("value") - F.col("truth"))).alias("model_error"), F.avg(F.abs(F.col("line") - F.col("truth"))).alias("line_error"))
