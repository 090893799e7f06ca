"""Numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def round4(col: Column | str) -> Column:
    """Four decimals, half away from zero, judged on ten: sums that differ in their last bits round alike."""
    col = F.col(col) if isinstance(col, str) else col
    exact = F.round(col.try_cast(T.DecimalType(30, 10)), 4).cast("double")
    return F.coalesce(exact, F.round(col, 4))


def ratio(part: Column, whole: Column) -> Column:
    """0.0 where there is no whole, never null."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def uniform(seed: int, *cols: str) -> Column:
    """A number from 0 to 1 (excluded) that depends on the row's columns only, not on partitioning.

    The first 13 hexadecimal digits of an MD5, so any engine can recompute it.
    """
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))
