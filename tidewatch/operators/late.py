"""Late and out-of-order events: conflict-free registers per message and counters per period, source and version.

The state has two layers, both merged by maximum. A *register* is one per message: the copy that counts, which
is the first to be ingested (the maximum under the reversed order of arrival). Registers made apart for any
slices (days, partitions, parts of a batch, overlapping or repeated ones) merge per message, so what a slice
holds needn't be whole. A *counter* is one per period and source, whatever delivers records as a unit that may
be sent again (here a batch): a version, the highest sequence number the source had seen, and the statistics
of its records of that period. Merging keeps, per period and source, the entry with the highest version;
reading sums over the sources. Both merges are associative, commutative and idempotent, so retries and
reordering change nothing. Counters are compact and can be kept and merged on their own where a slice holds
whole sources, or all that a source had sent so far; slices that divide a source merge as registers.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators.dedup import kept_once
from tidewatch.shared import fresh

PERIOD = "window_s"
ENTRY = ("version", "readings", "late_readings", "value_sum", "value_rest", "value_big", "value_min", "value_max", "last_seen")
#: The unit of ``value_big``.
BIG = float(2**64)


def finite(col: Column | str) -> Column:
    """Neither null nor NaN nor infinite (never null itself)."""
    col = F.col(col) if isinstance(col, str) else col
    return col.isNotNull() & (F.abs(col) < F.lit(float("inf"))) & ~F.isnan(col)


def period_start(event_time: str, seconds: int) -> Column:
    """Start of the epoch-aligned half-open window, in epoch seconds."""
    return F.floor(F.unix_micros(event_time) / F.lit(seconds * 1_000_000)).cast("long") * F.lit(seconds)


def counter_entries(records: DataFrame, keys: Sequence[str], *, event_time: str = "event_time", ingestion_time: str = "ingestion_time", value: str = "value", source: str = "batch_id", sequence: str = "delivery_id", window_seconds: int = 300, lateness_seconds: int = 720, first_report_seconds: int = 60) -> DataFrame:
    """One entry per key, period and source, of the records within the cut-off.

    A record counts if its value is finite, both times are there, and ``ingestion_time - event_time`` is
    from 0 to ``lateness_seconds``, both included; others are beyond the cut-off and leave no trace. It is
    late if it came after its window's first report, ``first_report_seconds`` after the window's end. A
    null source is one source of its own; a null sequence is lower than any. Values below 1e20 are summed as
    exact decimals, what lies beyond the sixth decimal (to the thirtieth) apart, so the order of arrival can't
    be seen in the sums; larger ones are summed as doubles in units of 2**64, so sums don't overflow. Columns other than the named ones are
    ignored; an empty table gives no entries. The records must hold each message once.
    """
    lag = F.unix_micros(ingestion_time) - F.unix_micros(event_time)
    start = period_start(event_time, window_seconds)
    report = (start + F.lit(window_seconds + first_report_seconds)) * F.lit(1_000_000)
    counted = records.where(finite(value) & lag.between(0, lateness_seconds * 1_000_000))
    named = counted.select(*[F.col(k) for k in keys], start.alias(PERIOD), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.coalesce(F.col(sequence).cast("long"), F.lit(-(2**63))).alias("seq"), (F.unix_micros(ingestion_time) > report).cast("long").alias("late"), F.col(value).alias("v"), F.col(ingestion_time).alias("seen"))
    number = F.col("v").cast("double")
    small = F.abs(number) < 1e20
    fixed = F.when(small, F.col("v").try_cast(T.DecimalType(26, 6)))
    rest = number - fixed.cast("double")
    return named.groupBy(*keys, PERIOD, "source").agg(
        F.max("seq").alias("version"), F.count("*").alias("readings"), F.sum("late").alias("late_readings"), F.sum(fixed).alias("value_sum"), F.sum(F.when(rest != 0, rest.try_cast(T.DecimalType(38, 30)))).alias("value_rest"), F.sum(F.when(~small, number / BIG)).alias("value_big"), F.min("v").alias("value_min"), F.max("v").alias("value_max"), F.max("seen").alias("last_seen")
    )


def registers(records: DataFrame, identity: Sequence[str], *, ingestion_time: str = "ingestion_time", sequence: str = "delivery_id") -> DataFrame:
    """One register per message of ``records``: the row with the earliest ``ingestion_time`` (null last), then the lowest ``sequence``.

    ``identity`` names the columns that identify a message together; where the last is null, a row is a
    message of its own, told from others by its ``sequence``, so that a slice that comes twice counts once.
    The columns are those of ``records``. No rows, no registers.
    """
    return merge_registers(identity, records, ingestion_time=ingestion_time, sequence=sequence)


def merge_registers(identity: Sequence[str], *states: DataFrame, ingestion_time: str = "ingestion_time", sequence: str = "delivery_id") -> DataFrame:
    """The registers of several states or slices together, whatever they share."""
    every = reduce(DataFrame.unionByName, states)
    cols = every.columns
    own = fresh("m_own", cols)
    last = F.col(identity[-1]).cast("string")
    named = every.withColumn(own, F.coalesce(F.concat(F.lit("m"), last), F.concat(F.lit("d"), F.col(sequence).cast("string"))))
    return kept_once(named, [*identity[:-1], own], ingestion_time, sequence).select(*cols)


def merge_entries(keys: Sequence[str], *states: DataFrame) -> DataFrame:
    """Of several sets of entries, per key, period and source the entry with the highest version.

    Entries of equal version that differ (a source that broke its promise) are ordered by their
    statistics, so the result doesn't depend on order either.
    """
    every = reduce(DataFrame.unionByName, states)
    best = F.max(F.struct(*ENTRY)).alias("best")
    return every.groupBy(*keys, PERIOD, "source").agg(best).select(*keys, PERIOD, "source", "best.*")


def read_counters(entries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum over sources: statistics per key and period, and how many readings came as corrections."""
    part = lambda c: F.coalesce(F.sum(c).cast("double"), F.lit(0.0))
    n = F.sum("readings")
    mean = (part("value_sum") + part("value_rest")) / n + part("value_big") / n * BIG
    return entries.groupBy(*keys, PERIOD).agg(
        F.sum("readings").alias("readings"), F.sum("late_readings").alias("corrections"), mean.alias("value_mean"), F.min("value_min").alias("value_min"), F.max("value_max").alias("value_max"), F.max("last_seen").alias("last_seen")
    )


def corrected_windows(records: DataFrame, keys: Sequence[str], **kw) -> DataFrame:
    """Statistics by event time with the corrections that came up to the cut-off, from merged registers (each message once).

    These registers' counters are one state, so there is no other to merge them with.
    """
    return read_counters(counter_entries(records, keys, **kw), keys)
