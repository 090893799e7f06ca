"""From wide sensor rows to readings: segments, unpivot, slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.timestamps import format_iso, parse_iso
from tidewatch.operators.late import finite
from tidewatch.schema import STREAMS


def in_segments(rows: DataFrame, segments: DataFrame, *, time: str = "source_event_time", keep_all: bool = False) -> DataFrame:
    """Rows with the segments of their asset that contain their time (start included, end excluded).

    Repeated segments count once; rows without a valid time, and segments without valid bounds, match
    nothing. Asset and day are joined first, so a segment meets only the rows of its own days.
    """
    s = segments.distinct().select(F.col("asset_id").alias("s_asset"), parse_iso("starts_at").alias("s_from"), parse_iso("ends_at").alias("s_to"), "condition_label", "failure_ref").where("s_from < s_to")
    days = s.withColumn("s_day", F.explode(F.sequence(F.to_date("s_from"), F.to_date("s_to"))))
    timed = rows.withColumn("at", parse_iso(time)).withColumn("at_day", F.to_date("at"))
    on = (F.col("asset_id") == F.col("s_asset")) & (F.col("at_day") == F.col("s_day")) & (F.col("at") >= F.col("s_from")) & (F.col("at") < F.col("s_to"))
    return timed.join(days, on, "left" if keep_all else "inner").drop("s_asset", "s_day", "at_day")


def channel_column(channel: str) -> str:
    """Name of a channel's column in the wide table."""
    return channel.lower()


def unpivot(wide: DataFrame, *, version: int = 2, asset_type: str | None = None, event_time: Column | None = None, ingestion_time: Column | None = None) -> DataFrame:
    """One reading per row and channel of the streams known in ``version``; cells that aren't finite are left out.

    ``event_id`` is ``asset|stream|source time``; the event time is the source time unless given, the
    ingestion time the event time unless given. Rows without a valid time have no readings.
    """
    chosen = [s for s in STREAMS if s[3] <= version]
    source = parse_iso("source_event_time")
    cells = F.array(*[F.struct(F.lit(s).alias("stream"), F.lit(c).alias("channel"), F.lit(u).alias("unit"), F.col(channel_column(c)).alias("value")) for s, c, u, _ in chosen])
    long = wide.withColumn("src", source).where(F.col("src").isNotNull()).withColumn("cell", F.explode(cells)).where(finite(F.col("cell.value")))
    text = format_iso("src")
    happened = event_time if event_time is not None else F.col("src")
    return long.select(
        F.lit(version).alias("schema_version"), F.concat_ws("|", "asset_id", "cell.stream", text).alias("event_id"), "asset_id", F.lit(asset_type).cast("string").alias("asset_type"), "cell.stream", "cell.channel", "cell.unit", "cell.value", happened.alias("event_time"),
        (ingestion_time if ingestion_time is not None else happened).alias("ingestion_time"), text.alias("source_event_time"),
    )


def first_minutes(rows: DataFrame, minutes: int, *, time: str = "at") -> DataFrame:
    """Rows in the first ``minutes`` of each asset, from its earliest time on.

    The earliest time is aggregated and joined back, not found by a window over all rows of an asset.
    """
    start = rows.groupBy(F.col("asset_id").alias("f_asset")).agg(F.min(time).alias("f_start"))
    until = F.timestamp_micros(F.unix_micros("f_start") + F.lit(minutes * 60_000_000))
    return rows.join(start, F.col("asset_id").eqNullSafe(F.col("f_asset"))).where(F.col(time) < until).drop("f_asset", "f_start")


def first_assets(rows: DataFrame, n: int) -> DataFrame:
    """Rows of the first ``n`` assets by name."""
    return rows.join(rows.select("asset_id").distinct().orderBy("asset_id").limit(n), "asset_id", "left_semi")


def segment_counts(rows: DataFrame, segments: DataFrame) -> DataFrame:
    """Rows per segment."""
    return in_segments(rows, segments).groupBy("asset_id", format_iso("s_from").alias("starts_at"), "condition_label").agg(F.count("*").alias("rows"))


def asset_span(rows: DataFrame, time: str = "at") -> DataFrame:
    """First and last time and duration in seconds per asset."""
    seconds = (F.unix_micros(F.max(time)) - F.unix_micros(F.min(time))) / F.lit(1e6)
    return rows.groupBy("asset_id").agg(format_iso(F.min(time)).alias("first_time"), format_iso(F.max(time)).alias("last_time"), seconds.alias("duration_s"))


def rows_as_expected(rows: DataFrame, segments: DataFrame, expected: dict[str, int]) -> DataFrame:
    """``asset_id``, ``rows``, ``expected``, ``ok``: rows per asset in its segments against what is known of the source."""
    got = in_segments(rows, segments).groupBy(F.col("asset_id").alias("g_asset")).agg(F.count("*").alias("rows"))
    want = rows.sparkSession.createDataFrame(sorted(expected.items()), "asset_id string, expected long")
    joined = want.join(got, F.col("asset_id") == F.col("g_asset"), "left")
    return joined.select("asset_id", F.coalesce("rows", F.lit(0)).alias("rows"), "expected", (F.coalesce("rows", F.lit(0)) == F.col("expected")).alias("ok"))


def cut_fleet(source: DataFrame, segments: DataFrame, time: str = "timestamp") -> DataFrame:
    """Wide rows of one machine's record as a fleet: each segment's rows get the segment's asset.

    ``source`` has a timestamp column and the channels; a row in two segments comes out for both. Days are
    joined first, as in :func:`in_segments`.
    """
    s = segments.distinct().select("asset_id", parse_iso("starts_at").alias("s_from"), parse_iso("ends_at").alias("s_to")).where("s_from < s_to")
    days = s.withColumn("s_day", F.explode(F.sequence(F.to_date("s_from"), F.to_date("s_to"))))
    timed = source.withColumn("at_day", F.to_date(time))
    on = (F.col("at_day") == F.col("s_day")) & (F.col(time) >= F.col("s_from")) & (F.col(time) < F.col("s_to"))
    channels = [F.col(c).alias(channel_column(c)) for _, c, _, _ in STREAMS]
    return timed.join(days, on).select("asset_id", format_iso(time).alias("source_event_time"), *channels).orderBy("asset_id", "source_event_time")
