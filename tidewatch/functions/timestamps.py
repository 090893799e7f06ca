"""Times as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Zone at the end of an ISO-8601 time.
ZONE = r"(Z|z|[+-]\d{2}:?\d{2})$"
DATE = r"^\d{4}-\d{2}-\d{2}([T ].*)?$"


def parse_iso(text: Column | str) -> Column:
    """ISO-8601 text as a timestamp; naive times mean UTC; null where it is no valid time.

    Accepted are a date, or a date with a time after T or a blank, with fraction and with Z or an offset.
    Words, bare times, years and impossible dates give null, whatever the session's mode or time zone.
    """
    s = F.trim(F.col(text) if isinstance(text, str) else text)
    naive = ~F.substring(s, 11, 100).rlike(ZONE)
    full = F.when(F.length(s) == 10, F.concat(s, F.lit("T00:00:00"))).otherwise(s)
    zoned = F.when(naive, F.concat(full, F.lit("Z"))).otherwise(full)
    return F.when(s.rlike(DATE), zoned.try_cast("timestamp"))


def format_iso(ts: Column | str) -> Column:
    """UTC with Z, in a session of any time zone; microseconds only where there are some."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    whole = F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    return F.concat(whole, F.when(micros == 0, F.lit("")).otherwise(F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))), F.lit("Z"))


def lag_seconds(event_time: Column | str, ingestion_time: Column | str) -> Column:
    return (F.unix_micros(ingestion_time) - F.unix_micros(event_time)) / F.lit(1e6)
