"""Types, registries and fixed names of the engine's records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Versions of the wire contract that are read.
VERSIONS = (1, 2)
#: Fields a wire event must have, in the order they are looked for; fixed values.
REQUIRED = ("schema_version", "event_id", "asset_id", "sensor", "value", "event_time", "ingestion_time")
#: Streams: name, channel in the source, unit, first version; fixed values.
STREAMS = (
    ("motor_current", "Motor_current", "A", 1),
    ("oil_temperature", "Oil_temperature", "degC", 1),
    ("tp2_pressure", "TP2", "bar", 1),
    ("dv_pressure", "DV_pressure", "bar", 1),
    ("tp3_pressure", "TP3", "bar", 2),
    ("h1_pressure", "H1", "bar", 2),
    ("reservoirs_pressure", "Reservoirs", "bar", 2),
)
STREAM_NAMES = tuple(s[0] for s in STREAMS)
#: Kinds of aggregate, as stored in the serving table.
SIGNAL_STATS, HEALTH = "apu_signal_stats", "apu_health_indicator"

WIRE_EVENT = T.StructType(
    [
        T.StructField("schema_version", T.IntegerType()), T.StructField("event_id", T.StringType()), T.StructField("asset_id", T.StringType()), T.StructField("asset_type", T.StringType()),
        T.StructField("sensor", T.StructType([T.StructField("stream", T.StringType()), T.StructField("channel", T.StringType()), T.StructField("unit", T.StringType())])),
        T.StructField("value", T.DoubleType()), T.StructField("event_time", T.StringType()), T.StructField("ingestion_time", T.StringType()), T.StructField("source_event_time", T.StringType()),
    ]
)


def stream_registry(spark: SparkSession) -> DataFrame:
    """The seven streams as a table."""
    return spark.createDataFrame(list(STREAMS), "stream string, channel string, unit string, schema_version int")
