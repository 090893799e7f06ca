"""Sources and sinks: parquet, CSV (also zipped), JSON lines, message logs, file streams."""

from __future__ import annotations

import hashlib
import io
import json
import os
import shutil
import urllib.request
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.schema import WIRE_EVENT

WIDE_CSV = "timestamp TIMESTAMP, TP2 DOUBLE, DV_pressure DOUBLE, Oil_temperature DOUBLE, Motor_current DOUBLE, TP3 DOUBLE, H1 DOUBLE, Reservoirs DOUBLE"


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def wide_csv(spark: SparkSession, path: str, schema: str = WIDE_CSV) -> DataFrame:
    """Wide sensor rows of a CSV with a header; only the schema's columns are read, found by name."""
    wanted = T.StructType.fromDDL(schema)
    raw = spark.read.option("header", True).csv(path)
    return raw.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in wanted])


def wide_csv_in_zip(spark: SparkSession, archive: str, member: str, unpacked: str, schema: str = WIDE_CSV) -> DataFrame:
    """A CSV member of a zip archive; Spark has no zip codec, so the member is streamed out once to ``unpacked``."""
    target = Path(unpacked) / Path(member).name
    if not target.exists():
        target.parent.mkdir(parents=True, exist_ok=True)
        part = target.with_suffix(target.suffix + ".part")
        with zipfile.ZipFile(archive) as z, z.open(member) as source, part.open("wb") as sink:
            shutil.copyfileobj(source, sink)
        os.replace(part, target)
    return wide_csv(spark, str(target), schema)


def json_lines(spark: SparkSession, path: str, version: int = 1) -> DataFrame:
    """Readings from JSON lines; blank lines are skipped and missing fields get their defaults."""
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", WIRE_EVENT.add("stream", "string").add("channel", "string").add("unit", "string")).alias("e"))
    either = lambda c: F.coalesce(F.col(f"e.sensor.{c}"), F.col(f"e.{c}"), F.lit("")).alias(c)
    return rows.select(
        F.coalesce("e.schema_version", F.lit(version)).alias("schema_version"), "e.event_id", "e.asset_id", "e.asset_type", either("stream"), either("channel"), either("unit"), "e.value", "e.event_time",
        F.coalesce("e.ingestion_time", "e.event_time").alias("ingestion_time"), F.coalesce("e.source_event_time", "e.event_time").alias("source_event_time"),
    )


def rows(spark: SparkSession, data: list, schema) -> DataFrame:
    """An in-memory source."""
    return spark.createDataFrame(data, schema)


def write_json_lines(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string").alias("value")).write.text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def file_stream(spark: SparkSession, path: str, schema, *, fmt: str = "parquet", files_per_trigger: int = 1) -> DataFrame:
    """A stream of files in the order of their times; one file a trigger gives a controlled clock."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(path)


def parquet_stream(spark: SparkSession, path: str, schema, **options) -> DataFrame:
    """A stream over a parquet table that is a folder of files or one file."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema).options(**options)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile():
        return reader.option("pathGlobFilter", p.getName()).parquet(p.getParent().toString())
    return reader.parquet(path)


def kafka_available(spark: SparkSession) -> bool:
    """Whether the message-log connector is on the class path."""
    try:
        spark._jvm.java.lang.Class.forName("org.apache.spark.sql.kafka010.KafkaSourceProvider", False, spark._jvm.java.lang.Thread.currentThread().getContextClassLoader())
        return True
    except Exception:
        return False


def kafka_stream(spark: SparkSession, servers: str, topic: str, *, max_records: int | None = None) -> DataFrame:
    """``kafka_key``, ``payload``, ``kafka_time`` of a topic from its start; needs the connector."""
    if not kafka_available(spark):
        raise RuntimeError("the Kafka connector is not on the class path")
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest")
    if max_records:
        reader = reader.option("maxOffsetsPerTrigger", max_records)
    return reader.load().select(F.col("key").cast("string").alias("kafka_key"), F.col("value").alias("payload"), F.col("timestamp").alias("kafka_time"))


def kafka_batch_sink(df: DataFrame, servers: str, topic: str) -> None:
    """Write ``key`` and ``value`` with idempotent, fully acknowledged sends; needs the connector."""
    df.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("kafka.enable.idempotence", "true").option("kafka.acks", "all").save()


def sha256_file(path: str) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while chunk := f.read(io.DEFAULT_BUFFER_SIZE * 64):
            digest.update(chunk)
    return digest.hexdigest()


def fetch(url: str, path: str, force: bool = False) -> str:
    """Download once; a broken download never leaves a file at ``path``."""
    if force or not os.path.exists(path):
        part = path + ".part"
        with urllib.request.urlopen(url, timeout=300) as source, open(part, "wb") as sink:
            shutil.copyfileobj(source, sink)
        os.replace(part, path)
    return path


def manifest(df: DataFrame, path: str, **facts) -> dict:
    """Write the row count and what else is known about a dataset as JSON."""
    found = {"rows_total": df.count(), **facts}
    Path(path).write_text(json.dumps(found, indent=2, sort_keys=True))
    return found
