"""The streaming job: source, admission, watermark, deduplication, both aggregations, serving sink."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tidewatch.config import EngineConfig
from tidewatch.operators import admit, aggregates, cdc, serving
from tidewatch.operators.late import period_start
from tidewatch.shared import scratch_path
from tidewatch.sources import readers
from tidewatch.streaming.panes import panes, replayed

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def update_aggregates(main: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Running totals per window of admitted readings, for update mode; one deduplication feeds both aggregations.

    The watermark's delay is the allowed lateness, so a window's state lives as long as corrections may come.
    """
    marked = main.withWatermark("event_time", f"{config.allowed_lateness_seconds} seconds")
    once = aggregates.windowed(marked, config.window_seconds).dropDuplicates(["asset_id", "w", "event_id"])
    return aggregates.formatted(aggregates.both(once.drop("event_time", "ingestion_time"), config), config)


def pane_stream(main: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Panes of both kinds of a stream of admitted readings, as records with identifier and window texts."""
    marked = main.withWatermark("event_time", f"{config.allowed_lateness_seconds} seconds")
    arrival = F.col("delivery_id").cast("long") if "delivery_id" in main.columns else F.lit(0).cast("long")
    named = marked.select("asset_id", "stream", "unit", "event_id", "value", "event_time", period_start("event_time", config.window_seconds).alias("window_s"), F.unix_micros("ingestion_time").alias("seen"), arrival.alias("arrival"))
    return pane_records(panes(named, config), config)


def pane_records(given: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    w = F.struct(F.timestamp_seconds("window_s").alias("start"), F.timestamp_seconds(F.col("window_s") + config.window_seconds).alias("end"))
    return aggregates.formatted(given.withColumns({"w": w, "emitted_at": F.current_timestamp()}), config)


class ServingSink:
    """``foreachBatch`` target: upserts each micro-batch of panes into a published table.

    A pane at least as high as the stored one replaces it; a batch that is run again changes nothing. Only
    the buckets of changed aggregates are written. ``keep_history`` appends every pane to a second table as
    well.
    """

    def __init__(self, root: str, name: str = "aggregates", keep_history: bool = False, buckets: int = 64) -> None:
        self.root, self.name, self.keep_history, self.buckets = root, name, keep_history, buckets

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        rows = batch
        if "pane_index" not in rows.columns:  # running totals: the micro-batch is the pane
            rows = rows.withColumn("pane_index", F.lit(batch_id).cast("int"))
        again = F.coalesce(F.col("is_last").cast("long"), F.lit(0)) if "is_last" in rows.columns else F.lit(0)
        rows = rows.withColumn("arrival", F.lit(batch_id).cast("long") * 2 + again)
        if self.keep_history:
            rows.write.mode("overwrite").parquet(f"{self.root}/{self.name}-history/batch={batch_id}")
        cdc.upsert_buckets(rows, self.root, self.name, "aggregate_id", lambda stored, new: serving.upsert(stored, new, "arrival"), buckets=self.buckets)


def kafka_sink(config: EngineConfig, topic: str, key: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` target that sends rows to a topic as canonical JSON under the key column."""
    return lambda batch, batch_id: readers.kafka_batch_sink(admit.kafka_record(batch, F.coalesce(key, F.lit(""))), config.bootstrap_servers, topic)


def start(stream: DataFrame, root: str, checkpoint: str, config: EngineConfig = EngineConfig(), *, once: bool = False, sink: Callable[[DataFrame, int], None] | None = None, with_panes: bool = True) -> StreamingQuery:
    """Start the job on a stream of flat readings; ``once`` ends it when the source is read to its end.

    ``sink`` takes each micro-batch's panes instead of the serving table under ``root``. Without panes the
    native aggregation gives running totals per micro-batch, whose number is the pane.
    """
    main = admit.with_units(admit.admitted(admit.admit_columns(stream, config)).drop("lag_s"))
    spark = stream.sparkSession
    before = spark.conf.get(STATE_STORE)
    if with_panes:
        spark.conf.set(STATE_STORE, ROCKSDB)  # a query keeps the store it was started with
    try:
        made = pane_stream(main, config) if with_panes else update_aggregates(main, config)
        writer = made.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(sink or ServingSink(root))
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{config.early_firing_seconds} seconds")).start()
    finally:
        spark.conf.set(STATE_STORE, before)


def start_wire(stream: DataFrame, root: str, checkpoint: str, config: EngineConfig = EngineConfig(), *, once: bool = False, sinks: dict[str, Callable[[DataFrame, int], None]] | None = None) -> StreamingQuery:
    """Raw records: admitted ones, quarantined ones, overdue ones and counters are written to four tables per micro-batch.

    ``sinks`` (by the tables' names) take them as well, topics for instance.
    """

    def route(batch: DataFrame, batch_id: int) -> None:
        routed = admit.decode_wire(batch, config=config).persist()
        try:
            for name, rows in (("admitted", admit.admitted(routed)), ("quarantine", admit.quarantined(routed)), ("too_late", admit.too_late(routed)), ("counters", admit.route_counts(routed))):
                rows.write.mode("overwrite").parquet(f"{root}/{name}/batch={batch_id}")
                if sinks and name in sinks:
                    sinks[name](rows, batch_id)
        finally:
            routed.unpersist()

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(route)
    return (writer.trigger(availableNow=True) if once else writer).start()


#: What the materializer reads of an aggregate's message.
AGGREGATE = "schema_version int, aggregate_id string, metric_type string, asset_id string, stream string, unit string, window_start string, window_end string, pane_index int, pane_timing string, is_first boolean, is_last boolean, emitted_at string, corrections_close_at string, readings long, value_mean double, value_min double, value_max double, value_stddev double, motor_readings long, running_ratio double, oil_temperature_mean double, air_leak_suspected boolean"


def start_materializer(messages: DataFrame, root: str, checkpoint: str, *, once: bool = False, idle_order: str | None = None) -> StreamingQuery:
    """Upsert aggregates that come as JSON messages (column ``value``) into the published table under ``root``.

    Messages that aren't JSON, or lack identifier or pane, are counted in ``errors`` and skipped. Within a
    micro-batch, ``idle_order`` (a message time, say) orders messages of equal pane.
    """

    def fold(batch: DataFrame, batch_id: int) -> None:
        within = F.unix_micros(idle_order) if idle_order else F.monotonically_increasing_id()
        parsed = batch.select(F.from_json(F.col("value").cast("string"), AGGREGATE).alias("a"), within.alias("within"))
        good = F.coalesce(F.col("a.aggregate_id").isNotNull() & F.col("a.pane_index").isNotNull(), F.lit(False))
        rows = parsed.where(good).select("a.*", F.struct(F.lit(batch_id).cast("long").alias("batch"), F.col("within").cast("long").alias("within")).alias("arrival"))
        parsed.agg(F.lit(batch_id).alias("batch"), F.count("*").alias("messages_seen"), F.count_if(~good).alias("errors")).write.mode("overwrite").parquet(f"{root}/counters/batch={batch_id}")
        cdc.upsert_buckets(rows, root, "aggregates", "aggregate_id", lambda stored, new: serving.upsert(stored, new, "arrival"))

    writer = messages.writeStream.option("checkpointLocation", checkpoint).foreachBatch(fold)
    return (writer.trigger(availableNow=True) if once else writer).start()


def start_kafka(spark: SparkSession, root: str, checkpoint: str, config: EngineConfig = EngineConfig(), *, once: bool = False) -> tuple[StreamingQuery, StreamingQuery]:
    """Topic to topics: raw records are routed, quarantined and overdue ones sent on, and the admitted ones' panes sent as features.

    Two queries, both from the raw topic; needs the connector on the class path.
    """
    raw = lambda: readers.kafka_stream(spark, config.bootstrap_servers, config.raw_topic)
    return start_topics(raw, root, checkpoint, config, once=once, sinks={"quarantine": kafka_sink(config, config.quarantine_topic, "key"), "too_late": kafka_sink(config, config.too_late_topic, "key")}, features=kafka_sink(config, config.features_topic, "aggregate_id"))


def start_topics(raw: Callable[[], DataFrame], root: str, checkpoint: str, config: EngineConfig, *, once: bool = False, sinks: dict[str, Callable[[DataFrame, int], None]], features: Callable[[DataFrame, int], None]) -> tuple[StreamingQuery, StreamingQuery]:
    """The job of :func:`start_kafka` with any source of ``kafka_key, payload`` and any sinks."""
    lateral = start_wire(raw(), f"{root}/wire", f"{checkpoint}/wire", config, once=once, sinks=sinks)
    main = admit.admitted(admit.decode_wire(raw(), config=config)).select("event_id", "asset_id", "stream", "unit", "value", "event_time", "ingestion_time")
    serve = ServingSink(root)

    def both(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        try:
            features(kept, batch_id)
            serve(kept, batch_id)
        finally:
            kept.unpersist()

    return lateral, start(main, root, f"{checkpoint}/panes", config, once=once, sink=both)


def run_to_end(spark: SparkSession, path: str, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Run the job over the files of a readings table and give the serving table that comes out."""
    have = spark.read.parquet(path)
    schema = have.select("event_id", "asset_id", "stream", "unit", "value", "event_time", "ingestion_time", *(["delivery_id"] if "delivery_id" in have.columns else [])).schema
    stream = readers.parquet_stream(spark, path, schema)
    root = scratch_path(spark, "stream-serving")
    query = start(stream, root, f"{root}/checkpoint", config, once=True)
    query.awaitTermination()
    return cdc.read_published(spark, root, "aggregates")


def replay_panes(readings: DataFrame, config: EngineConfig = EngineConfig(), arrival: str = "delivery_id") -> DataFrame:
    """Panes of a stored feed of readings in the order of ingestion, one early firing interval per trigger."""
    main = admit.with_units(admit.admitted(admit.admit_columns(readings, config)).drop("lag_s"))
    return replayed(aggregates.windowed(main, config.window_seconds), config, arrival)


def run_panes(spark: SparkSession, path: str, config: EngineConfig = EngineConfig(), files_per_trigger: int | None = None) -> DataFrame:
    """The panes that reading a table's files to the end gives out."""
    cols = ("event_id", "asset_id", "stream", "unit", "value", "event_time", "ingestion_time")
    limit = {"maxFilesPerTrigger": files_per_trigger} if files_per_trigger else {}
    stream = readers.parquet_stream(spark, path, spark.read.parquet(path).select(*cols).schema, **limit)
    root = scratch_path(spark, "stream-panes")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/panes/batch={batch_id}")

    start(stream, root, f"{root}/checkpoint", config, once=True, sink=keep).awaitTermination()
    return spark.read.parquet(f"{root}/panes").withColumn("window_s", F.unix_seconds(F.to_timestamp("window_start")))


class Counters(StreamingQueryListener):
    """Input rows, rows dropped behind the watermark and repeats dropped, summed over a query's micro-batches."""

    def __init__(self) -> None:
        self.input_rows = self.dropped_late = self.duplicates_dropped = 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.input_rows += p.numInputRows
        for s in p.stateOperators:
            self.dropped_late += s.numRowsDroppedByWatermark
            self.duplicates_dropped += int(s.customMetrics.get("numDroppedDuplicateRows", 0))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
