"""Command line: prepare, replay, run, materialize, verdict, smoke. ``python -m tidewatch COMMAND --help``."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidewatch.config import EngineConfig
from tidewatch.operators import admit, aggregates, cdc, prepare, serving
from tidewatch.shared import scratch_path, ship
from tidewatch.sources import readers
from tidewatch.sources import replay as replays
from tidewatch.streaming import pipeline


def session() -> SparkSession:
    spark = SparkSession.builder.appName("tidewatch").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ship(spark)
    return spark


def prepare_command(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Cut a machine's record into a fleet; write it, a sample of wire events, and a manifest."""
    source = readers.wide_csv_in_zip(spark, a.zip, a.member, str(Path(a.out) / "unpacked")) if a.zip else readers.wide_csv(spark, a.csv)
    segments = spark.read.parquet(a.segments)
    fleet = prepare.cut_fleet(source, segments)
    readers.write_parquet(fleet, f"{a.out}/fleet")
    rows = spark.read.parquet(f"{a.out}/fleet").withColumn("at", F.to_timestamp("source_event_time"))
    sample = prepare.unpivot(prepare.first_minutes(rows, a.sample_minutes).drop("at"), version=1)
    readers.write_json_lines(sample.select(admit.encode_event(sample).alias("value")), "value", f"{a.out}/sample")
    facts = {"source": a.zip or a.csv, "sha256": readers.sha256_file(a.zip or a.csv)}
    if a.expect:
        checked = prepare.rows_as_expected(rows, segments, json.loads(Path(a.expect).read_text())).orderBy("asset_id").collect()  # a row per asset named in the file
        facts |= {"rows_by_asset": {r.asset_id: r.rows for r in checked}, "ok": all(r.ok for r in checked)}
    return readers.manifest(rows, f"{a.out}/manifest.json", **facts)


def replay_command(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Write a faulty replay of wide rows as one folder per step."""
    wide = spark.read.parquet(a.wide)
    out = replays.replay(prepare.unpivot(prepare.first_assets(wide, a.max_assets) if a.max_assets else wide, version=a.version), replays.SCENARIOS[a.scenario], seed=a.seed, speedup=a.speedup)
    replays.write_steps(out, a.out, a.step_seconds)
    return replays.fault_counts(out).first().asDict()


def run_command(spark: SparkSession, a: argparse.Namespace) -> dict:
    """The streaming job over a folder of readings, or from the raw topic to the others."""
    config = EngineConfig.from_env()
    if a.kafka:
        queries = pipeline.start_kafka(spark, a.root, a.checkpoint, config, once=a.once)
    else:
        queries = (pipeline.start(readers.parquet_stream(spark, a.source, spark.read.parquet(a.source).schema), a.root, a.checkpoint, config, once=a.once),)
    for query in queries:
        query.awaitTermination(a.seconds) if a.seconds else query.awaitTermination()
    for query in queries:
        query.stop()
    return {"batches": sum(len(query.recentProgress) for query in queries)}


def materialize_command(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Aggregates that come as JSON lines in a folder, into the serving table."""
    query = pipeline.start_materializer(spark.readStream.text(a.source), a.root, a.checkpoint, once=True)
    query.awaitTermination()
    counters = spark.read.parquet(f"{a.root}/counters").agg(F.sum("messages_seen").alias("messages_seen"), F.sum("errors").alias("errors")).first().asDict()
    return counters | serving.count_by_metric(cdc.read_published(spark, a.root, "aggregates")).first().asDict()


def verdict_command(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Fleet verdict of a serving table against labelled segments."""
    table = cdc.read_published(spark, a.root, "aggregates")
    labels = spark.read.parquet(a.segments).distinct()
    expected = labels.groupBy("asset_id").agg((F.count_if(F.col("condition_label") != a.healthy) * 2 > F.count("*")).alias("expected_air_leak"))
    verdict = serving.fleet_verdict(serving.health_rows(table, only_last=a.only_last))
    checked = serving.checked_verdict(verdict, expected)
    for row in serving.text_report(checked).orderBy("asset_id").toLocalIterator():
        print(row.line)
    return serving.fleet_checks(checked, serving.unexpected_assets(verdict, expected)).first().asDict()


def smoke_command(spark: SparkSession, a: argparse.Namespace) -> dict:
    """End to end without a broker: replay, wire form, admission, batch and streaming aggregates, two upserts."""
    wide = spark.read.parquet(a.wide)
    sent = replays.replay(prepare.unpivot(wide, version=1), replays.SCENARIOS["adverse"])
    wire = sent.select(F.col("asset_id").alias("kafka_key"), admit.encode_event(sent.withColumns({c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'") for c in ("event_time", "ingestion_time")})).alias("payload"))
    path = scratch_path(spark, "smoke")
    admit.decode_wire(wire).write.parquet(f"{path}/routed")
    routed = spark.read.parquet(f"{path}/routed")
    admit.admitted(routed).write.parquet(f"{path}/main")
    main = spark.read.parquet(f"{path}/main")
    batch = aggregates.formatted(aggregates.both(aggregates.dedup_in_window(aggregates.windowed(main, 300))))
    streamed = pipeline.run_to_end(spark, f"{path}/main")
    differing = serving.key_differences(batch, streamed, "aggregate_id").count()
    rows = batch.withColumns({"pane_index": F.lit(0), "arrival": F.lit(0).cast("long")})
    once = serving.latest_panes(rows, "arrival")
    twice = serving.upsert(once, rows, "arrival")
    counts = {r.route: r.n for r in routed.groupBy("route").agg(F.count("*").alias("n")).collect()}
    first, second = once.count(), twice.count()
    return {"routes": counts, "keys_differing": differing, "rows_after_first_pass": first, "rows_after_second_pass": second, "ok": differing == 0 and first == second > 0}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidewatch", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    p = sub.add_parser("prepare")
    for name in ("--csv", "--zip", "--member"):
        p.add_argument(name)
    p.add_argument("--segments", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--sample-minutes", type=int, default=5)
    p.add_argument("--expect", help="JSON file with the number of rows each asset must have")
    p = sub.add_parser("replay")
    p.add_argument("--wide", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--scenario", choices=sorted(replays.SCENARIOS), default="normal")
    p.add_argument("--seed", type=int, default=7)
    p.add_argument("--speedup", type=float, default=120.0)
    p.add_argument("--step-seconds", type=int, default=60)
    p.add_argument("--max-assets", type=int)
    p.add_argument("--version", type=int, default=1)
    p = sub.add_parser("run")
    p.add_argument("--source")
    p.add_argument("--kafka", action="store_true")
    p.add_argument("--root", required=True)
    p.add_argument("--checkpoint", required=True)
    p.add_argument("--once", action="store_true")
    p.add_argument("--seconds", type=int)
    p = sub.add_parser("materialize")
    for name in ("--source", "--root", "--checkpoint"):
        p.add_argument(name, required=True)
    p = sub.add_parser("verdict")
    p.add_argument("--root", required=True)
    p.add_argument("--segments", required=True)
    p.add_argument("--healthy", default="sano")
    p.add_argument("--only-last", action="store_true")
    p = sub.add_parser("smoke")
    p.add_argument("--wide", required=True)
    a = parser.parse_args(argv)
    result = {"prepare": prepare_command, "replay": replay_command, "run": run_command, "materialize": materialize_command, "verdict": verdict_command, "smoke": smoke_command}[a.command](session(), a)
    print(json.dumps(result, sort_keys=True))
    return int(result.get("ok") is False)


if __name__ == "__main__":
    sys.exit(main())
