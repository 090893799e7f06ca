"""Queries of the problems of this package (p3, p7, p8, p9) and their SQL.

SQL can't say p7 to p9 (look-alike folding, a tokenizer, an iteration); they are tested against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import leaks, mixing, percentiles, residue


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p3_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles per stream and asset."""
    return percentiles.group_percentiles(table(spark, sf_dir, "sensor_readings").select("stream", "asset_id", "value"), ("stream", "asset_id"), "value")


def p3_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from summaries of single days, within the stated error bound."""
    sent = table(spark, sf_dir, "sensor_readings").select("stream", "asset_id", "value", F.floor(F.unix_micros("event_time") / F.lit(86_400_000_000)).cast("long").alias("day"))
    return percentiles.combined(percentiles.slice_summaries(sent, ("stream", "asset_id"), "day", "value"), ("stream", "asset_id"))


def p3_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the combined percentiles' ranks, counted over all values, are off by at most a thousandth of the readings."""
    off = percentiles.rank_errors(table(spark, sf_dir, "sensor_readings").select("stream", "asset_id", "value"), p3_combined(spark, sf_dir), ("stream", "asset_id"), "value")
    return off.select("stream", "asset_id", "permille", "readings", (F.col("off") * 1000 <= F.col("readings")).alias("within"))


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaking documents, the items they leak and the longest run of each."""
    return leaks.leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with 15 or more consecutive words of an item."""
    return p7_leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mix with their tokens and copies."""
    return mixing.mix_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), mixing.tokenizer_path())


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares of the mix."""
    return mixing.shares(p8_mix(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p9_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with residue, by kind."""
    return residue.residue(table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with residue in place of dialogue."""
    return p9_residue(spark, sf_dir).select("doc_id").distinct()


def p9_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents per source and language that are left without them."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return residue.without_residue(documents).groupBy("source", "lang").count().withColumnRenamed("count", "documents")


PERMILLE = "(VALUES (100), (500), (900), (990)) AS p(permille)"

P3_PERCENTILES = f"""WITH ranked AS (
  SELECT stream, asset_id, value, row_number() OVER w AS rn, count(*) OVER (PARTITION BY stream, asset_id) AS n
  FROM sensor_readings WHERE value IS NOT NULL AND isfinite(value) WINDOW w AS (PARTITION BY stream, asset_id ORDER BY value))
SELECT stream, asset_id, CAST(permille AS INTEGER) AS permille, n AS readings, value AS percentile FROM ranked, {PERMILLE}
WHERE rn = greatest(1, (permille * n + 999) // 1000)"""

P3_COMBINED = f"""WITH ranked AS (
  SELECT stream, asset_id, CAST(make_timestamp(epoch_us(event_time)) AS DATE) AS day, value, row_number() OVER w AS rn, count(*) OVER (PARTITION BY stream, asset_id, CAST(make_timestamp(epoch_us(event_time)) AS DATE)) AS n
  FROM sensor_readings WHERE value IS NOT NULL AND isfinite(value) WINDOW w AS (PARTITION BY stream, asset_id, CAST(make_timestamp(epoch_us(event_time)) AS DATE) ORDER BY value)),
sizes AS (SELECT DISTINCT stream, asset_id, day, n FROM ranked),
kept AS (SELECT DISTINCT stream, asset_id, day, greatest(1, (i * n + 1023) // 1024) AS rn FROM sizes, range(1, 1025) AS g(i)
  UNION SELECT stream, asset_id, day, greatest(1, CAST(floor(n / (1024 * pow(2, j))) AS BIGINT)) FROM sizes, range(1, 41) AS h(j)
  UNION SELECT stream, asset_id, day, n - CAST(floor(n / (1024 * pow(2, j))) AS BIGINT) FROM sizes, range(1, 41) AS h(j)),
points AS (SELECT stream, asset_id, value, rn - lag(rn, 1, 0) OVER (PARTITION BY stream, asset_id, day ORDER BY rn) AS weight FROM ranked JOIN kept USING (stream, asset_id, day, rn)),
summed AS (SELECT stream, asset_id, value, sum(weight) AS weight FROM points GROUP BY ALL),
run AS (SELECT *, sum(weight) OVER (PARTITION BY stream, asset_id ORDER BY value) AS upto, sum(weight) OVER (PARTITION BY stream, asset_id) AS total FROM summed)
SELECT stream, asset_id, CAST(permille AS INTEGER) AS permille, CAST(max(total) AS BIGINT) AS readings, min(value) AS percentile FROM run, {PERMILLE}
WHERE upto >= greatest(1, (permille * total + 999) // 1000) GROUP BY stream, asset_id, permille"""

P3_ERROR = f"""SELECT stream, asset_id, CAST(permille AS INTEGER) AS permille, count(*) AS readings, true AS within
FROM sensor_readings, {PERMILLE} WHERE value IS NOT NULL AND isfinite(value) GROUP BY stream, asset_id, permille"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p3_percentiles": p3_percentiles, "p3_combined": p3_combined, "p3_error": p3_error, "p7_found": p7_found, "p7_leaks": p7_leaks, "p8_mix": p8_mix, "p8_shares": p8_shares, "p9_found": p9_found, "p9_residue": p9_residue, "p9_clean": p9_clean}


def oracle_sql() -> dict[str, str]:
    return {"p3_percentiles": P3_PERCENTILES, "p3_combined": P3_COMBINED, "p3_error": P3_ERROR}
