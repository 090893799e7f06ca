"""A change feed applied: an embedded DuckDB table per bucket, conditional upserts, one atomic publication.

Keys are hashed into buckets. Before they are sent, each Arrow batch is reduced to its newest change per
key, so a key with a third of all changes sends one row per batch. Each bucket then upserts its batches
into a DuckDB table with the key as primary key; on conflict the row changes only if the incoming sequence
is higher than the stored one. Deletes stay as tombstones, so a late older change can't bring a row back.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.shared import delete_path, fresh, partitions_for

LOWEST = -(2**63)


def is_delete(op: str) -> Column:
    """True for delete in any spelling ('delete', 'D', ...); anything else, null too, is an upsert."""
    return F.coalesce(F.lower(F.trim(F.col(op))).isin("d", "del", "delete", "remove"), F.lit(False))


def _quoted(names: Sequence[str], prefix: str = "") -> str:
    return ", ".join(prefix + '"' + n.replace('"', '""') + '"' for n in names)


def apply_changes(changes: DataFrame, key: str, sequence: Sequence[str], op: str, *, buckets: int | None = None, memory_mb: int = 384) -> DataFrame:
    """The state after all changes: one row per key, with the columns of ``changes`` and ``deleted``.

    The change with the highest ``sequence`` (compared column by column, null lowest) is the one shown,
    whatever the order or repetition of arrival; of changes equal in the whole sequence any one, as they
    can't be told apart. Rows whose key is null change nothing. Tombstones are rows with ``deleted`` true.
    An empty feed gives an empty state. ``memory_mb`` bounds a bucket's table; buckets are sized from the
    input so that it suffices.
    """
    cols = changes.columns
    gone = fresh("deleted", cols)
    ranks = [fresh(f"c_rank{i}", cols) for i in range(len(sequence))]
    bucket = fresh("c_bucket", cols)
    n = buckets or partitions_for(changes, 16 << 20)
    times = [f.name for f in changes.schema if isinstance(f.dataType, T.TimestampType)]
    sent = changes.where(F.col(key).isNotNull()).withColumns({gone: is_delete(op), **{r: F.coalesce(F.col(s).cast("long"), F.lit(LOWEST)) for r, s in zip(ranks, sequence)}, bucket: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")})
    sent = sent.withColumns({c: F.unix_micros(c) for c in times})
    keep = [*cols, gone, *ranks]
    newest = f"QUALIFY row_number() OVER (PARTITION BY {_quoted([key])} ORDER BY {', '.join(_quoted([r]) + ' DESC' for r in ranks)}) = 1"

    def connect():
        import duckdb

        return duckdb.connect(":memory:", config={"threads": 1, "memory_limit": f"{memory_mb}MB", "temp_directory": "", "preserve_insertion_order": False})

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = connect()
        for b in batches:
            con.register("incoming", pa.Table.from_batches([b]))
            out = con.sql(f"SELECT {_quoted(b.schema.names)} FROM incoming {newest}").to_arrow_table().cast(b.schema)
            con.unregister("incoming")
            yield from out.to_batches()

    def upserted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con, schema = None, None
        for b in batches:
            t = pa.Table.from_batches([b]).select(keep)
            con_new = con is None
            con = con or connect()
            con.register("incoming", t)
            if con_new:
                schema = t.schema
                con.execute("CREATE TABLE stored AS SELECT * FROM incoming LIMIT 0")
                con.execute(f"ALTER TABLE stored ADD PRIMARY KEY ({_quoted([key])})")
            con.execute(
                f"INSERT INTO stored SELECT {_quoted(keep)} FROM incoming {newest} ON CONFLICT ({_quoted([key])}) DO UPDATE SET {', '.join(f'{_quoted([c])} = excluded.{_quoted([c])}' for c in keep if c != key)} WHERE ({_quoted(ranks, 'excluded.')}) > ({_quoted(ranks, 'stored.')})"
            )
            con.unregister("incoming")
        if con is not None:
            out = con.sql(f"SELECT {_quoted([*cols, gone])} FROM stored").to_arrow_table()
            yield from out.cast(pa.schema([schema.field(c) for c in [*cols, gone]])).to_batches(max_chunksize=20_000)

    inner = T.StructType([sent.schema[c] for c in [*cols, gone]])
    state = sent.mapInArrow(reduced, sent.schema).repartitionById(n, F.col(bucket)).mapInArrow(upserted, inner)
    return state.withColumns({c: F.timestamp_micros(c) for c in times})


def publish(state: DataFrame, root: str, name: str) -> str:
    """Write a new version of table ``name`` and switch to it at once; readers see the old or the new one whole."""
    version = f"v-{uuid.uuid4().hex}"
    base = f"{root.rstrip('/')}/{name}"
    state.write.parquet(f"{base}/{version}")
    _point(state.sparkSession, base, version)
    return f"{base}/{version}"


def upsert_buckets(incoming: DataFrame, root: str, name: str, key: str, merge: Callable[[DataFrame, DataFrame], DataFrame], *, buckets: int = 64) -> None:
    """Upsert into a published table that is kept in buckets of ``key``: only those of incoming keys are read and written.

    ``merge`` gives the rows that stored and incoming ones leave. The pointer names each bucket's version and
    switches at once; versions that neither the new pointer nor the one before it names are deleted. The
    number of buckets is fixed by the table's first write. Without rows nothing is written, unless there is
    no table yet.
    """
    spark = incoming.sparkSession
    base = f"{root.rstrip('/')}/{name}"
    text = _pointer(spark, base) if _exists(spark, f"{base}/_CURRENT") else None
    now = json.loads(text) if text else {"buckets": buckets, "versions": {}, "before": []}
    n, versions = now["buckets"], dict(now["versions"])
    bucket = fresh("c_bucket", incoming.columns)
    of = F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    rows = incoming.persist()
    try:
        touched = {str(r[0]) for r in rows.select(of).distinct().collect()}  # at most a row per bucket
        if not touched and text:
            return
        paths = [f"{base}/{versions[b]}/{bucket}={b}" for b in sorted(touched) if b in versions]
        stored = spark.read.parquet(*paths) if paths else rows.limit(0)
        version = f"v-{uuid.uuid4().hex}"
        merge(stored, rows).withColumn(bucket, of).repartition(min(n, max(1, len(touched))), bucket).write.partitionBy(bucket).parquet(f"{base}/{version}")
    finally:
        rows.unpersist()
    live = set(versions.values())
    versions |= {b: version for b in touched}
    kept = set(versions.values())
    schema = merge(stored, rows).schema.jsonValue()
    _point(spark, base, json.dumps({"buckets": n, "versions": versions, "before": sorted(live - kept), "bucket": bucket, "schema": schema}))
    for old in now["before"]:
        delete_path(spark, f"{base}/{old}")


def _point(spark: SparkSession, base: str, text: str) -> None:
    """Write the pointer of a table and put it in place by one rename."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    fs = jvm.org.apache.hadoop.fs
    tmp, pointer = fs.Path(f"{base}/_{uuid.uuid4().hex}"), fs.Path(f"{base}/_CURRENT")
    out = tmp.getFileSystem(conf).create(tmp, True)
    out.write(bytearray(text.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
    options[0] = fs.Options.Rename.OVERWRITE
    fs.FileContext.getFileContext(tmp.toUri(), conf).rename(tmp, pointer, options)


def read_published(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The current version of a published table, of one version or in buckets."""
    base = f"{root.rstrip('/')}/{name}"
    text = _pointer(spark, base)
    if not text.startswith("{"):
        return spark.read.parquet(f"{base}/{text}")
    now = json.loads(text)
    reader = spark.read.schema(T.StructType.fromJson(now["schema"]))
    paths = [f"{base}/{v}/{now['bucket']}={b}" for b, v in sorted(now["versions"].items())]
    return reader.parquet(*paths) if paths else spark.createDataFrame([], T.StructType.fromJson(now["schema"]))


def vacuum(spark: SparkSession, root: str, name: str) -> int:
    """Delete all versions of a published table that its pointer doesn't name; for when no reader holds an older one."""
    base = f"{root.rstrip('/')}/{name}"
    text, gone = _pointer(spark, base), 0
    current = set(json.loads(text)["versions"].values()) if text.startswith("{") else {text}
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    for status in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path):
        leaf = status.getPath().getName()
        if leaf.startswith("v-") and leaf not in current:
            delete_path(spark, status.getPath().toString())
            gone += 1
    return gone


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _pointer(spark: SparkSession, base: str) -> str:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{base}/_CURRENT")
    stream = path.getFileSystem(conf).open(path)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()
