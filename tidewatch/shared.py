"""Session helpers: shared folder, written intermediate tables, partition counts."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors see.

    Where the session names none, a temporary folder is made and set on a single machine (a ``local``
    master); on a cluster that is an error.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors see")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tidewatch-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Let Python workers find this package where it isn't installed, by the path it was imported from."""
    root = str(Path(__file__).resolve().parents[1])
    environment = spark.sparkContext.environment
    if not re.match(r"local", spark.sparkContext.master):
        _send(spark, root)
    known = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([root, *known])


def _send(spark: SparkSession, root: str) -> None:
    """Send the package to the executors, once per session, as they may not see the path it was imported from."""
    sc = spark.sparkContext
    if getattr(sc, "_tidewatch_sent", False):
        return
    folder = tempfile.mkdtemp(prefix="tidewatch-code-")  # on the driver, which serves the file from it
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.addPyFile(shutil.make_archive(f"{folder}/tidewatch", "zip", root, "tidewatch"))
    sc._tidewatch_sent = True


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidewatch/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def files_bytes(spark: SparkSession, path: str) -> int:
    """The size of a written table's files."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return int(p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength())


def hashed_bytes(df: DataFrame) -> int:
    """About the memory that ``df`` takes when it is broadcast, where a row is held as a key and as a value; this reads it."""
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind == "string"]
    row = 2 * (8 + 8 * len(df.columns)) + 32
    return int(df.agg(F.sum(sum((2 * t for t in texts), F.lit(row)).cast("long")).alias("n")).first().n or 0)


def drop_written(*tables: DataFrame) -> None:
    """Delete the files behind what :func:`written` gave, once nothing reads them any more."""
    for df in tables:
        for folder in {os.path.dirname(f) for f in df.inputFiles()}:
            delete_path(df.sparkSession, folder)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the plan (file sizes for scans), without running it; 0 where it knows none.

    In-memory rows and what is derived from Python have no estimate; Catalyst then takes 2**63 bytes a leaf.
    """
    found = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return found if found < 1 << 56 else 0


def partitions_for(df: DataFrame, bytes_each: int = 64 << 20, most: int = 200_000) -> int:
    """Partitions for a shuffle of ``df``: the session's setting, more where the input is larger than that bears.

    The estimate multiplies through joins, so it is used for scans and projections of scans only.
    """
    own = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(own, min(most, input_bytes(df) // bytes_each))


def fresh(name: str, *taken: list[str]) -> str:
    """``name`` or, where a column has that name already (in any letter case), a variant of it."""
    used = {c.lower() for cols in taken for c in cols}
    while name.lower() in used:
        name = "_" + name
    return name
