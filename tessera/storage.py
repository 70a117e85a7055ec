"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SLICE_ROWS = 4_000_000


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder of a session on one machine, or an error on a cluster."""
    held = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not held:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir is unset: executors of {master} need a folder that all of them share")
        held = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set("spark.checkpoint.dir", held)
        _remove_at_end(spark, held)
    return held.rstrip("/")


def _remove_at_end(spark: SparkSession, path: str) -> None:
    """The file system removes the path when the driver's JVM ends; tables made from it can be read until then."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)


def _write(df: DataFrame, path: str, mode: str = "error") -> None:
    """Writes df; its shuffle files go when it is written, not when the driver collects its garbage."""
    conf = df.sparkSession.conf
    held = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        df.write.mode(mode).parquet(path)
    finally:
        conf.set(_CLEANUP, held)


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes df and reads it back: what uses it more than once computes it once, and lineage ends in files that outlive executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _write(df, path)
    _remove_at_end(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stash_slices(rows: DataFrame, key: str, make: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """``stash(make(rows))`` by slices of some ``SLICE_ROWS`` rows, one after the other: all rows of a key are in one slice, and shuffles hold one slice at a time.

    rows should be a written table, as it is read once for each slice.
    """
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    n = max(1, -(-rows.count() // SLICE_ROWS))
    for i in range(n):
        made = make(rows.where(F.pmod(F.xxhash64(key, F.lit(7)), F.lit(n)) == i) if n > 1 else rows)
        _write(made, path, "append")
    _remove_at_end(spark, path)
    return spark.read.schema(made.schema).parquet(path)
