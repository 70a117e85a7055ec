"""Helpers of the training-data operators: tables, learning sets, Arrow plumbing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.storage import stash

__all__ = ["bounded_sample", "learnable", "map_arrow", "stash", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def learnable(doc_id: str = "doc_id") -> Column:
    """Rows that a model may learn from: crc32 of the id as text, modulo 4, is not 2."""
    return F.crc32(F.col(doc_id).cast("string")) % 4 != 2


def bounded_sample(df: DataFrame, key: str, bound: int, seed: int = 11) -> DataFrame:
    """About ``bound`` rows at most, chosen by a hash of ``key``: the same rows whatever the partitioning.

    The share is bound / count; the result exceeds the bound only by chance (some standard deviations).
    """
    n = df.count()
    if n <= bound:
        return df
    scale = 1 << 30
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(scale)) < int(scale * bound / n))


def map_arrow(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch; it may return one batch or yield several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = work(batch)
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out

    return df.mapInArrow(run, schema)
