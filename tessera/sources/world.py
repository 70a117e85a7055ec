"""A deterministic linkage world over the table ``part``: a clean source and two noisy ones.

The text is plain SQL that Spark and other engines read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_NOISE = """CASE {m} WHEN 0 THEN concat(w1, ' ', ty, ' ', w2, ' unit ', n, ' Services')
 WHEN 1 THEN concat('Services ', n, ' unit ', w2, ' ', ty, ' ', w1)
 WHEN 2 THEN concat(w1, ty, w2, 'unit', n, 'Services Pvt Ltd')
 WHEN 3 THEN concat(substr(w1, 1, 2), substr(w1, 4), ' ', ty, ' ', w2, ' unit ', n, ' Services & Co')
 ELSE concat(upper(concat(w1, ' ', ty)), ' S.A. ', upper(concat(w2, ' unit ', n, ' Services'))) END"""
_NOISY_ADDRESS = "CASE WHEN k % 7 = 0 THEN NULL WHEN k % 5 = 0 THEN concat(CAST(sz AS STRING), ' ', w2, ' Road') ELSE concat(CAST(sz AS STRING), ' ', w2, ' Road ', CAST(pin AS STRING)) END"
_COUNTRY = "CASE k % 3 WHEN 0 THEN 'US' WHEN 1 THEN 'India' ELSE 'France' END"


def _id(source: str) -> str:
    return f"concat('{source}-', lpad(CAST(k AS STRING), 6, '0'))"


BASE = "SELECT p_partkey AS k, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2, lower(p_type) AS ty, replace(p_brand, 'Brand#', '') AS n, p_size AS sz, 10000 + (p_partkey * 7919) % 89999 AS pin FROM part"
S1 = f"SELECT k, 'S1' AS source, k AS ord, {_id('S1')} AS entity_id, {_NOISE.format(m='0')} AS business_name, concat(CAST(sz AS STRING), ' ', w2, ' Rd, ', ty, ' town ', CAST(pin AS STRING)) AS business_address, {_COUNTRY} AS country FROM base"
S2 = f"SELECT k, 'S2' AS source, k AS ord, {_id('S2')} AS entity_id, {_NOISE.format(m='k % 5')} AS business_name, {_NOISY_ADDRESS} AS business_address, {_COUNTRY} AS country FROM base WHERE k % 17 <> 0 AND k % 4 <> 0"
S3 = f"SELECT k, 'S3' AS source, 1000000000000 + k AS ord, {_id('S3')} AS entity_id, {_NOISE.format(m='(k + 2) % 5')} AS business_name, {_NOISY_ADDRESS} AS business_address, {_COUNTRY} AS country FROM base WHERE k % 17 <> 0 AND k % 7 <> 2"
CTES = f"base AS ({BASE}), s1 AS ({S1}), targets AS ({S2} UNION ALL {S3})"


def world(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(source 1, targets): entity_id, business_name, business_address, country, ord (row order, all of S2 before S3), k."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    s1 = spark.sql(f"WITH base AS ({BASE.replace('FROM part', 'FROM {part}')}) {S1}", part=part)
    targets = spark.sql(f"WITH base AS ({BASE.replace('FROM part', 'FROM {part}')}) {S2} UNION ALL {S3}", part=part)
    return s1, targets


def truth(spark: SparkSession, sf_dir: str, *more: str, sides: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(s1_id, matched) of every S1 entity: the targets made from the same part; ``more`` columns of S1 follow. ``sides``: the two sources, if not those of ``world``.

    Ids hold six digits of the part's key, so from a million parts on several entities share one; ``k`` does not repeat.
    """
    from pyspark.sql import functions as F

    s1, targets = sides or world(spark, sf_dir)
    lists = targets.groupBy("k").agg(F.array_sort(F.collect_list("entity_id")).alias("m"))
    return s1.join(lists, "k", "left").select(F.col("entity_id").alias("s1_id"), F.coalesce("m", F.array().cast("array<string>")).alias("matched"), *more)


def own_ids(rows: DataFrame) -> DataFrame:
    """The rows with an id for each: where six digits cut the key off, ``#`` and the whole key follow."""
    from pyspark.sql import functions as F

    return rows.withColumn("entity_id", F.when(F.col("k") >= 1_000_000, F.concat_ws("#", "entity_id", "k")).otherwise(F.col("entity_id")))
