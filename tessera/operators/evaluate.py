"""Evaluation and audit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def lists_of(pairs: DataFrame) -> DataFrame:
    """(s1_id, predicted) of pairs (s1_id, t_id)."""
    return pairs.groupBy("s1_id").agg(F.collect_set("t_id").alias("predicted"))


def entity_f05(truth: DataFrame, pairs: DataFrame) -> DataFrame:
    """(s1_id, tp, n_pred, n_true, f05) of every entity of the truth (s1_id, matched); no prediction is an empty one."""
    rows = truth.join(lists_of(pairs), "s1_id", "left").withColumn("predicted", F.coalesce("predicted", F.array().cast("array<string>")))
    rows = rows.select("s1_id", F.size(F.array_intersect("matched", "predicted")).cast("long").alias("tp"), F.size("predicted").cast("long").alias("n_pred"), F.size(F.array_distinct("matched")).cast("long").alias("n_true"))
    score = 1.25 * F.col("tp") / (1.25 * F.col("tp") + (F.col("n_pred") - F.col("tp")) + 0.25 * (F.col("n_true") - F.col("tp")))
    return rows.withColumn("f05", F.when(F.col("n_true") == 0, F.when(F.col("n_pred") == 0, 1.0).otherwise(0.0)).when(F.col("tp") == 0, 0.0).otherwise(score))


def macro_f05(truth: DataFrame, pairs: DataFrame) -> DataFrame:
    """(n, macro_f05) over all entities of the truth; 0 without any."""
    return entity_f05(truth, pairs).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("f05"), F.lit(0.0)).alias("macro_f05"))


def blocking_audit(truth: DataFrame, candidates: DataFrame, n_targets: int, bar: float = 0.97) -> DataFrame:
    """One row: pair recall, entities with some and with all true targets among their candidates, candidate counts, reduction."""
    edges = truth.select("s1_id", F.explode("matched").alias("t_id")).distinct()
    found = edges.join(candidates.select("s1_id", "t_id").distinct().withColumn("hit", F.lit(1)), ["s1_id", "t_id"], "left").groupBy("s1_id").agg(F.count(F.lit(1)).alias("n_true"), F.count("hit").alias("n_hit"))
    counts = candidates.groupBy("s1_id").agg(F.count(F.lit(1)).alias("n_cand"))
    rows = truth.select("s1_id").distinct().join(found, "s1_id", "left").join(counts, "s1_id", "left").na.fill(0, ["n_true", "n_hit", "n_cand"])
    with_truth = F.count_if(F.col("n_true") > 0)

    def share(n, d):
        return F.when(d > 0, n / d).otherwise(F.lit(0.0))

    out = rows.agg(
        F.sum("n_true").alias("pairs"), F.sum("n_hit").alias("recalled"), share(F.sum("n_hit"), F.sum("n_true")).alias("pair_recall"),
        share(F.count_if(F.col("n_hit") > 0), with_truth).alias("entity_any_recall"), share(F.count_if((F.col("n_true") > 0) & (F.col("n_hit") == F.col("n_true"))), with_truth).alias("entity_full_recall"),
        F.avg("n_cand").alias("avg_candidates"), F.count_if(F.col("n_cand") == 0).alias("zero_candidates"), share(100.0 * F.count_if(F.col("n_cand") == 0), F.count(F.lit(1))).alias("zero_percent"),
    )
    return out.withColumn("reduction_ratio", 1 - F.col("avg_candidates") / n_targets).withColumn("passes", F.col("pair_recall") >= bar)


def countries(records: DataFrame) -> DataFrame:
    """The distinct normalized countries of a source."""
    from tessera.functions.text import normalize_country

    return records.select(normalize_country(F.col("country")).alias("country")).distinct()


def countries_by_file(spark: SparkSession, files: dict[str, str], head: int | None = 50_000) -> tuple[DataFrame, list[str]]:
    """((name, countries in order) of each file that is there, names of the files that are missing); ``head`` rows of each are read, None for all."""
    from tessera.sources.tsv import exists, read_tsv

    there = {n: p for n, p in files.items() if exists(spark, p)}
    found = [countries(read_tsv(spark, p, columns=["country"], head=head)).select(F.lit(n).alias("name"), "country") for n, p in there.items()]
    rows = reduce(DataFrame.union, found) if found else spark.createDataFrame([], "name string, country string")
    return rows.groupBy("name").agg(F.array_sort(F.collect_set("country")).alias("countries")), [n for n in files if n not in there]


def uncovered_countries(s1: DataFrame, targets: DataFrame) -> DataFrame:
    """Countries of source 1 that no target has."""
    return countries(s1).subtract(countries(targets))


def summary(s1: DataFrame, matches: DataFrame) -> DataFrame:
    """One row: entities, those without a match (count and percent), matches."""
    n = matches.groupBy("s1_id").agg(F.count(F.lit(1)).alias("n"))
    rows = s1.select(F.col("entity_id").alias("s1_id")).join(n, "s1_id", "left")
    return rows.agg(F.count(F.lit(1)).alias("entities"), F.count_if(F.col("n").isNull()).alias("singletons"), F.when(F.count(F.lit(1)) > 0, 100.0 * F.count_if(F.col("n").isNull()) / F.count(F.lit(1))).otherwise(0.0).alias("singleton_percent"), F.coalesce(F.sum("n"), F.lit(0)).alias("matches"))


def block_skew(keys: DataFrame) -> DataFrame:
    """Addition: for each key type the entries, approximate distinct keys and the longest list."""
    sizes = keys.groupBy("country", "key_rank", "key").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("key_rank").agg(F.sum("n").alias("entries"), F.approx_count_distinct("key").alias("keys"), F.max("n").alias("longest"))
