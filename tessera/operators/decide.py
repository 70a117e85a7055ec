"""Decisions: gate, margin, agreement boost, truncation, global claims, per-source cap.

Everything up to the truncation works within one S1 entity and keeps its partitioning; the claim
is one aggregation by target with partial maxima, so a target wanted by very many entities is
reduced before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import similarity as sim
from tessera.sources.tsv import source_of
from tessera.storage import stash


def _by_s1():
    return Window.partitionBy("s1_id")



def gate_and_margin(scores: DataFrame, gate: float = 0.58, sibling: float = 0.38, margin: float = 0.22, adaptive: bool = True) -> DataFrame:
    """Pairs of entities whose best p reaches the gate, near enough to that best."""
    rows = scores.withColumn("top", F.max("p").over(_by_s1())).where(F.col("top") >= gate)
    reach = margin * F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.40), F.col("top")))) if adaptive else F.lit(margin)
    return rows.where(F.col("p") >= F.greatest(F.lit(sibling), F.col("top") - reach)).drop("top")


def boost(passing: DataFrame, names: DataFrame, least: float = 0.70, gain: float = 0.08) -> DataFrame:
    """Adds ``pb``: p plus ``gain`` x name similarity for each alike pair among the first two S2 and first two S3 candidates, 1 at most; rounded to nine digits, so that equal sums tie.

    names: (t_id, norm_name) of the targets.
    """
    rows = passing.withColumn("source", source_of(F.col("t_id")))
    firsts = rows.where("source in ('S2', 'S3')").withColumn("n", F.row_number().over(Window.partitionBy("s1_id", "source").orderBy("cand_rank"))).where("n <= 2").join(names, "t_id")
    a = firsts.where("source = 'S2'").select("s1_id", F.col("t_id").alias("a"), F.col("norm_name").alias("na"))
    b = firsts.where("source = 'S3'").select("s1_id", F.col("t_id").alias("b"), F.col("norm_name").alias("nb"))
    met = a.join(b, "s1_id").withColumn("alike", sim.sort_ratio("na", "nb")).where(F.col("alike") >= least)
    gains = met.select("s1_id", F.explode(F.array("a", "b")).alias("t_id"), "alike").groupBy("s1_id", "t_id").agg(F.sum(F.col("alike") * gain).alias("more"))
    return rows.join(gains, ["s1_id", "t_id"], "left").withColumn("pb", F.round(F.least(F.lit(1.0), F.col("p") + F.coalesce("more", F.lit(0.0))), 9)).drop("more", "source")


def truncate(rows: DataFrame, max_per_source: int = 3) -> DataFrame:
    """The 2 x max_per_source best of each entity with their ``rank``; equal scores keep candidate order."""
    w = _by_s1().orderBy(F.desc("pb"), "cand_rank")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 2 * max_per_source)


def claims(ranked: DataFrame) -> DataFrame:
    """(t_id, owner): the entity with the highest score for each target; the earliest entity wins equal scores."""
    return ranked.groupBy("t_id").agg(F.max_by("s1_id", F.struct("pb", -F.col("s1_ord"))).alias("owner"))


def owned(ranked: DataFrame) -> DataFrame:
    """The pairs whose entity owns the target."""
    return ranked.join(claims(ranked), "t_id").where(F.col("owner") == F.col("s1_id")).drop("owner")


def cap_per_source(rows: DataFrame, max_per_source: int = 3, order: str = "rank") -> DataFrame:
    """At most so many of S2 and of S3 for each entity; other sources are not capped."""
    rows = rows.withColumn("source", F.coalesce(source_of(F.col("t_id")), F.lit("other")))
    w = Window.partitionBy("s1_id", "source").orderBy(order)
    return rows.withColumn("nth", F.row_number().over(w)).where((F.col("nth") <= max_per_source) | ~F.col("source").isin("S2", "S3")).drop("nth", "source")


def decide(scores: DataFrame, names: DataFrame, gate: float = 0.58, sibling: float = 0.38, margin: float = 0.22, max_per_source: int = 3) -> DataFrame:
    """Scores to matches: (s1_id, t_id, rank, pb). Passing and ranked pairs, a few per entity, are used several times and hence written."""
    passing = stash(gate_and_margin(scores, gate, sibling, margin), "passing")
    ranked = stash(truncate(boost(passing, names), max_per_source), "ranked")
    return cap_per_source(owned(ranked), max_per_source)


def decide_hybrid(scores: DataFrame, gate: float = 0.58, sibling: float = 0.38, margin: float = 0.22, max_per_source: int = 3) -> DataFrame:
    """The variant without boost and claims, with the constant margin."""
    rows = gate_and_margin(scores, gate, sibling, margin, adaptive=False).withColumn("pb", F.col("p"))
    ranked = rows.withColumn("rank", F.row_number().over(_by_s1().orderBy(F.desc("pb"), "cand_rank")))
    return cap_per_source(ranked, max_per_source)
