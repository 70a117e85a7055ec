"""Addition: new target records linked as they arrive.

Each micro-batch is normalized, keyed and joined with the static entities of source 1; scored pairs
that pass the gate are appended to a table by batch.  Claims need the whole history, so they are
resolved over that table when it is read (``resolve``), which also makes a repeated batch harmless.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import decide
from tessera.operators.normalize import normalized
from tessera.plans.linkage import candidate_pairs, linear_scores
from tessera.storage import stash


def start(s1_records: DataFrame, stream: DataFrame, out: str, checkpoint: str, k: int = 35, gate: float = 0.58):
    """A running query that writes passing scores of each batch to ``out``/batch=<n>."""
    s1 = stash(normalized(s1_records), "s1")

    def batch(rows: DataFrame, number: int) -> None:
        targets = normalized(rows)
        scores = linear_scores(s1, targets, candidate_pairs(s1, targets, k), prune=False).where(F.col("p") >= gate)
        names = targets.select(F.col("id").alias("t_id"), "norm_name")
        scores.join(names, "t_id").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def resolve(scores: DataFrame, max_per_source: int = 3) -> DataFrame:
    """Matches over all batches so far: latest score of each pair, then truncation, claims and caps."""
    latest = scores.groupBy("s1_id", "t_id").agg(F.max_by(F.struct("p", "cand_rank", "s1_ord", "norm_name"), "batch").alias("x")).select("s1_id", "t_id", "x.*")
    ranked = decide.truncate(decide.boost(decide.gate_and_margin(latest.drop("norm_name")), latest.select("t_id", "norm_name").distinct()), max_per_source)
    return decide.cap_per_source(decide.owned(ranked), max_per_source)
