"""Match probabilities of pairs."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import similarity as sim

from . import boosting
from .features import NAMES

Encoder = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]
#: Weights of the linear scorer; they sum to 1, so a score is a share.
LINEAR = {"name_jaccard": 0.5, "name_base_exact": 0.3, "postal_match": 0.2}
#: Size of the production model; tests pass less.
PRODUCTION = {"maxIter": 350, "stepSize": 0.04, "maxDepth": 8, "minInstancesPerNode": 40, "subsamplingRate": 0.85, "featureSubsetStrategy": "0.85", "seed": 42}


def linear(features: DataFrame, weights: dict[str, float] = LINEAR) -> DataFrame:
    """(s1_id, t_id, cand_rank, s1_ord, p) by a weighted sum rounded to nine digits."""
    p: Column = sum((F.col(k) * w for k, w in weights.items()), F.lit(0.0))
    return features.select("s1_id", "t_id", "cand_rank", "s1_ord", F.round(p, 9).alias("p"))


def jaccard_rule(features: DataFrame, least: float = 0.80) -> DataFrame:
    """The plain baseline: pairs whose name tokens are alike enough."""
    return features.where(F.col("name_jaccard") >= least).select("s1_id", "t_id", "cand_rank", "s1_ord", F.col("name_jaccard").alias("p"))


def _vector(features: DataFrame) -> DataFrame:
    return features.withColumn("x", array_to_vector(F.array(*(F.col(k).cast("float").cast("double") for k in NAMES))))


def fit_trees(features: DataFrame, label: str = "label", **params) -> GBTClassificationModel:
    """Gradient-boosted trees over the 45 features of pairs, of the size for production unless told otherwise."""
    return boosting.fit(features, NAMES, label, ("s1_id", "t_id"), PRODUCTION | params)


def trees(features: DataFrame, model: GBTClassificationModel) -> DataFrame:
    scored = model.transform(_vector(features))
    return scored.select("s1_id", "t_id", "cand_rank", "s1_ord", vector_to_array("probability")[1].alias("p"))


def save_model(model: GBTClassificationModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> GBTClassificationModel:
    return GBTClassificationModel.load(path)


def mean_pool(tokens: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Vectors of length one from token vectors (texts x tokens x size): the mean of the tokens under the mask."""
    mask = mask[:, :, None].astype(np.float64)
    pooled = (tokens * mask).sum(axis=1) / np.maximum(mask.sum(axis=1), 1e-9)
    return (pooled / np.maximum(np.linalg.norm(pooled, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def encode(names: DataFrame, make_encoder: Callable[[], Encoder], batch: int = 256) -> DataFrame:
    """(id, vec) of names (id, name) by an encoder that each task makes once.

    An encoder takes a list of texts and gives their token vectors and mask; ``mean_pool`` does the rest.
    Null and empty names have no vector.
    """

    def run(batches):
        encoder = None
        for rows in batches:
            encoder = encoder or make_encoder()
            for lo in range(0, rows.num_rows, batch):
                part = rows.slice(lo, batch)
                vectors = mean_pool(*encoder(part.column("name").to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(list(vectors), pa.list_(pa.float32()))], ["id", "vec"])

    return names.select("id", "name").where("name <> ''").mapInArrow(run, "id string, vec array<float>")


def uncertain_names(scores: DataFrame, s1: DataFrame, targets: DataFrame, low: float = 0.40, high: float = 0.75, least: float = 0.30) -> tuple[DataFrame, DataFrame]:
    """The names (id, name) that ``blend`` will ask for: of entities whose best probability is within [low, high], and of their candidates of at least ``least``."""
    top = scores.groupBy("s1_id").agg(F.max("p").alias("top")).where((F.col("top") >= low) & (F.col("top") <= high))
    asked = scores.join(top, "s1_id", "left_semi").where(F.col("p") >= least)
    sides = ((s1, asked.select(F.col("s1_id").alias("id"))), (targets, asked.select(F.col("t_id").alias("id"))))
    return tuple(rows.select("id", F.col("norm_name").alias("name")).join(ids.distinct(), "id", "left_semi") for rows, ids in sides)


def blend(scores: DataFrame, vectors: tuple[DataFrame, ...], low: float = 0.40, high: float = 0.75, least: float = 0.30, share: float = 0.25) -> DataFrame:
    """Uncertain entities get part of their probability from the cosine of name vectors.

    Uncertain: the best probability within [low, high]; of those, pairs of at least ``least``.
    vectors: (id, vec) of either side, of length one; a missing vector leaves the probability.  Where
    many ids share a vector, (id, number) of either side and (number, vec): pairs are then shuffled
    with numbers, and vectors come last.
    Blended probabilities are rounded to nine digits, so that equal ones tie.
    """
    from pyspark.sql import Window

    s, t, *by_number = vectors
    top = F.max("p").over(Window.partitionBy("s1_id"))
    rows = scores.withColumn("top", top).join(s.toDF("s1_id", "sv"), "s1_id", "left").join(t.toDF("t_id", "tv"), "t_id", "left")
    for table in by_number:
        for side in ("sv", "tv"):
            rows = rows.withColumnRenamed(side, "_no").join(table.toDF("_no", side), "_no", "left").drop("_no")
    uncertain = (F.col("top") >= low) & (F.col("top") <= high) & (F.col("p") >= least) & F.col("sv").isNotNull() & F.col("tv").isNotNull()
    mixed = (1 - share) * F.col("p") + share * sim.cosine_of_units(F.col("sv"), F.col("tv"))
    return rows.select("s1_id", "t_id", "cand_rank", "s1_ord", F.when(uncertain, F.round(mixed, 9)).otherwise(F.col("p")).alias("p"))
