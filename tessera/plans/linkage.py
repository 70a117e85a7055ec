"""Whole plans: prediction, hybrid prediction, training with calibration."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import blocking, decide, features, scoring, training
from tessera.operators.normalize import normalized, prepared
from tessera.storage import stash, stash_slices


@dataclass(frozen=True)
class Thresholds:
    gate: float = 0.58
    sibling: float = 0.38
    margin: float = 0.22
    max_per_source: int = 3


def entities(records: DataFrame, name: str) -> DataFrame:
    """Normalized entities, written; records are dealt out first, as a small file is one task's however many rows it holds."""
    return stash(normalized(records.repartition(max(8, int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "entity_id")), name)


def candidate_pairs(s1: DataFrame, targets: DataFrame, k: int = 35) -> DataFrame:
    """Blocking over normalized entities."""
    return blocking.candidates(blocking.block_keys(s1), blocking.block_keys(targets), k)


def pair_features(s1: DataFrame, targets: DataFrame, candidates: DataFrame, profile: str = "canonical", prune: bool = False) -> DataFrame:
    rows = features.pairs(candidates, prepared(s1), prepared(targets))
    return features.features(features.prefilter(rows) if prune else rows, profile)


def linear_scores(s1: DataFrame, targets: DataFrame, candidates: DataFrame, prune: bool = True, profile: str = "serving") -> DataFrame:
    """Scores that need no trained model; only the three features they read are computed."""
    rows = features.pairs(candidates, prepared(s1), prepared(targets))
    made = features.native(profile)
    used = (features.prefilter(rows) if prune else rows).select("s1_id", "t_id", "cand_rank", "s1_ord", *(made[k].alias(k) for k in scoring.LINEAR))
    return scoring.linear(used)


def predict(s1_records: DataFrame, target_records: DataFrame, k: int = 6, thresholds: Thresholds = Thresholds(), model=None) -> tuple[DataFrame, DataFrame]:
    """(candidates, matches): candidates before pruning, matches after all decisions."""
    s1, targets = entities(s1_records, "s1"), entities(target_records, "targets")
    found = stash(candidate_pairs(s1, targets, k), "candidates")
    if model is None:
        scores = linear_scores(s1, targets, found)
    else:
        scores = scoring.trees(pair_features(s1, targets, found, "serving", True), model)
    names = targets.select(F.col("id").alias("t_id"), "norm_name")
    return found, decide.decide(scores, names, thresholds.gate, thresholds.sibling, thresholds.margin, thresholds.max_per_source)


def predict_hybrid(s1_records: DataFrame, target_records: DataFrame, vectors: tuple[DataFrame, ...] | None = None, k: int = 35, thresholds: Thresholds = Thresholds(), model=None, make_encoder=None) -> tuple[DataFrame, DataFrame]:
    """The variant that asks name vectors about uncertain entities; no boost, no claims.

    Vectors are given for both sides as ``scoring.blend`` takes them, or made by an encoder for the
    names that are asked for; without either the probabilities stay as they are.  Given vectors,
    candidates are scored and decided by slices of entities.
    """
    s1, targets = entities(s1_records, "s1"), entities(target_records, "targets")
    found = stash(candidate_pairs(s1, targets, k), "candidates")

    def scored(part: DataFrame) -> DataFrame:
        return linear_scores(s1, targets, part, prune=False, profile="canonical") if model is None else scoring.trees(pair_features(s1, targets, part), model)

    def decided(rows: DataFrame) -> DataFrame:
        return decide.decide_hybrid(rows, thresholds.gate, thresholds.sibling, thresholds.margin, thresholds.max_per_source)

    if vectors is None and make_encoder is not None:
        scores = stash_slices(found, "s1_id", scored, "scores")
        vectors = tuple(scoring.encode(names, make_encoder) for names in scoring.uncertain_names(scores, s1, targets))
        return found, decided(scoring.blend(scores, vectors))
    return found, stash_slices(found, "s1_id", lambda part: decided(scored(part) if vectors is None else scoring.blend(scored(part), vectors)), "matches")


def validation_scores(s1: DataFrame, targets: DataFrame, candidates: DataFrame, model) -> DataFrame:
    """Scores of the candidates of some entities, by the canonical features."""
    return scoring.trees(pair_features(s1, targets, candidates.join(s1.select(F.col("id").alias("s1_id")), "s1_id", "left_semi")), model)


def search(scores: DataFrame, truth: DataFrame, s1: DataFrame, points: list) -> tuple[Thresholds, float]:
    """The best point of a grid for the given entities (those without truth count as without matches), and its score."""
    own = s1.select(F.col("id").alias("s1_id")).join(truth, "s1_id", "left").withColumn("matched", F.coalesce("matched", F.array().cast("array<string>")))
    best = training.best_point(training.grid_scores(scores, own, points)).first()
    return Thresholds(best.gate, best.sibling, best.margin, best.max_per_source), best.macro_f05


def train(s1_records: DataFrame, target_records: DataFrame, truth: DataFrame, k: int = 35, points: list | None = None, ceiling: int = 3_000_000, percent: int = 80, seed: int = 42, evaluate: int = 15_000, **params):
    """(model, thresholds, score): trees fitted on mined pairs of the training split, thresholds searched on ``evaluate`` entities of the rest."""
    s1, targets = entities(s1_records, "s1"), entities(target_records, "targets")
    learn, check = training.split(s1, "id", percent, seed)
    edges = truth.select("s1_id", F.explode("matched").alias("t_id"))
    found = stash(candidate_pairs(s1, targets, k), "candidates")
    mined = stash(training.training_pairs(edges, found.join(learn.select(F.col("id").alias("s1_id")), "s1_id", "left_semi"), learn, targets, ceiling=ceiling), "mined")
    rows = pair_features(learn, targets, mined.select("s1_id", "t_id").withColumn("cand_rank", F.lit(1)))
    model = scoring.fit_trees(stash(rows.join(mined, ["s1_id", "t_id"]), "training"), **params)
    check = stash(training.evaluation_sample(check, "id", evaluate, seed), "check")
    best, score = search(stash(validation_scores(check, targets, found, model), "scores"), truth, check, points or training.grid(*training.FULL_GRID))
    return model, best, score


def calibrate(s1_records: DataFrame, target_records: DataFrame, truth: DataFrame, model, k: int = 35, points: list | None = None) -> tuple[Thresholds, float]:
    """(thresholds, score) of a model that is there, searched over all given entities."""
    s1, targets = entities(s1_records, "s1"), entities(target_records, "targets")
    found = stash(candidate_pairs(s1, targets, k), "candidates")
    return search(stash(validation_scores(s1, targets, found, model), "scores"), truth, s1, points or training.grid(*training.SMALL_GRID))
