"""Command line: ``python -m tessera.cli predict | hybrid | train | calibrate | audit | validate | pipeline``.

Options left out are taken from the threshold file, then from defaults (``predict``); a threshold
file overrides options (``hybrid``).  A command ends with 0, or with 1 if files are missing or the
checked files have errors; ``pipeline`` stops with the first command that fails.
"""

from __future__ import annotations

import argparse
import importlib
import os
import sys
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import evaluate, scoring, training, validate
from tessera.operators.normalize import normalized
from tessera.plans import linkage
from tessera.session import session
from tessera.sources import tsv
from tessera.storage import stash

#: Where a dataset folder is looked for when none is given.
DATA_DIRS = ("dataset", "student_resource/dataset", "../dataset", "../../dataset", "../../student_resource/dataset")
MODEL, THRESHOLDS, CALIBRATED = "models/matching_model", "models/best_threshold.json", "models/calibrated_thresholds.json"


SHORT = {("validate", "matching"): ("-m",), ("validate", "candidate"): ("-c",), ("validate", "test_dir"): ("-t",)}


def _file(spark: SparkSession, path: str) -> str:
    if not tsv.exists(spark, path):
        raise FileNotFoundError(path)
    return path


def _records(spark: SparkSession, data_dir: str | None, kind: str, head: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(source 1, targets) of the train or test folder; ``head`` limits source 1."""
    folder = f"{tsv.find_dataset([data_dir, *DATA_DIRS])}/{kind}"
    for n in (1, 2, 3):
        _file(spark, f"{folder}/{kind}_source{n}.tsv")
    return tsv.read_tsv(spark, f"{folder}/{kind}_source1.tsv", head=head or None), tsv.read_targets(spark, folder, kind)


def _truth(spark: SparkSession, data_dir: str | None) -> DataFrame:
    return tsv.read_truth(spark, _file(spark, f"{tsv.find_dataset([data_dir, *DATA_DIRS])}/train/train_ground_truth.tsv"))


def _write(s1: DataFrame, found: DataFrame, matches: DataFrame, folder: str) -> None:
    os.makedirs(folder, exist_ok=True)
    matches = stash(matches, "matches")
    tsv.write_file(tsv.id_lists(s1, found, "cand_rank", "candidate_entity_ids"), f"{folder}/candidate_pairs.tsv")
    tsv.write_file(tsv.id_lists(s1, matches, "rank", "matched_entity_ids"), f"{folder}/matching_results.tsv")
    row = evaluate.summary(s1, matches).first()
    print(f"entities {row.entities}, without a match {row.singletons} ({row.singleton_percent:.2f} %), matches {row.matches}")


def _given(a: argparse.Namespace) -> dict:
    return {"gate": a.gate_threshold, "sibling": a.sibling_threshold, "margin": a.margin, "max_per_source": a.max_per_source}


def predict(spark: SparkSession, a: argparse.Namespace) -> int:
    """Candidates and matches of the test records, by the serving profile."""
    limits = linkage.Thresholds(**tsv.load_thresholds(a.threshold_path, _given(a) | {"gate": a.gate_threshold or a.threshold}))
    model = None if a.linear else scoring.load_model(_file(spark, a.model_path))
    s1, targets = _records(spark, a.data_dir, "test")
    _write(s1, *linkage.predict(s1, targets, a.max_candidates, limits, model), a.output_dir)
    return 0


def hybrid(spark: SparkSession, a: argparse.Namespace) -> int:
    """The same with name vectors for uncertain entities."""
    limits = linkage.Thresholds(**tsv.load_thresholds(a.threshold_path, _given(a), file_wins=True, defaults=tsv.HYBRID_DEFAULTS))
    model = None if a.linear else scoring.load_model(_file(spark, a.model_path))
    encoder = None
    if a.encoder:
        module, name = a.encoder.split(":")
        encoder = getattr(importlib.import_module(module), name)
    s1, targets = _records(spark, a.data_dir, "test", a.limit)
    _write(s1, *linkage.predict_hybrid(s1, targets, None, thresholds=limits, model=model, make_encoder=encoder), a.output_dir)
    return 0


def train(spark: SparkSession, a: argparse.Namespace) -> int:
    """A model, and thresholds searched on the validation split."""
    s1, targets = _records(spark, a.data_dir, "train", a.sample_size)
    model, limits, score = linkage.train(s1, targets, _truth(spark, a.data_dir), percent=round(100 * (1 - a.val_ratio)), seed=a.seed, maxIter=a.trees)
    scoring.save_model(model, a.model_out)
    tsv.save_thresholds(a.threshold_out, asdict(limits), score)
    print(f"{limits}, macro F0.5 {score:.4f}")
    return 0


def calibrate(spark: SparkSession, a: argparse.Namespace) -> int:
    """Thresholds of a trained model."""
    s1, targets = _records(spark, a.data_dir, "train", a.sample_size)
    limits, score = linkage.calibrate(s1, targets, _truth(spark, a.data_dir), scoring.load_model(_file(spark, a.model_path)))
    tsv.save_thresholds(a.out_path, asdict(limits), score)
    print(f"{limits}, macro F0.5 {score:.4f}")
    return 0


def audit(spark: SparkSession, a: argparse.Namespace) -> int:
    """Countries of every file, and how many true pairs blocking finds."""
    root = tsv.find_dataset([a.data_dir, *DATA_DIRS])
    files = {f"{kind} S{n}": f"{root}/{kind}/{kind}_source{n}.tsv" for kind in ("train", "test") for n in (1, 2, 3)}
    found, missing = evaluate.countries_by_file(spark, files)
    held = {r.name: r.countries for r in found.toLocalIterator()}  # six rows at most
    for name, path in files.items():
        print(f"{name}: " + (f"no file {path}" if name in missing else ", ".join(held.get(name, []))))
    for kind in ("train", "test"):
        if not any(f"{kind} S{n}" in missing for n in (1, 2, 3)):
            more = set(held.get(f"{kind} S1", [])) - set(held.get(f"{kind} S2", [])) - set(held.get(f"{kind} S3", []))
            print(f"{kind}: " + (f"countries of source 1 that no target has: {sorted(more)}" if more else "targets cover all countries"))
    s1, targets = _records(spark, a.data_dir, "train", a.sample_size)
    _, check = training.split(s1, "entity_id", round(100 * (1 - a.val_ratio)), a.seed)
    check, every = stash(normalized(check), "s1"), stash(normalized(targets), "targets")
    own = check.select(F.col("id").alias("s1_id"))
    truth = own.join(_truth(spark, a.data_dir), "s1_id", "left").withColumn("matched", F.coalesce("matched", F.array().cast("array<string>")))
    row = evaluate.blocking_audit(truth, stash(linkage.candidate_pairs(check, every, a.max_candidates), "candidates"), every.count()).first()
    for name, value in row.asDict().items():
        print(f"{name}: {value}")
    return 0


def check(spark: SparkSession, a: argparse.Namespace) -> int:
    """Rules of result files."""
    candidate = a.candidate or "output/candidate_pairs.tsv"
    required = tsv.read_ids(spark, _file(spark, f"{a.test_dir}/test_source1.tsv"))
    targets, why = (None, ["use --check-ids to check that ids exist"])
    if a.check_ids:
        targets, why = tsv.read_match_ids(spark, a.test_dir)
    found = validate.validate(spark, a.matching, candidate, required, targets, "; ".join(why)).orderBy("severity", "rule").collect()  # a row for each rule and file
    for r in found:
        print(f"{r.severity}: {r.rule}: {r.n}, e.g. {', '.join(r.examples)}")
    bad = sum(r.severity == "error" for r in found)
    print(f"FAIL: {bad} rules broken" if bad else "PASS")
    return int(bad > 0)


def pipeline(spark: SparkSession, a: argparse.Namespace) -> int:
    """Training, then prediction."""
    where = ["--data-dir", a.data_dir] if a.data_dir else []
    if a.mode in ("train", "all"):
        code = run(spark, ["train", "--sample-size", str(a.sample_size), *where])
        if code:
            return code
    if a.mode in ("predict", "all"):
        return run(spark, ["predict", *where, *(["--threshold", str(a.threshold)] if a.threshold is not None else [])])
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessera", description="Record linkage on Spark")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, f, **options) -> None:
        sub = commands.add_parser(name, help=f.__doc__.split("\n")[0])
        sub.set_defaults(work=f)
        for option, default in options.items():
            flags = [*SHORT.get((name, option), ()), "--" + option.replace("_", "-")]
            if isinstance(default, bool):
                sub.add_argument(*flags, action="store_true")
            elif isinstance(default, type):
                sub.add_argument(*flags, type=default, default=None)
            else:
                sub.add_argument(*flags, type=type(default), default=default)

    files = {"data_dir": str, "model_path": MODEL, "threshold_path": THRESHOLDS, "output_dir": "output", "linear": False}
    command("predict", predict, **files, gate_threshold=float, sibling_threshold=float, threshold=float, margin=float, max_per_source=int, max_candidates=6)
    d = tsv.HYBRID_DEFAULTS
    command("hybrid", hybrid, **files, gate_threshold=d["gate"], sibling_threshold=d["sibling"], margin=d["margin"], max_per_source=d["max_per_source"], limit=int, encoder=str)
    command("train", train, data_dir=str, model_out=MODEL, threshold_out=THRESHOLDS, sample_size=80_000, val_ratio=0.2, seed=42, trees=scoring.PRODUCTION["maxIter"])
    command("calibrate", calibrate, data_dir=str, sample_size=15_000, model_path=MODEL, out_path=CALIBRATED)
    command("audit", audit, data_dir=str, sample_size=30_000, val_ratio=0.2, max_candidates=35, seed=42)
    command("validate", check, matching="output/matching_results.tsv", candidate=str, test_dir="dataset/test", check_ids=False)
    command("pipeline", pipeline, data_dir=str, sample_size=50_000, threshold=float)
    commands.choices["pipeline"].add_argument("--mode", choices=("train", "predict", "all"), default="all")
    return top


def run(spark: SparkSession, arguments: list[str]) -> int:
    a = parser().parse_args(arguments)
    try:
        return a.work(spark, a)
    except FileNotFoundError as e:
        print(f"no such file: {e}", file=sys.stderr)
        return 1


def main() -> None:
    parser().parse_args()  # wrong options end here, before a session is made
    sys.exit(run(session("tessera"), sys.argv[1:]))


if __name__ == "__main__":
    main()
