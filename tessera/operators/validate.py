"""Integrity rules of output files.

Findings are rows (rule, severity, n, examples): how many offenders a rule has, with up to five of
them in order.  Files are read as lines, so malformed rows are seen as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tsv import first_line, first_rows, numbered
from tessera.storage import stash

MATCHING_HEADER = ("source1_entity_id", "matched_entity_ids")
CANDIDATE_HEADER = ("source1_entity_id", "candidate_entity_ids")
_SCHEMA = "rule string, severity string, n long, examples array<string>"


def _findings(offences: DataFrame, severity: str = "error") -> DataFrame:
    """(rule, severity, n, examples) of offences (rule, x): distinct offenders of each rule, with the five smallest."""
    own = stash(offences.distinct(), "offences")
    few = first_rows(own, ["rule"], ["x"], 5).groupBy("rule").agg(F.array_sort(F.collect_list("x")).alias("examples"))
    return own.groupBy("rule").agg(F.count(F.lit(1)).alias("n")).join(few, "rule").select("rule", F.lit(severity).alias("severity"), "n", "examples")


def parse_lines(lines: DataFrame) -> DataFrame:
    """(line_no, s1_id, ids, malformed) of numbered lines (line_no, value), blank ones left out."""
    rows = lines.where(F.trim("value") != "")
    parts = F.split("value", "\t")
    text = F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))
    ids = F.when(F.trim(text) == "", F.array().cast("array<string>")).otherwise(F.split(text, ","))
    return rows.select("line_no", F.trim(F.element_at(parts, 1)).alias("s1_id"), ids.alias("ids"), (~F.contains("value", F.lit("\t"))).alias("malformed"))


def _offence(rule: str, x: Column) -> Column:
    return F.struct(F.lit(rule).alias("rule"), x.cast("string").alias("x"))


def check_lists(rows: DataFrame, required: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Findings over parsed rows; required: (entity_id) of source 1; known: (entity_id) of all targets or None.

    Rules of a single row are found in one pass; rules about entities in one aggregation joined with
    the required ones; whether ids exist in one join.
    """
    rows = stash(rows, "lines")
    ids = F.col("ids")
    of_row = F.when(F.col("malformed"), F.array(_offence("malformed_row", F.col("line_no")))).otherwise(
        F.concat(
            F.when(F.size(ids) != F.size(F.array_distinct(ids)), F.array(_offence("duplicate_id", F.col("s1_id")))).otherwise(F.array().cast("array<struct<rule:string,x:string>>")),
            F.transform(F.filter(ids, lambda i: i.startswith("S1-")), lambda i: _offence("self_match", i)),
            F.transform(F.filter(ids, lambda i: ~i.rlike("^S[123]-")), lambda i: _offence("wrong_prefix", i)),
        )
    )
    found = rows.select(F.explode(of_row).alias("o")).select("o.*")
    good = rows.where(~F.col("malformed"))
    own = good.groupBy("s1_id").agg(F.count(F.lit(1)).alias("n"))
    need = required.select(F.col("entity_id").alias("need_id")).distinct()
    both = own.join(need, F.col("s1_id") == F.col("need_id"), "full")
    of_entity = F.filter(
        F.array(
            F.when(F.col("n") > 1, _offence("duplicate_row", F.col("s1_id"))),
            F.when(F.col("s1_id").isNull(), _offence("missing_entity", F.col("need_id"))),
            F.when(F.col("need_id").isNull(), _offence("unexpected_entity", F.col("s1_id"))),
        ),
        lambda o: o.isNotNull(),
    )
    found = found.union(both.select(F.explode(of_entity).alias("o")).select("o.*"))
    if known is not None:
        targets = good.select(F.explode("ids").alias("t_id")).where(F.col("t_id").rlike("^S[23]-")).distinct()
        unknown = targets.join(known.select(F.col("entity_id").alias("t_id")).distinct(), "t_id", "left_anti")
        found = found.union(unknown.select(F.lit("unknown_id"), "t_id"))
    return _findings(found)


def check_subset(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """Entities with a match that is no candidate (a warning); of repeated rows the last counts."""

    def last(rows: DataFrame) -> DataFrame:
        return rows.where(~F.col("malformed")).groupBy("s1_id").agg(F.max_by("ids", "line_no").alias("ids")).select("s1_id", F.explode("ids").alias("t_id"))

    return _findings(last(matches).join(last(candidates), ["s1_id", "t_id"], "left_anti").select(F.lit("match_not_candidate").alias("rule"), F.col("s1_id").alias("x")), "warning")


def counts(rows: DataFrame) -> DataFrame:
    """One row: rows, empty and non-empty lists."""
    good = rows.where(~F.col("malformed"))
    return good.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.size("ids") == 0).alias("empty"), F.count_if(F.size("ids") > 0).alias("non_empty"))


def _one(spark: SparkSession, rule: str, severity: str, what: str) -> DataFrame:
    return spark.createDataFrame([(rule, severity, 1, [what])], _SCHEMA)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Numbered lines after the header; the header is line 1."""
    lines = numbered(spark.read.text(path), "n")
    return lines.select((F.col("n") + 1).alias("line_no"), "value").where("line_no > 1")


def check_file(spark: SparkSession, path: str, header: tuple[str, str], required: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(findings, parsed rows or None if the header stops the check)."""
    try:
        line = first_line(spark, path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return _one(spark, "file_missing", "error", path), None
    if line is None:
        return _one(spark, "file_empty", "error", path), None
    if "\t" not in line and "," in line:
        return _one(spark, "header_commas", "error", line), None
    if tuple(x.strip().lower() for x in line.split("\t")) != header:
        return _one(spark, "header_names", "error", line), None
    rows = parse_lines(read_lines(spark, path))
    return check_lists(rows, required, known), rows


def validate(spark: SparkSession, matching: str, candidate: str | None, source1: DataFrame, targets: DataFrame | None = None, why_not: str = "targets were not given") -> DataFrame:
    """All findings of a matching file and, if there, a candidate file; with targets ids are checked to exist."""
    known = targets.select("entity_id") if targets is not None else None
    found, matches = check_file(spark, matching, MATCHING_HEADER, source1, known)
    if known is None:
        found = found.unionByName(_one(spark, "ids_not_checked", "warning", why_not))
    if candidate:
        more, cands = check_file(spark, candidate, CANDIDATE_HEADER, source1, known)
        if cands is None:
            more = more.withColumn("severity", F.when(F.col("rule") == "file_missing", "warning").otherwise(F.col("severity")))
        found = found.unionByName(more)
        if matches is not None and cands is not None:
            found = found.unionByName(check_subset(matches, cands))
    return found
