"""Tab-separated sources and sinks.

Files have a header, one record per line and no quoting; only the empty field is null.  Schemas are
given, never inferred.  A header of one column is refused.
"""

from __future__ import annotations

import json
import os
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = T.StructType([T.StructField(n, T.StringType()) for n in ("entity_id", "business_name", "business_address", "country")])
TRUTH = T.StructType([T.StructField(n, T.StringType()) for n in ("source1_entity_id", "matched_entity_ids")])


def first_line(spark: SparkSession, path: str) -> str | None:
    rows = spark.read.text(path).limit(1).collect()
    return rows[0][0] if rows else None


def read_tsv(spark: SparkSession, path: str, schema: T.StructType = RECORD, columns: list[str] | None = None, head: int | None = None) -> DataFrame:
    """A table of strings with ``ord``, its row order; ``columns`` prunes, ``head`` takes the first rows in file order."""
    line = first_line(spark, path)
    if line is None or len(line.split("\t")) <= 1:
        raise ValueError(f"{path}: the header has no tab; the file is malformed")
    df = numbered(spark.read.schema(schema).option("sep", "\t").option("header", True).option("quote", "").csv(path), "ord")
    if head:
        df = df.orderBy("ord").limit(head)
    return df.select(*columns, "ord") if columns else df


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Rows read from files with their number, from 0 without gaps: by file name, then by place in the file.

    A file is read in splits, and splits are dealt to tasks by size; the rows of one split stay together
    and in order.  So splits are counted first, their counts are summed in file order, and each row's
    place in its split is added.
    """
    rows = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_id"))
    sizes = rows.groupBy("_file", "_split").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_file", "_split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row for each split
    starts = sizes.select("_file", "_split", (before - F.col("_first")).alias("_shift"))
    return rows.join(starts, ["_file", "_split"]).withColumn(name, F.col("_id") + F.col("_shift")).drop("_file", "_split", "_id", "_shift")


def stream_tsv(spark: SparkSession, path: str, schema: T.StructType = RECORD, files_per_batch: int = 1) -> DataFrame:
    """The same files as a stream, some files at a time; a folder that already has a file without tabs in its header is refused."""
    line = first_line(spark, path) if exists(spark, path) else None
    if line is not None and "\t" not in line:
        raise ValueError(f"{path}: the header has no tab; the file is malformed")
    return spark.readStream.schema(schema).option("sep", "\t").option("header", True).option("quote", "").option("maxFilesPerTrigger", files_per_batch).csv(path)


def id_list(c: Column) -> Column:
    """Comma-joined ids as a list: blanks trimmed, empty items and repeats dropped."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != ""))


def truth_lists(rows: DataFrame) -> DataFrame:
    """(s1_id, matched) of rows (source1_entity_id, matched_entity_ids, ord); the last row of an id counts, blank ids do not."""
    rows = rows.withColumn("s1_id", F.trim("source1_entity_id")).where("s1_id <> ''")
    return rows.groupBy("s1_id").agg(F.max_by(id_list(F.col("matched_entity_ids")), "ord").alias("matched"))


def truth_edges(truth: DataFrame) -> DataFrame:
    return truth.select("s1_id", F.explode("matched").alias("t_id"))


def read_truth(spark: SparkSession, path: str, head: int | None = None) -> DataFrame:
    """Ground truth as lists; ``head`` counts rows with an id."""
    rows = read_tsv(spark, path, TRUTH)
    if head:
        rows = rows.where("trim(source1_entity_id) <> ''").orderBy("ord").limit(head)
    return truth_lists(rows)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The distinct ids of a file's first column."""
    rows = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path).toDF("entity_id", *_rest(spark, path))
    return rows.select(F.trim("entity_id").alias("entity_id")).where("entity_id <> ''").distinct()


def _rest(spark: SparkSession, path: str) -> list[str]:
    return [f"_c{i}" for i in range(1, len((first_line(spark, path) or "").split("\t")))]


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever file system it names."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def read_match_ids(spark: SparkSession, folder: str, names: tuple[str, ...] = ("test_source2.tsv", "test_source3.tsv")) -> tuple[DataFrame | None, list[str]]:
    """(the distinct ids of all target files, warnings); no ids and a warning for each file that is missing."""
    missing = [n for n in names if not exists(spark, f"{folder}/{n}")]
    if missing:
        return None, [f"{folder}/{n} is missing; ids are not checked to exist" for n in missing]
    ids = [read_ids(spark, f"{folder}/{n}") for n in names]
    return reduce(DataFrame.union, ids).distinct(), []


def read_targets(spark: SparkSession, folder: str, kind: str, columns: list[str] | None = None) -> DataFrame:
    """All target records of a folder, those of source 2 before those of source 3."""
    s2, s3 = (read_tsv(spark, f"{folder}/{kind}_source{n}.tsv", columns=columns) for n in (2, 3))
    return s2.unionByName(s3.withColumn("ord", F.col("ord") + (1 << 60)))


def source_of(c: Column) -> Column:
    """S1, S2 or S3 by the id's prefix; null for others."""
    return F.when(c.rlike("^S[123]-"), F.substring(c, 1, 2))


def id_lists(s1: DataFrame, pairs: DataFrame, rank: str, name: str) -> DataFrame:
    """One row per S1 entity with its ids comma-joined in the order of ``rank``; empty where it has none."""
    lists = pairs.groupBy("s1_id").agg(F.array_sort(F.collect_list(F.struct(rank, "t_id"))).alias("l"))
    joined = F.array_join(F.transform("l", lambda x: x["t_id"]), ",")
    return s1.select(F.col("entity_id").alias("s1_id"), "ord").join(lists, "s1_id", "left").select(F.col("s1_id").alias("source1_entity_id"), F.coalesce(joined, F.lit("")).alias(name), "ord")


def write_lists(lists: DataFrame, path: str, single_file: bool = False) -> None:
    """Writes id lists in S1 order, empty lists as nothing after the tab."""
    out = lists.orderBy("ord").drop("ord")
    out = out.coalesce(1) if single_file else out
    out.write.mode("overwrite").option("sep", "\t").option("header", True).option("emptyValue", "").option("nullValue", "").option("quote", "").csv(path)


def write_file(lists: DataFrame, path: str) -> None:
    """The same as one file at ``path``, put in place when it is whole."""
    spark = lists.sparkSession
    write_lists(lists, f"{path}.parts", single_file=True)
    files = spark.sparkContext._jvm.org.apache.hadoop.fs
    parts, to = files.Path(f"{path}.parts"), files.Path(path)
    store = parts.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = next(x.getPath() for x in store.listStatus(parts) if x.getPath().getName().startswith("part-"))
    store.delete(to, True)
    if not store.rename(part, to):
        raise OSError(f"{path} could not be written")
    store.delete(parts, True)
    beside = os.path.join(os.path.dirname(to.toUri().getPath()), f".{to.getName()}.crc")
    if os.path.exists(beside):  # a local file's checksum, which would make an error of any edit
        os.remove(beside)


def find_dataset(candidates: list[str | None]) -> str:
    """The first folder that has a ``train`` or ``test`` folder in it."""
    for path in candidates:
        if path and (os.path.isdir(f"{path}/train") or os.path.isdir(f"{path}/test")):
            return path
    raise FileNotFoundError("no folder with train/ or test/ among: " + ", ".join(map(str, candidates)))


# The names of thresholds in files, and what holds where neither a file nor the caller says.
FILE_KEYS = {"gate": ("gate_threshold", "best_threshold"), "sibling": ("sibling_threshold",), "margin": ("best_margin",), "max_per_source": ("max_per_source",)}
DEFAULTS = {"gate": 0.58, "sibling": 0.38, "margin": 0.22, "max_per_source": 3}
HYBRID_DEFAULTS = {"gate": 0.58, "sibling": 0.35, "margin": 0.25, "max_per_source": 3}
# End of fixed values.


def load_thresholds(path: str | None, given: dict | None = None, file_wins: bool = False, defaults: dict = DEFAULTS) -> dict:
    """Thresholds of a JSON file and given ones; those given win unless ``file_wins``. Defaults fill the rest."""
    held = json.loads(Path(path).read_text()) if path and os.path.isfile(path) else {}
    held = {k: next(held[n] for n in names if n in held) for k, names in FILE_KEYS.items() if any(n in held for n in names)}
    held = {k: int(v) if k == "max_per_source" else float(v) for k, v in held.items()}
    given = {k: v for k, v in (given or {}).items() if v is not None}
    return defaults | (given | held if file_wins else held | given)


def save_thresholds(path: str, thresholds: dict, f05: float | None = None) -> None:
    """The six keys of a threshold file."""
    found = defaults_with(thresholds)
    out = {"gate_threshold": found["gate"], "sibling_threshold": found["sibling"], "best_threshold": found["gate"], "best_margin": found["margin"], "max_per_source": found["max_per_source"], "val_f05": f05}
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    Path(path).write_text(json.dumps(out, indent=2))


def defaults_with(thresholds: dict) -> dict:
    return DEFAULTS | {k: v for k, v in thresholds.items() if k in DEFAULTS and v is not None}


def first_rows(df: DataFrame, per: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group in a total order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*per).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")
