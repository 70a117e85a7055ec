"""Operator 4, URL rules by host-suffix and path-prefix expressions (DataFrame operations only).

Each URL is expanded into the expressions a rule could have: every suffix of its host at a label
boundary that has no more labels than the longest rule host, with every prefix of its path whose
length some rule path has.  The first bytes of each
expression's digest are joined with those of the rules; what meets there is confirmed by the full
digest, and the longest rule wins.

Expressions are made once per distinct host and path, at most rule labels x rule path lengths of
them, so a host of thousands of labels costs no more than another; the verdict then goes back to
every page row, so a hot host costs one row until the last join, whose hot side can be split.  Pages
without a host, null ones among them, can meet no rule and go round the join.  Rules are joined as a table:
Spark broadcasts them only where their measured size allows it.

Defined results: host and path are empty for a null url or one without "://"; equally long rules
that both fit are decided for the longer host, then for block; repeated rules count once; an empty
rule table leaves every page to the default; repeated pages repeat their result.  Only page_id and
url are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a digest that are joined on before the whole digest is compared.
PREFIX_BYTES = 4
#: The rules of the registered query: (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rule_table(spark: SparkSession, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)"))


def split_url(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, path) of each row."""
    rest = F.coalesce(_after_scheme(F.col("url")), F.lit(""))
    return (
        pages.select("page_id", "url")
        .withColumn("rest", rest)
        .select("page_id", "url", F.translate(F.regexp_extract("rest", r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER).alias("host"), F.regexp_extract("rest", r"(?s)^[^/?#]*([^?#]*)", 1).alias("path"))
    )


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of each row of pages; rules: (host, path, verdict)."""
    rules = (
        rules.select(F.translate("host", _UPPER, _LOWER).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), F.col("verdict").alias("rule_verdict"))
        .where("rule_host is not null and rule_verdict is not null")
        .groupBy("rule_host", "rule_path")
        .agg(F.max("rule_verdict").alias("rule_verdict"))
        .withColumn("digest", _digest(F.col("rule_host"), F.col("rule_path")))
        .withColumn("short", F.substring("digest", 1, 2 * PREFIX_BYTES))
    )
    sizes = rules.agg(F.collect_set(F.length("rule_path")).alias("lengths"), F.max(F.size(F.split("rule_host", r"\."))).alias("labels")).first()
    lengths, most = sizes.lengths, sizes.labels or 0  # at most as many as the longest rule path has characters
    split = split_url(pages)
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(most, 1)))), lambda i: F.array_join(F.slice(labels, -i, i), "."))
    prefixes = [F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in sorted(lengths)]
    distinct = split.where("host <> ''").select("host", "path").distinct()
    matched = (
        distinct.withColumn("p", F.explode(F.array(*prefixes) if prefixes else F.array().cast("array<string>")))
        .where("p is not null")
        .withColumn("h", F.explode(suffixes))
        .withColumn("d", _digest(F.col("h"), F.col("p")))
        .withColumn("short", F.substring("d", 1, 2 * PREFIX_BYTES))
        .join(rules, "short")
        .where("d = digest and h = rule_host and p = rule_path")
        .groupBy("host", "path")
        .agg(F.max(F.struct((F.length("h") + F.length("p")).alias("n"), F.length("h").alias("n_host"), (F.col("rule_verdict") == "block").alias("block"), F.concat("h", "p").alias("rule"), F.col("rule_verdict").alias("verdict"))).alias("best"))
    )
    judged = split.where("host <> ''").join(matched, ["host", "path"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    return judged.unionByName(split.where("host = ''").select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")))
