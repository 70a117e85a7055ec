"""Operator 3, quality rules with robust multivariate outliers (DataFrame operations only).

Every text gets rule statistics from column expressions: words, their characters, symbols,
repeated lines, words in repeated 3-word windows.  A text fails the base rules with too few words
or too much repetition.  The others are judged by a transformed vector of five statistics: for each
language and source the minimum-covariance-determinant estimate gives a Mahalanobis distance, and
texts too far out are rejected.

The estimate is the mean and covariance of the ``SHARE`` of the texts whose covariance has the least
determinant.  Concentration steps (estimate, distances, the nearest share, estimate again) never
raise the determinant; they go on from four starts, the least determinant wins and is followed until
it settles.  It is then scaled to be consistent for normal data, and reweighted: mean and covariance
of all texts within the ``WITHIN`` quantile.  All texts together are one more group, estimated in the
same steps; it stands in for groups of fewer than ``LEAST`` texts.

The statistics are written once to the shared folder; the steps run on that narrow table as partial
aggregates by group, so a group with a third of all rows is summed before it is shuffled.  The
estimates come back by a join on the group, salted so that a hot group is dealt over ``SALT`` keys.

Defined results: null text has no words, hence fails; null lang or source is a group of its own; a
coordinate's variance is at least the square of its ``FLOOR``, so where a group's texts are all
alike in it, a text is rejected for what is far off on that scale; quantiles are taken to one part
in a thousand; an empty table gives an empty result.  Windows are compared by a 64-bit hash within
one text.  Only doc_id, text, lang and source are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash

#: Base rules.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Central share of a group, steps that all starts take, most steps of the best, the fall of the log determinant that counts as settled.
SHARE, TRIES, MOST_STEPS, SETTLED = 0.75, 2, 10, 1e-3
#: Quantile for reweighting, least group, salt.
WITHIN, LEAST, SALT = 0.975, 50, 8
#: Least deviation of each coordinate, in its own unit.
FLOOR = (0.25, 0.05, 0.1, 0.1, 0.35)
_DIM = len(FLOOR)
_BLANK = "[ \\x09-\\x0D]"


def statistics(documents: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    text = F.coalesce("text", F.lit(""))
    rows = documents.select("doc_id", "lang", "source", text.alias("text"))
    rows = rows.withColumn("words", F.filter(F.split("text", _BLANK + "+"), lambda w: w != ""))
    rows = rows.withColumn("n_words", F.size("words").cast("long"))
    rows = rows.withColumn("h", F.when(F.col("n_words") >= 3, F.expr("transform(sequence(0, size(words) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2]))")))
    placed = F.expr("sort_array(transform(h, (x, i) -> struct(x as h, i as i)))")
    rows = rows.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), placed))  # most texts repeat nothing, and need no sort
    again = F.expr("sort_array(transform(filter(s, (x, k) -> (k > 0 and s[k - 1].h = x.h) or (k + 1 < size(s) and s[k + 1].h = x.h)), x -> x.i))")
    rows = rows.withColumn("at", again)
    covered = F.expr("aggregate(at, named_struct('n', 0L, 'e', -1), (a, i) -> named_struct('n', a.n + least(3, i + 2 - a.e), 'e', i + 2)).n")
    lines = F.filter(F.split("text", "\n"), lambda x: F.rlike(x, F.lit("[^ \\x09-\\x0D]")))
    rows = rows.withColumn("lines", lines)
    return rows.select(
        "doc_id",
        "lang",
        "source",
        "n_words",
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    ).withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def _vector() -> list[Column]:
    """The transformed statistics; logarithms and roots bring their tails in."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [F.log(n), F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n), F.log1p(10 * F.col("n_symbols") / n), F.sqrt(F.col("n_repeat_words") / n), F.log1p(F.col("n_dup_lines").cast("double"))]


def _names(kind: str) -> list[str]:
    return [f"{kind}{i}" for i in range(_DIM)]


def chi_square(x: float, degrees: int) -> float:
    """The distribution function for an odd number of degrees of freedom."""
    term, total = math.sqrt(2 * x / math.pi) * math.exp(-x / 2), math.erf(math.sqrt(x / 2))
    for k in range(1, degrees - 1, 2):
        total, term = total - term, term * x / (k + 2)
    return total


def quantile(p: float, degrees: int = _DIM) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, degrees) < p else (low, middle)
    return high


def consistency(share: float) -> float:
    """What the covariance of the ``share`` most central points of a normal distribution must be scaled by."""
    return share / chi_square(quantile(share), _DIM + 2)


#: Squared distance beyond which a text is rejected: one in ten thousand of normal data.
FAR = quantile(1 - 1e-4)
_PAIRS = [(i, j) for i in range(_DIM) for j in range(i + 1)]
_GROUP = ["g_lang", "g_source"]
_KEY = [*_GROUP, "start"]
_FACTOR = [f"k{i}_{j}" for i, j in _PAIRS]
_ESTIMATE = [*_names("m"), *_FACTOR]


def _covariances(of: Callable[[int], Column]) -> list[Column]:
    return [F.covar_pop(of(i), of(j)).alias(f"c{i}_{j}") for i, j in _PAIRS]


def _factor(of: DataFrame, scale: float = 1.0) -> DataFrame:
    """Adds the inverse k of the lower factor l of each group's scaled covariance, variances raised to the least ones, and the logarithm of the determinant."""
    of = of.withColumns({f"c{i}_{j}": F.greatest(F.col(f"c{i}_{j}") * scale, F.lit(FLOOR[i] ** 2)) if i == j else F.col(f"c{i}_{j}") * scale for i, j in _PAIRS})
    for i, j in _PAIRS:
        rest = reduce(lambda a, k: a - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}"), range(j), F.col(f"c{i}_{j}"))
        of = of.withColumn(f"l{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-3 * FLOOR[i] ** 2))) if i == j else rest / F.col(f"l{j}_{j}"))
    for i in range(_DIM):
        for j in range(i, -1, -1):
            rest = reduce(lambda a, k: a - F.col(f"l{i}_{k}") * F.col(f"k{k}_{j}"), range(j, i), F.lit(1.0 if i == j else 0.0))
            of = of.withColumn(f"k{i}_{j}", rest / F.col(f"l{i}_{i}"))
    of = of.withColumn("logdet", reduce(lambda a, i: a + 2 * F.log(f"l{i}_{i}"), range(_DIM), F.lit(0.0)))
    return of.drop(*(f"{x}{i}_{j}" for x in "cl" for i, j in _PAIRS))


def _distance(rows: DataFrame) -> DataFrame:
    """Adds the squared Mahalanobis distance d, a sum of squares that does not grow with rewriting."""
    u = [F.col(f"x{i}") - F.col(f"m{i}") for i in range(_DIM)]
    z = [reduce(lambda a, j: a + F.col(f"k{i}_{j}") * u[j], range(1, i + 1), F.col(f"k{i}_0") * u[0]) for i in range(_DIM)]
    return rows.withColumn("d", reduce(lambda a, x: a + F.pow(x, F.lit(2.0)), z, F.lit(0.0)))


def _with(rows: DataFrame, of_group: DataFrame) -> DataFrame:
    """Each row with what belongs to its group, once for every start there is, over salted keys."""
    salted = of_group.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.join(salted, [*_GROUP, "salt"])


def starts(rows: DataFrame) -> DataFrame:
    """Four centres and factors to begin from for each group (g_lang, g_source, start, m, k).

    0: means and covariance; 1: medians and deviations from them; 2: medians and the covariance of
    spatial signs; 3: medians and that of squashed scores.  From each, concentration goes downhill
    to a determinant of its own.
    """
    middle = rows.groupBy(*_GROUP).agg(*(F.percentile_approx(f"x{i}", 0.5, 1000).alias(f"m{i}") for i in range(_DIM)), *(F.avg(f"x{i}").alias(f"a{i}") for i in range(_DIM)), *_covariances(lambda i: F.col(f"x{i}")))
    middle = stash(middle, "mcd")
    far = _with(rows, middle.select(*_GROUP, *_names("m")))
    spread = far.groupBy(*_GROUP).agg(*(F.greatest(1.4826 * F.percentile_approx(F.abs(F.col(f"x{i}") - F.col(f"m{i}")), 0.5, 1000), F.lit(FLOOR[i])).alias(f"s{i}") for i in range(_DIM)))
    middle = stash(middle.join(spread, _GROUP), "mcd")
    score = [(F.col(f"x{i}") - F.col(f"m{i}")) / F.col(f"s{i}") for i in range(_DIM)]
    scored = _with(rows, middle.select(*_GROUP, *_names("m"), *_names("s"))).select(*_GROUP, *(z.alias(f"z{i}") for i, z in enumerate(score)))
    scored = scored.withColumn("length", F.sqrt(reduce(lambda a, i: a + F.col(f"z{i}") * F.col(f"z{i}"), range(_DIM), F.lit(1e-12))))
    shape = scored.groupBy(*_GROUP).agg(*(F.avg(F.col(f"z{i}") * F.col(f"z{j}") / F.col("length") / F.col("length")).alias(f"u{i}_{j}") for i, j in _PAIRS), *(F.covar_pop(F.tanh(f"z{i}"), F.tanh(f"z{j}")).alias(f"t{i}_{j}") for i, j in _PAIRS))
    all_of = middle.join(shape, _GROUP)
    one = {
        0: lambda i, j: F.col(f"c{i}_{j}"),
        1: lambda i, j: F.col(f"s{i}") * F.col(f"s{i}") if i == j else F.lit(0.0),
        2: lambda i, j: _DIM * F.col(f"s{i}") * F.col(f"s{j}") * F.col(f"u{i}_{j}"),
        3: lambda i, j: F.col(f"s{i}") * F.col(f"s{j}") * F.col(f"t{i}_{j}"),
    }
    rows_of = [F.struct(F.lit(k).alias("start"), *(F.col(f"{'a' if k == 0 else 'm'}{i}").alias(f"m{i}") for i in range(_DIM)), *(c(i, j).alias(f"c{i}_{j}") for i, j in _PAIRS)) for k, c in one.items()]
    return _factor(all_of.select(*_GROUP, F.explode(F.array(*rows_of)).alias("e")).select(*_GROUP, "e.*"))


def _moments(rows: DataFrame) -> DataFrame:
    """Mean and covariance of each group of rows that carry an estimate, from sums of differences to its centre."""
    u = {i: F.col(f"x{i}") - F.col(f"m{i}") for i in range(_DIM)}
    sums = [F.count(F.lit(1)).alias("n"), *(F.first(f"m{i}").alias(f"o{i}") for i in u), *(F.sum(c).alias(f"u{i}") for i, c in u.items()), *(F.sum(u[i] * u[j]).alias(f"w{i}_{j}") for i, j in _PAIRS)]
    out = rows.groupBy(*_KEY).agg(*sums)
    means = [(F.col(f"o{i}") + F.col(f"u{i}") / F.col("n")).alias(f"m{i}") for i in u]
    return out.select(*_KEY, "n", *means, *((F.col(f"w{i}_{j}") / F.col("n") - F.col(f"u{i}") * F.col(f"u{j}") / F.col("n") / F.col("n")).alias(f"c{i}_{j}") for i, j in _PAIRS))


def concentrate(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """One step: mean and covariance of the ``SHARE`` points nearest by the estimate before.

    The cut of each group is written before it is joined, so its size is known and the points stay where they are.
    """
    estimates = estimates.select(*_KEY, *_ESTIMATE)
    cut = _distance(_with(rows, estimates)).groupBy(*_KEY).agg(F.percentile_approx("d", SHARE, 1000).alias("cut"))
    held = stash(estimates.join(cut, _KEY), "mcd")
    return stash(_factor(_moments(_distance(_with(rows, held)).where("d <= cut"))), "mcd")


def determinants(rows: DataFrame) -> DataFrame:
    """The minimum-covariance-determinant estimate of each group (g_lang, g_source, start, n, m, k, logdet) of rows (x, g_lang, g_source, salt).

    All starts are concentrated ``TRIES`` times; the one of least determinant goes on until no group's
    determinant falls by more than ``SETTLED`` of itself, ``MOST_STEPS`` times at most.
    """
    held = starts(rows)
    for _ in range(TRIES):
        held = concentrate(rows, stash(held, "mcd"))
    held = held.groupBy(*_GROUP).agg(F.min(F.struct("logdet", "start", "n", *_ESTIMATE)).alias("e")).select(*_GROUP, "e.*")
    for _ in range(MOST_STEPS):
        new = concentrate(rows, held)
        old = held.select(*_GROUP, F.col("logdet").alias("before"))
        moved = new.join(old, _GROUP).agg(F.max(F.col("before") - F.col("logdet"))).first()[0]  # one number
        held = new
        if moved is None or moved <= SETTLED:
            break
    return held


def robust(rows: DataFrame) -> DataFrame:
    """The estimates made consistent, and reweighted: mean and covariance of all points within the ``WITHIN`` quantile of the scaled estimate."""
    raw = determinants(rows)
    wide = math.sqrt(consistency(SHARE))
    raw = raw.select(*_KEY, *_names("m"), *((F.col(c) / wide).alias(c) for c in _FACTOR))
    inside = _distance(_with(rows, raw)).where(F.col("d") <= quantile(WITHIN))
    return stash(_factor(_moments(inside), consistency(WITHIN)), "mcd")


def outliers(stats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(judged rows with their squared distance ``d`` from the robust centre of their group, rows that fail the base rules)."""
    rows = stats.withColumns(dict(zip(_names("x"), _vector(), strict=True))).withColumns(
        {"g_lang": F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")), "g_source": F.coalesce(F.concat(F.lit("="), "source"), F.lit("")), "salt": F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALT)).cast("int")}
    )
    judged = rows.where(~F.col("base_failed"))
    everyone = F.struct(F.lit("*").alias("g_lang"), F.lit("*").alias("g_source"))
    points = judged.select("salt", *_names("x"), F.explode(F.array(F.struct(*_GROUP), everyone)).alias("g")).select("salt", *_names("x"), "g.*")
    points = stash(points, "points")
    sizes = points.groupBy(*_GROUP).agg(F.count(F.lit(1)).alias("size"))
    found = robust(points).join(sizes, _GROUP).select(*_GROUP, "size", F.struct(*_ESTIMATE).alias("e"))
    overall = found.where("g_lang = '*'").select(F.col("e").alias("o"))  # one row
    filled = found.where("g_lang <> '*'").join(F.broadcast(overall)).select(*_GROUP, F.when(F.col("size") >= LEAST, F.col("e")).otherwise(F.col("o")).alias("e")).select(*_GROUP, "e.*")
    return _distance(_with(judged, stash(filled, "mcd"))), rows.where("base_failed")


def quality(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance)."""
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    stats = stash(statistics(documents), "quality")
    far, failed = outliers(stats)
    return far.select(*names, (F.col("d") <= FAR).alias("kept"), F.col("d").alias("distance")).unionByName(failed.select(*names, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance")))
