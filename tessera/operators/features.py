"""The 45 pair features in two profiles.

``canonical`` is what models are trained on; ``serving`` differs where the serving path took short
cuts: equal names or addresses, sound codes, and postal conflicts.  Both come from one table of
expressions with overrides, so they cannot drift apart elsewhere.

Token lists, codes and number sets are made once per entity before the join (``normalize.prepared``);
per pair only comparisons remain.  The eight subsequence scores come from one Arrow function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import similarity as sim
from tessera.functions.similarity import flag

# The names of the features, in the order in which models take them.
NAMES = (
    "name_exact", "name_base_exact", "name_unspaced_match", "name_base_unspaced", "name_first_token_match", "name_prefix2_match", "is_acronym_match", "name_soundex_match",
    "name_lcp_ratio", "name_shared_tokens_count", "name_base_jaccard", "name_fuzz_ratio", "name_token_sort", "name_token_set", "name_partial_ratio", "name_qgram_jaccard",
    "name_jaccard", "name_len_diff", "name_token_count_diff", "name_num_conflict", "has_addr_both", "house_num_match", "house_num_diff", "addr_has_shared_num",
    "addr_nums_jaccard", "addr_nums_conflict", "addr_exact", "addr_first_token_match", "addr_soundex_match", "addr_tail_overlap", "addr_shared_tokens_count", "addr_fuzz_ratio",
    "addr_partial_ratio", "addr_token_sort", "addr_token_set", "addr_qgram_jaccard", "addr_overlap", "name_x_addr_sim", "geom_mean_sim", "both_have_postal",
    "postal_match", "postal_prefix2", "postal_prefix3", "postal_conflict", "is_source2",
)
# End of fixed values.
_SIDE = ("norm_name", "base_name", "norm_addr", "postal_code", "house_num", "toks", "base_toks", "addr_toks", "first_tok", "first_sx", "street_sx", "nums", "a_nums", "grams", "a_grams")


def pairs(candidates: DataFrame, s1: DataFrame, targets: DataFrame) -> DataFrame:
    """Candidate pairs with both sides' prepared columns, prefixed s_ and t_; pairs without a target row go."""
    s = s1.select(F.col("id").alias("s1_id"), F.col("ord").alias("s1_ord"), *(F.col(c).alias(f"s_{c}") for c in _SIDE))
    t = targets.select(F.col("id").alias("t_id"), *(F.col(c).alias(f"t_{c}") for c in _SIDE))
    return candidates.join(t, "t_id").join(s, "s1_id")


def prefilter(rows: DataFrame) -> DataFrame:
    """Pairs worth scoring: equal postal codes, a shared name token, or a name of at most five characters."""
    same_postal = (F.col("s_postal_code") != "") & (F.col("s_postal_code") == F.col("t_postal_code"))
    return rows.where(same_postal | F.arrays_overlap("s_toks", "t_toks") | (F.length("s_norm_name") <= 5) | (F.length("t_norm_name") <= 5))


def _both(name: str) -> tuple[Column, Column]:
    return F.col(f"s_{name}"), F.col(f"t_{name}")


def _glued(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit(""))


def _same_set(a: Column, b: Column) -> Column:
    return F.array_sort(a) == F.array_sort(b)


def native(profile: str = "canonical") -> dict[str, Column]:
    """All features but the eight subsequence scores and the two made of them."""
    serving = profile == "serving"
    n1, n2 = _both("norm_name")
    b1, b2 = _both("base_name")
    a1, a2 = _both("norm_addr")
    p1, p2 = _both("postal_code")
    h1, h2 = _both("house_num")
    t1, t2 = _both("toks")
    w1, w2 = _both("addr_toks")
    x1, x2 = _both("first_sx")
    f1, f2 = _both("first_tok")
    y1, y2 = _both("street_sx")
    q1, q2 = _both("nums")
    d1, d2 = _both("a_nums")
    first = flag((f1 != "") & (f1 == f2))
    longest = F.greatest(F.length(n1), F.length(n2), F.lit(1))
    most = F.greatest(F.size(t1), F.size(t2), F.lit(1))
    second = F.try_element_at(t1, F.lit(2)) == F.try_element_at(t2, F.lit(2))
    sounds = flag((x1 != "") & (x1 == x2))
    out = {
        "name_exact": flag((n1 != "") & (n1 == n2)),
        "name_base_exact": flag((b1 != "") & (b1 == b2)),
        "name_unspaced_match": flag((n1 != "") & (_glued(n1) == _glued(n2))),
        "name_base_unspaced": flag((b1 != "") & (_glued(b1) == _glued(b2))),
        "name_first_token_match": first,
        "name_prefix2_match": F.when((F.size(t1) >= 2) & (F.size(t2) >= 2), flag((f1 == f2) & second)).otherwise(first),
        "is_acronym_match": sim.acronym(t1, t2),
        "name_soundex_match": F.when((x1 != "") & (x1 == x2), 1.0).otherwise(first) if serving else F.when((F.length(f1) >= 3) & (F.length(f2) >= 3), sounds).otherwise(first),
        "name_lcp_ratio": sim.common_prefix(n1, n2) / longest,
        "name_shared_tokens_count": F.least(F.size(F.array_intersect(t1, t2)), F.lit(5)) / 5.0,
        "name_base_jaccard": sim.jaccard(*_both("base_toks")),
        "name_qgram_jaccard": sim.jaccard(*_both("grams")),
        "name_jaccard": sim.jaccard(t1, t2),
        "name_len_diff": F.abs(F.length(n1) - F.length(n2)) / longest,
        "name_token_count_diff": F.abs(F.size(t1) - F.size(t2)) / most,
        "name_num_conflict": flag((F.size(q1) > 0) & (F.size(q2) > 0) & ~_same_set(q1, q2)),
    }
    both = (a1 != "") & (a2 != "")
    house = F.when((h1 != "") & (h1 == h2), 1.0).when((h1 == "") | (h2 == ""), 0.5).otherwise(0.0)
    numbered = (F.size(d1) > 0) & (F.size(d2) > 0)
    shared = F.size(F.array_intersect(d1, d2))
    gap = F.least(F.abs(F.expr("try_cast(s_house_num AS BIGINT)") - F.expr("try_cast(t_house_num AS BIGINT)")), F.lit(100)) / 100.0
    street = F.when(y1.isNotNull() & y2.isNotNull(), F.when(y1 == y2, 1.0).otherwise(0.5 if serving else 0.0)).otherwise(0.5)

    def tail(w: Column) -> Column:
        return F.slice(w, F.greatest(F.size(w) - 1, F.lit(1)), 2)

    addressed = {  # value with both addresses, value without
        "house_num_match": (house, 0.5),
        "house_num_diff": (F.when((h1 != "") & (h2 != ""), gap).otherwise(F.when(house == 1.0, 0.0).otherwise(0.5)), 0.5),
        "addr_has_shared_num": (F.when(numbered, flag(shared > 0)).otherwise(0.5), 0.5),
        "addr_nums_jaccard": (F.when(numbered, sim.jaccard(d1, d2)).otherwise(0.5), 0.5),
        "addr_nums_conflict": (F.when(numbered, flag(shared == 0)).otherwise(0.0), 0.0),
        "addr_exact": (flag(a1 == a2), 0.0),
        "addr_first_token_match": (flag(F.try_element_at(w1, F.lit(1)) == F.try_element_at(w2, F.lit(1))), 0.0),
        "addr_soundex_match": (street, 0.5),
        "addr_tail_overlap": (sim.overlap(tail(w1), tail(w2)), 0.0),
        "addr_shared_tokens_count": (F.least(F.size(F.array_intersect(w1, w2)), F.lit(8)) / 8.0, 0.0),
        "addr_qgram_jaccard": (sim.jaccard(*_both("a_grams")), 0.0),
        "addr_overlap": (sim.overlap(w1, w2), 0.0),
    }
    out["has_addr_both"] = flag(both)
    if serving:
        same_name, same_addr = (n1 != "") & (n1 == n2), a1 == a2  # two empty names are not equal
        ones = {"name_unspaced_match", "name_base_unspaced", "name_first_token_match", "name_prefix2_match", "name_soundex_match", "name_lcp_ratio", "name_base_jaccard", "name_qgram_jaccard", "name_jaccard"}
        zeros = {"is_acronym_match", "name_len_diff", "name_token_count_diff", "name_num_conflict"}
        for k in ones | zeros:
            out[k] = F.when(same_name, 1.0 if k in ones else 0.0).otherwise(out[k])
        out["name_shared_tokens_count"] = F.when(same_name, F.least(F.size(t1), F.lit(5)) / 5.0).otherwise(out["name_shared_tokens_count"])
        for k in ("addr_first_token_match", "addr_soundex_match", "addr_tail_overlap", "addr_qgram_jaccard", "addr_overlap"):
            addressed[k] = (F.when(same_addr, 1.0).otherwise(addressed[k][0]), addressed[k][1])
        addressed["addr_shared_tokens_count"] = (F.when(same_addr, F.least(F.size(w1), F.lit(8)) / 8.0).otherwise(addressed["addr_shared_tokens_count"][0]), 0.0)
    out |= {k: F.when(both, v).otherwise(F.lit(missing)) for k, (v, missing) in addressed.items()}
    coded = (p1 != "") & (p2 != "")
    out["both_have_postal"] = flag(coded)
    for k, v, missing in (
        ("postal_match", p1 == p2, 0.5),
        ("postal_prefix2", F.substring(p1, 1, 2) == F.substring(p2, 1, 2), 0.5),
        ("postal_prefix3", F.substring(p1, 1, 3) == F.substring(p2, 1, 3), 0.5),
        ("postal_conflict", F.substring(p1, 1, 2) != F.substring(p2, 1, 2) if serving else p1 != p2, 0.0),
    ):
        out[k] = F.when(coded, flag(v)).otherwise(F.lit(missing))
    out["is_source2"] = flag(F.col("t_id").startswith("S2-"))
    return out


def features(rows: DataFrame, profile: str = "canonical") -> DataFrame:
    """(s1_id, t_id, cand_rank, s1_ord, 45 features) of pairs."""
    rows = rows.withColumns({"_n": sim.fuzzy(F.col("s_norm_name"), F.col("t_norm_name")), "_a": sim.fuzzy(F.col("s_norm_addr"), F.col("t_norm_addr"))})
    both = (F.col("s_norm_addr") != "") & (F.col("t_norm_addr") != "")
    out = native(profile)
    for k, part in (("name_fuzz_ratio", "ratio"), ("name_token_sort", "sort"), ("name_token_set", "set"), ("name_partial_ratio", "partial")):
        out[k] = F.col(f"_n.{part}")
    for k, part in (("addr_fuzz_ratio", "ratio"), ("addr_token_sort", "sort"), ("addr_token_set", "set"), ("addr_partial_ratio", "partial")):
        out[k] = F.when(both, F.col(f"_a.{part}")).otherwise(0.0)
    other = F.when(both, F.col("_a.sort")).otherwise(0.5)
    out["name_x_addr_sim"] = F.col("_n.sort") * other
    out["geom_mean_sim"] = F.sqrt(F.col("_n.sort") * other)
    return rows.select("s1_id", "t_id", "cand_rank", "s1_ord", *(out[k].cast("double").alias(k) for k in NAMES))
