"""Normalization and similarity on literal values."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import similarity as sim
from tessera.functions import text


def one(spark, values, f, schema="x string"):
    rows = spark.createDataFrame([(v,) if not isinstance(v, tuple) else v for v in values], schema)
    return [r[0] for r in rows.withColumn("_i", F.monotonically_increasing_id()).coalesce(1).orderBy("_i").select(f).collect()]


def test_country(spark):
    assert one(spark, [None, "", "  france ", "   ", "\t new\u00a0zealand\u3000\n"], text.normalize_country(F.col("x"))) == ["UNKNOWN", "UNKNOWN", "FRANCE", "", "NEW\u00a0ZEALAND"]


def test_names(spark):
    cases = {"Tata Pvt Ltd": "tata private limited limited", "Café & Société SARL": "cafe and company sarl", "h0tel.com": "hotel", "Acme L.L.C.": "acme l l c", None: "", "": "", "½ ™ ﬁx ß 12": "12 tm fix 12", "A1 Müller Co": "al muller company", "𝐀𝓬𝔪𝖾 ㎏ Ⅻ 𝟏𝟐 —’🙂": "acme kg xii 12"}
    assert one(spark, list(cases), text.normalize_name(F.col("x"))) == list(cases.values())
    assert one(spark, ["tata private limited limited", "sa limited", "ab limited"], text.base_name(F.col("x"))) == ["tata", "sa limited", "ab limited"]


def test_addresses(spark):
    def get(a, k):
        return one(spark, [a], text.normalize_address(F.col("x"))[k])[0]

    assert [get("12 MG Rd, Pune 411057", k) for k in ("norm_addr", "postal_code", "house_num", "addr_nums")] == ["12 mg road pune 411057", "411057", "12", "12,411057"]
    assert get("5 Elm Ct, FL 33101", "norm_addr") == "5 elm connecticut florida 33101"
    assert get("012345", "postal_code") == "" and get("12A Main St", "house_num") == "" and get(None, "norm_addr") == ""
    assert get("1 a 12345 b 543210 c", "postal_code") == "543210"


def test_parts(spark):
    assert one(spark, ["the acme dba roadrunner", "mr  bean", " dba ", "m s shop"], text.name_parts(F.col("x"))) == [["acme", "roadrunner"], ["bean"], ["dba"], ["shop"]]


def test_soundex(spark):
    assert one(spark, ["ashcraft", "tymczak", "pfister", "tata", "a1b", ""], sim.soundex(F.col("x"))) == ["A226", "T522", "P236", "T300", "", ""]


def test_grams_and_sets(spark):
    assert [sorted(x) for x in one(spark, ["ab", "", "a bcd"], sim.grams3(F.col("x")))] == [["ab"], [], ["abc", "bcd"]]
    pair = "a array<string>, b array<string>"
    cases = [(["a", "b", "b"], ["b", "c"]), ([], ["a"]), (["tcs"], ["tata", "consultancy", "services"])]
    assert one(spark, cases, sim.jaccard(F.col("a"), F.col("b")), pair) == [pytest.approx(1 / 3), 0.0, 0.0]
    assert one(spark, cases, sim.overlap(F.col("a"), F.col("b")), pair) == [0.5, 0.0, 0.0]
    assert one(spark, cases, sim.acronym(F.col("a"), F.col("b")), pair) == [0.0, 0.0, 1.0]


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row, old = [0], row
        for j, y in enumerate(b):
            row.append(old[j] + 1 if x == y else max(row[-1], old[j + 1]))
    return row[-1]


def test_subsequence_scores():
    rnd = random.Random(4)
    for _ in range(300):
        a, b = ("".join(rnd.choices("abc ", k=rnd.randrange(0, 90))) for _ in "ab")
        assert sim.lcs(a, b) == plain_lcs(a, b)
        for f in (sim.ratio, sim.token_sort_ratio, sim.token_set_ratio, sim.partial_ratio):
            assert 0 <= f(a, b) <= 100.0001 and f(a, b) == pytest.approx(f(b, a))
    assert sim.ratio("kitten", "sitting") == pytest.approx(61.538, abs=1e-3)
    assert sim.ratio("", "") == 100 and sim.ratio("a", "") == 0
    assert sim.token_set_ratio("b a", "a b c") == 100 and sim.token_set_ratio("", "a") == 0
    assert sim.partial_ratio("abc", "xxabcxx") == 100 and sim.partial_ratio("", "") == 100


def plain_partial(a, b):
    def best(s, t):
        n = len(s)
        return max(200 * plain_lcs(s, w) / (len(s) + len(w)) for w in (t[max(i, 0) : i + n] for i in range(1 - n, len(t))))

    return best(a, b) if len(a) < len(b) else best(b, a) if len(b) < len(a) else max(best(a, b), best(b, a))


def test_partial_ratio_skips_no_window():
    rnd = random.Random(5)
    for _ in range(300):
        a, b = ("".join(rnd.choices("abcd", k=rnd.randrange(1, 9))) for _ in "ab")
        assert sim.partial_ratio(a, b) == pytest.approx(plain_partial(a, b))


def test_sql_functions(spark):
    sim.register(spark)
    assert spark.sql("SELECT token_sort_ratio('b a', 'a b'), fuzzy_scores('abc', 'abc').partial").first() == (1.0, 1.0)


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def plain_partial(a, b):
    """Every window of the longer string, cut ones included."""
    if not a or not b:
        return 100.0 * (a == b)
    pairs = [(a, b), (b, a)] if len(a) == len(b) else [tuple(sorted((a, b), key=len))]
    windows = [(s, x[max(i, 0) : i + len(s)]) for s, x in pairs for i in range(1 - len(s), len(x))]
    return max(200.0 * plain_lcs(s, w) / (len(s) + len(w)) for s, w in windows)


def test_batches_equal_the_definitions():
    draw = random.Random(7)
    texts = ["".join(draw.choices("ab cdé𝐀", k=draw.choice([0, 1, 2, 7, 20, 64, 65, 80]))) for _ in range(400)]
    a, b = texts[:200], texts[200:]
    assert sim.lcs_many(a, b).tolist() == [plain_lcs(x, y) for x, y in zip(a, b)] == [sim.lcs(x, y) for x, y in zip(a, b)]
    assert sim.partial_ratios(a[:80], b[:80]).tolist() == pytest.approx([plain_partial(x, y) for x, y in zip(a[:80], b[:80])])
    assert sim.partial_ratios(a, b).tolist() == pytest.approx([sim.partial_ratio(x, y) for x, y in zip(a, b)])
    assert sim.partial_ratios([], []).tolist() == sim.lcs_many([], []).tolist() == []
    many = [chr(0x4E00 + i) for i in range(3000)]
    assert sim.lcs_many(["".join(many[:50])] * 3, ["".join(many[25:])] * 3).tolist() == [25] * 3


def test_scores_of_pairs_met_before_are_kept(monkeypatch):
    import pandas as pd

    made = []

    def make(x, y):
        made.extend(zip(x, y, strict=True))
        return sim.ratios(x, y)

    held = sim._Held(make, most=3, chars=10)
    batches = [(["ab", "ab", "cd"], ["ac", "ac", "cd"]), (["ab", "long one", "cd"], ["ac", "long two", "cd"]), (["long one", "ab", None], ["long two", "ac", "x"]), (["e", "f", "g", "ab"], ["h", "h", "h", "ac"])]
    for a, b in batches:
        assert held(pd.Series(a), pd.Series(b)).ravel().tolist() == [sim.ratio(x or "", y or "") for x, y in zip(a, b)]
        assert len(held.new) <= 3 and len(held.old) <= 3
    assert made.count(("ab", "ac")) == 1 and made.count(("long one", "long two")) == 2
    monkeypatch.setattr(sim, "_best_window", None)  # equal strings need no windows
    assert sim.partial_ratios(["ab", "", "x" * 70], ["ab", "", "x" * 70]).tolist() == [100.0] * 3
