"""Near-duplicates, substrings and decontamination against plain Python."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import bits
from tessera.llm import op05_decontaminate as dec
from tessera.llm import op06_substring as sub
from tessera.llm import op07_near as near
from tessera.llm.graph import components

from .conftest import FOLD, alnum, words


def plain_components(rows, k):
    sets = {}
    for r in rows:
        w = words((r[1] or "").translate(FOLD))
        sets[r[0]] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    ids = sorted(i for i in sets if i is not None)
    parent = {i: i for i in ids}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a in ids:
        for b in ids:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(docs, rows, k):
    got = near.near_duplicates(docs, k).collect()
    want = plain_components(rows, k)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)


def test_near_duplicates_of_nothing(empty):
    assert near.near_duplicates(empty).count() == 0


def test_keep_one_keeps_all_columns(docs, rows):
    kept = near.keep_one(docs, 2)
    assert kept.columns == docs.columns
    want = plain_components(rows, 2)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(r[0] for r in rows if r[0] is not None and want[r[0]][1] == r[0])


def test_repeated_rows_and_texts_of_one_id(spark):
    """Rows repeated more often than a window is long, and ids with several texts, which link them."""
    draw = random.Random(8)
    texts = [" ".join(draw.choices([f"w{i}" for i in range(300)], k=40)) for _ in range(30)]
    near_copy = lambda t: " ".join([*t.split()[:-1], "end"])
    rows = [(10, texts[0])] * 200 + [(11, near_copy(texts[0]))] * 150 + [(20, texts[1]), (20, texts[2]), (20, ""), (21, near_copy(texts[1])), (22, near_copy(texts[2])), (23, texts[3]), (24, texts[4])]
    rows += [(30, texts[5]), (30, texts[6]), (30, texts[7]), (29, texts[7]), (31, near_copy(texts[6])), (40, texts[8])]
    got = {(r.doc_id, r.n_shingles): r.component_id for r in near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), 2).collect()}
    want = {10: 10, 11: 10, 20: 20, 21: 20, 22: 20, 23: 23, 24: 24, 29: 29, 30: 29, 31: 29, 40: 40}
    assert all(c == want[i] for (i, n), c in got.items()) and {i for i, _ in got} == set(want)


def test_few_bits_lose_no_set(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(bits, "LEAST_BITS", 6)
    monkeypatch.setattr(bits, "MOST_BITS", 6)
    want = plain_components(rows, 2)
    assert all(r.doc_id is None or (r.n_shingles, r.component_id) == want[r.doc_id] for r in near.near_duplicates(docs, 2).collect())


def test_a_large_group_is_one_component(spark):
    base = [f"w{i}" for i in range(100)]
    texts = [(i, " ".join(base[: i % 100] + [f"x{i}"] + base[i % 100 :])) for i in range(400)]
    got = near.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), 2).collect()
    assert {r.component_id for r in got} == {0}


@pytest.mark.parametrize("seed", [1, 2])
def test_borderline_families_lose_no_link(spark, seed):
    """Many texts of one template about as alike as the threshold: windows are cut, most candidates are no links."""
    draw = random.Random(seed)
    base = [f"w{i}" for i in range(80)]
    texts = []
    for i in range(500):
        w = list(base)
        for at in draw.sample(range(80), draw.randint(4, 14)):
            w[at] = f"x{draw.randrange(40)}"
        texts.append((3 * i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), 2).collect()}
    want = plain_components(texts, 2)
    assert len({c for _, c in want.values()}) > 20 and got == want


def test_one_template_of_thousands_loses_no_link(spark):
    """Texts a little below the threshold to each other fill every window; the planted links among them must be found."""
    draw = random.Random(5)
    n, sets = 3000, []
    for i in range(n):
        sets.append(set(draw.sample([f"w{j}" for j in range(176)], 174)) | {f"x{i}.{j}" for j in range(26)})
    for i in range(0, 600, 2):  # far apart by their other words
        shared = [f"p{i}.{j}" for j in range(7)]
        for k in (i, n - 1 - i):
            sets[k] = {w for w in sets[k] if w not in {f"x{k}.{j}" for j in range(7)}} | set(shared)
    common = sorted({w for s in sets for w in s if w[0] != "x"})
    column = {w: j for j, w in enumerate(common)}
    has = np.zeros((n, len(common)), dtype=np.float32)
    for i, s in enumerate(sets):
        has[i, [column[w] for w in s if w in column]] = 1
    both = has @ has.T
    alike = 100 * both >= 80 * (400 - both)
    links = [(a, b) for a, b in np.argwhere(np.triu(alike, 1)).tolist()]
    want = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    texts = [(i, " ".join(sorted(s, key=lambda w: draw.random()))) for i, s in enumerate(sets)]
    got = {r.doc_id: r.component_id for r in near.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), 1).collect()}
    assert 100 < len(links) < 400 and got == {i: want.get(i, i) for i in range(n)}


def test_full_blocks_of_a_shingle_meet(spark, monkeypatch):
    """Every pair of blocks is compared: few classes in a block, one shingle in all sets."""
    draw = random.Random(6)
    sets = [np.array(sorted({1, *(draw.randrange(2, 14) for _ in range(6))}), dtype=np.uint64) for _ in range(60)]
    monkeypatch.setattr(near, "_BLOCK", 7)
    rows = []
    for i, s in enumerate(sets):
        bucket = (near.vec.mix(s ^ near.vec.U64(0x3C6EF372FE94F82B)) % near.vec.U64(near._PARITY)).astype(np.int64)
        rows.append((i, i % 50, bytearray(s.tobytes()), bytearray(np.packbits((np.bincount(bucket, minlength=near._PARITY) & 1).astype(bool)).tobytes())))
    got = {tuple(r) for r in near._exact(spark.createDataFrame(rows, "id long, label long, s binary, parity binary"), 60).collect()}
    plain = [set(s.tolist()) for s in sets]
    want = {(a, b) for a in range(60) for b in range(a) if a % 50 != b % 50 and 100 * len(plain[a] & plain[b]) >= 60 * len(plain[a] | plain[b])}
    want = {(b, a) for a, b in want}
    assert len(want) > 20 and want <= got


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7), (200, 201), (201, 202), (202, 200)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90, 200: 200, 201: 200, 202: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_removed(rows, size):
    low = {}
    for r in rows:
        w = words(r[1])
        for i in range(len(w) - size + 1):
            x = tuple(w[i : i + size])
            key = r[0] if r[0] is not None else 1 << 62
            low[x] = min(low.get(x, 1 << 62), key)
    out = []
    for r in rows:
        w = words(r[1])
        gone = set()
        for i in range(len(w) - size + 1):
            if low[tuple(w[i : i + size])] < (r[0] if r[0] is not None else 1 << 62):
                gone.update(range(i, i + size))
        out.append((r[0], len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("size,chunk", [(13, 1 << 12), (5, 1 << 20)])
def test_substrings(docs, rows, size, chunk):
    got = [tuple(r)[:4] for r in sub.remove_repeats(docs, size, chunk).collect()]
    key = lambda r: (r[0] is None, r)
    assert sorted(got, key=key) == sorted(plain_removed(rows, size), key=key)


def test_substrings_of_nothing(empty):
    assert sub.remove_repeats(empty).count() == 0


def test_substrings_of_extreme_ids(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [((1 << 63) - 1, text), (-(1 << 63), text), (None, text), (None, text), (5, text), (5, text), (7, None)]
    got = [tuple(r)[:3] for r in sub.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([((1 << 63) - 1, 30, 30), (-(1 << 63), 30, 0), (None, 30, 30), (None, 30, 30), (5, 30, 30), (5, 30, 30), (7, 0, 0)], key=str)
    with pytest.raises(TypeError):
        sub.remove_repeats(spark.createDataFrame([("x", text)], "doc_id string, text string"))


def test_one_passage_in_most_documents(spark):
    """A hot passage, single words that fill every prefix table, and repeats that no other chunk has."""
    draw = random.Random(9)
    passage = " ".join(draw.choices(["the", "of", "and"], k=60))
    rows = [(i, " ".join(draw.choices(["the", "of", "and", "x", "y"], k=40)) + " " + passage + (f" {i % 3} tail" if i % 5 else "")) for i in range(300)]
    got = [tuple(r)[:4] for r in sub.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 13, 1 << 11).collect()]
    assert sorted(got) == sorted(plain_removed(rows, 13))


def test_subtrees_have_the_depths_of_sorted_suffixes():
    draw = random.Random(2)
    text = draw.choices(range(3), k=400)
    size = 6
    suffixes = [text[i : i + size] for i in range(len(text) - size + 1)]
    codes = np.array(suffixes, dtype=np.uint8)
    full = np.array([sum(x * 3**j for j, x in enumerate(s)) for s in suffixes], dtype=np.uint64)
    order = sub.suffix_order(codes, full)
    assert [suffixes[i] for i in order] == sorted(suffixes)
    want = [0] + [next((j for j in range(size) if a[j] != b[j]), size) for a, b in zip(sorted(suffixes), sorted(suffixes)[1:])]
    assert sub.depths(codes[order], full[order]).tolist() == want
    assert sub.depths(np.zeros((2, size), dtype=np.uint8), np.array([1, 2], dtype=np.uint64)).tolist() == [0, size - 1]


def test_prefixes_are_as_long_as_they_must_be():
    h = np.array([1, 2, 3, 1, 2, 4, 1, 5, 6], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    runs, at = near.vec.Runs(h), np.array([0, 3, 6])
    one, two = runs(at, 1), runs(at, 2)
    heavy = {1: np.zeros(1 << 14, dtype=bool), 2: np.zeros(1 << 14, dtype=bool)}
    light = sub.Prefixes(3, 1 << 20, heavy).group(runs, at)
    assert len(set(light.tolist())) == 1
    heavy[1][sub._slots(one)] = True
    assert len(set(sub.Prefixes(3, 1 << 20, heavy).group(runs, at).tolist())) == 2
    heavy[2][sub._slots(two[:1])] = True
    assert len(set(sub.Prefixes(3, 1 << 20, heavy).group(runs, at).tolist())) == 3


def test_packing_round_trip():
    for x in ([], [5], [0, 1, 2, 1 << 40, (1 << 64) - 1], [3] * 4):
        assert sub.unpack(sub.pack(np.array(x, dtype=np.uint64))).tolist() == x
    for x in ([5], [-3, 9, 1 << 50], [(1 << 63) - 1, -(1 << 63)]):
        assert sub.unpack_ids(sub.pack_ids(np.array(x, dtype=np.int64))).tolist() == x


def plain_hits(rows, items, size):
    windows = defaultdict(set)
    for i, t in items:
        w = alnum(t)
        if i is not None and w:
            n = min(size, len(w))
            for j in range(len(w) - n + 1):
                windows[tuple(w[j : j + n])].add(str(i))
    sizes = {len(x) for x in windows}
    out = []
    for r in rows:
        w, hit, found = alnum(r[1]), set(), set()
        for n in sizes:
            for j in range(len(w) - n + 1):
                own = windows.get(tuple(w[j : j + n]))
                if own:
                    hit.update(range(j, j + n))
                    found |= own
        out.append((r[0], len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("most", [27, 3])
def test_decontamination(spark, docs, rows, most, monkeypatch):
    """With few bits nearly every word is a candidate; the join decides the same."""
    monkeypatch.setattr(bits, "LEAST_BITS", min(most, 20))
    monkeypatch.setattr(bits, "MOST_BITS", max(most, 6))
    text = words(rows[5][1])
    items = [("1", " ".join(text[-30:])), ("2", "The THING"), ("3", None), (None, "house river"), ("10", ""), ("4", " ".join(words(rows[0][1])[:11]).upper()), ("1", "文章"), ("20", "no such words at all in any of these texts, none"), ("x,y", "the water"), ("x", "thing the"), ("é", "the thing")]
    bench = spark.createDataFrame([(i, t, "x", 5) for i, t in items], "item_id string, text string, hits string, k1 int")
    got = [tuple(r)[:6] for r in dec.decontaminate(docs, bench).collect()]
    key = lambda r: (r[0] is None, r)
    want = plain_hits(rows, items, 10)
    assert sorted(got, key=key) == sorted(want, key=key) and any("x,y" in (i or "") for i, _ in items)
    clash = docs.withColumn("t1", docs.lang).withColumn("c0", docs.doc_id)
    kept = dec.keep_clean(clash, bench)
    dirty = {r[1] for r, w in zip(rows, want, strict=True) if w[5]}
    assert kept.columns == clash.columns and sorted(kept.collect(), key=str) == sorted((r for r in clash.collect() if r.text not in dirty), key=str)


def test_hit_words_are_those_of_the_runs(spark, docs, rows):
    text = words(rows[5][1])
    bench = spark.createDataFrame([(1, " ".join(text[-30:])), (2, "over")], "item_id long, text string")
    for r in dec.decontaminate(docs, bench).collect():
        runs = [tuple(map(int, x.split(":"))) for x in r.hits.split(",") if x]
        assert sum(b - a for a, b in runs) == r.n_hit and all(x[1] < y[0] for x, y in zip(runs, runs[1:]))


def test_decontamination_of_nothing(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert dec.decontaminate(docs, none).where("contaminated or n_hit > 0").count() == 0
    assert dec.decontaminate(empty, none).count() == 0
