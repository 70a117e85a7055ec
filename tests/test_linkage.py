"""Blocking and decisions against plain restatements; evaluation, training, validation, files, streaming."""

import json
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import blocking, decide, evaluate, scoring, training, validate
from tessera.plans import linkage
from tessera.sources import tsv
from tessera.sources.world import truth, world

SF = "/root/testdata/sf0.001"


def plain_candidates(probes, targets, k):
    """Scan order: key type, key place, posting order; buckets of capped types keep 300 entries."""
    lists = defaultdict(list)
    for i, o, c, r, p, key in sorted(targets, key=lambda x: (x[1], x[3], x[4])):
        bucket = lists[c, r, key]
        if r < 3 or len(bucket) < 300:
            bucket.append(i)
    out = {}
    for i in {p[0] for p in probes}:
        seen = []
        for _, _, c, r, p, key in sorted((x for x in probes if x[0] == i), key=lambda x: (x[3], x[4])):
            for t in lists.get((c, r, key), []):
                if t not in seen and len(seen) < k:
                    seen.append(t)
        out[i] = seen
    return out


@pytest.mark.parametrize("k", [3, 35])
def test_candidates_equal_the_scan(spark, k):
    rnd = random.Random(k)
    schema = "id string, ord long, country string, key_rank int, key_ord int, key string"
    targets = [(f"T{i:04}", i, rnd.choice("AB"), rnd.randrange(10), rnd.randrange(3), rnd.choice("xy")) for i in range(900) for _ in range(2)]
    probes = [(f"S{i}", i, rnd.choice("AB"), rnd.randrange(10), j, rnd.choice("xyz")) for i in range(30) for j in range(4)]
    got = defaultdict(list)
    rows = blocking.candidates(spark.createDataFrame(probes, schema).repartition(3), spark.createDataFrame(targets, schema).repartition(5), k).collect()
    for r in sorted(rows, key=lambda r: r.cand_rank):
        got[r.s1_id].append(r.t_id)
    assert {i: x for i, x in plain_candidates(probes, targets, k).items() if x} == dict(got)


def test_keys(spark):
    e = spark.createDataFrame([("a", 1, "US", "the acme services dba tcs", "12345", "12", "12 mg road hinjewadi pune"), ("b", 2, "US", "", "", "12", "12 mg road hinjewadi pune")], "id string, ord long, country string, norm_name string, postal_code string, house_num string, norm_addr string")
    got = {(r.id, blocking.KEY_TYPES[r.key_rank], r.key) for r in blocking.block_keys(e).collect()}
    assert {x[1:] for x in got if x[0] == "b"} == {("addr_num_city", "12_pune"), ("addr_num_city", "12_hinjewadi")}
    assert {("a", "exact", "acme services"), ("a", "exact", "tcs"), ("a", "acronym", "tcs"), ("a", "tok", "acme"), ("a", "soundex", "A250"), ("a", "compound_postal", "acme_12345"), ("a", "compound_addr", "tcs_12"), ("a", "prefix2", "acme_services"), ("a", "unspaced", "acmeservices")} <= got
    assert not {x for x in got if x[1] == "tok" and x[2] in ("services", "tcs")}


def plain_decide(scores, names, gate, sibling, margin, cap):
    """One entity after the other, then claims, then caps."""
    from tessera.functions.similarity import token_sort_ratio

    ranked = {}
    for s in sorted({x[0] for x in scores}):
        own = sorted((x for x in scores if x[0] == s), key=lambda x: x[2])
        top = max(x[4] for x in own)
        if top < gate:
            continue
        cutoff = max(sibling, top - margin * min(1, max(0.4, top)) ** 0.5)
        own = [x for x in own if x[4] >= cutoff]
        p = {x[1]: x[4] for x in own}
        for a in [x[1] for x in own if x[1].startswith("S2")][:2]:
            for b in [x[1] for x in own if x[1].startswith("S3")][:2]:
                alike = token_sort_ratio(names[a], names[b]) / 100
                if alike >= 0.7:
                    p[a], p[b] = p[a] + 0.08 * alike, p[b] + 0.08 * alike
        ranked[s] = sorted(((round(min(1, p[x[1]]), 9), x[2], x[1]) for x in own), key=lambda x: (-x[0], x[1]))[: 2 * cap]
    best = {}
    for s in sorted(ranked, key=lambda s: int(s[3:])):
        for pb, _, t in ranked[s]:
            if t not in best or pb > best[t][0]:
                best[t] = (pb, s)
    out = set()
    for s, own in ranked.items():
        n = defaultdict(int)
        for _, _, t in own:
            if best[t][1] == s and n[t[:2]] < cap:
                n[t[:2]] += 1
                out.add((s, t))
    return out


def test_decisions_equal_the_loop(spark):
    rnd = random.Random(8)
    names = {f"{src}-{i}": rnd.choice(["tata steel", "steel tata", "acme", "acme corp", "zeta"]) for src in ("S2", "S3") for i in range(20)}
    scores = []
    for s in range(25):
        for rank, t in enumerate(rnd.sample(sorted(names), 9), 1):
            scores.append((f"S1-{s}", t, rank, s, round(rnd.choice([0.3, 0.5, 0.6, 0.7, 0.9, 1.0]), 3)))
    df = spark.createDataFrame(scores, "s1_id string, t_id string, cand_rank int, s1_ord long, p double").repartition(7)
    got = decide.decide(df, spark.createDataFrame(list(names.items()), "t_id string, norm_name string"), 0.58, 0.38, 0.22, 2)
    assert {(r.s1_id, r.t_id) for r in got.collect()} == plain_decide(scores, names, 0.58, 0.38, 0.22, 2)


def test_prediction_keeps_its_promises(spark):
    s1, targets = world(spark, SF)
    found, matches = linkage.predict(s1, targets)
    pairs = {(r.s1_id, r.t_id) for r in matches.collect()}
    cands = {(r.s1_id, r.t_id) for r in found.collect()}
    assert pairs and pairs <= cands
    assert len({t for _, t in pairs}) == len(pairs)  # a target has one owner
    assert {(r.s1_id, r.t_id) for r in linkage.predict(s1.repartition(13), targets.repartition(3))[1].collect()} == pairs


def test_f05(spark):
    t = spark.createDataFrame([("a", ["47", "812"]), ("b", []), ("c", []), ("d", ["1"])], "s1_id string, matched array<string>")
    p = spark.createDataFrame([("a", "47"), ("a", "193"), ("a", "812"), ("c", "9")], "s1_id string, t_id string")
    got = {r.s1_id: r.f05 for r in evaluate.entity_f05(t, p).collect()}
    assert got["a"] == pytest.approx(0.714, abs=1e-3) and (got["b"], got["c"], got["d"]) == (1.0, 0.0, 0.0)
    assert evaluate.macro_f05(t.limit(0), p).first().macro_f05 == 0.0


def test_grid():
    assert len(training.grid(*training.FULL_GRID)) == 900 and len(training.grid(*training.SMALL_GRID)) == 300


def plain_grid(scores, truth, points):
    """Every point over every entity, one after the other."""
    own = defaultdict(list)
    for s, t, rank, p in scores:
        own[s].append((-p, rank, t))
    out = {}
    for i, gate, sibling, margin, cap in points:
        total = 0.0
        for s, true in truth.items():
            pairs, taken, used = sorted(own[s]), set(), defaultdict(int)
            if pairs and -pairs[0][0] >= gate:
                for q, _, t in pairs:
                    if -q >= max(sibling, -pairs[0][0] - margin) and (t[:2] not in ("S2", "S3") or used[t[:2]] < cap):
                        taken.add(t)
                        used[t[:2]] += 1
            tp = len(taken & true)
            total += (not taken) if not true else 1.25 * tp / (1.25 * tp + len(taken) - tp + 0.25 * (len(true) - tp)) if tp else 0.0
        out[i] = round(total / len(truth), 9)
    return out


def test_grid_scores_equal_the_loop(spark):
    rnd = random.Random(4)
    truth = {f"S1-{i}": set(rnd.sample([f"S{j}-{n}" for j in (2, 3) for n in range(5)], rnd.choice([0, 0, 1, 2, 5]))) for i in range(60)}
    scores = [(s, t, r, round(rnd.choice([0.2, 0.35, 0.5, 0.5, 0.66, 0.8, 0.9]), 2)) for s in truth if rnd.random() < 0.9 for r, t in enumerate(rnd.sample([f"{j}-{n}" for j in ("S2", "S3", "X") for n in range(5)], rnd.randint(1, 15)))]
    points = training.grid([0.4, 0.5, 0.85], [0.2, 0.4], [0.15, 0.3], [1, 2, 3])
    lists = spark.createDataFrame([(s, sorted(m)) for s, m in truth.items()], "s1_id string, matched array<string>")
    got = training.grid_scores(spark.createDataFrame(scores, "s1_id string, t_id string, cand_rank int, p double"), lists, points).collect()
    assert {r.point: r.macro_f05 for r in got} == pytest.approx(plain_grid(scores, truth, points), abs=2e-9) and len(got) == len(points)


def test_blocks_of_long_lists_are_numbered_through(spark, monkeypatch):
    monkeypatch.setattr(blocking, "BLOCK_ROWS", 7)
    rnd = random.Random(3)
    rows = [(f"t{i}", i, "US", rnd.choice([0, 2, 8]), o, rnd.choice("ab")) for i in range(200) for o in range(rnd.choice([1, 2]))]
    got = {(r.key_rank, r.key, r.pos): r.t_id for r in blocking.posting_lists(spark.createDataFrame(rows, "id string, ord long, country string, key_rank int, key_ord int, key string").repartition(6)).collect()}
    want = {}
    for rank in (0, 2, 8):
        for key in "ab":
            for pos, r in enumerate(sorted((r for r in rows if r[3] == rank and r[5] == key), key=lambda r: (r[1], r[4])), 1):
                want[rank, key, pos] = r[0]
    assert got == want


def test_serving_features_of_empty_names(spark):
    """Two empty names are not an equal name."""
    e = spark.createDataFrame([("a", 1, "US", "", "", "12 mg road pune", "", "12", "12"), ("S2-1", 2, "US", "", "", "12 mg road pune", "", "12", "12"), ("S2-2", 3, "US", "acme", "acme", "", "", "", "")], "id string, ord long, country string, norm_name string, base_name string, norm_addr string, postal_code string, house_num string, addr_nums string")
    found = spark.createDataFrame([("a", "S2-1", 1), ("a", "S2-2", 2)], "s1_id string, t_id string, cand_rank int")
    rows = {r.t_id: r for r in linkage.pair_features(e, e, found, "serving").collect()}
    for name in ("name_exact", "name_unspaced_match", "name_jaccard", "name_qgram_jaccard", "name_lcp_ratio", "name_soundex_match", "name_base_jaccard", "name_shared_tokens_count"):
        assert rows["S2-1"][name] == 0.0, name
    assert rows["S2-1"].addr_exact == 1.0


def toy_encoder():
    """Token vectors of word lengths and first letters."""

    def run(texts):
        words = [t.split() for t in texts]
        most = max(map(len, words))
        vectors, mask = np.zeros((len(texts), most, 3)), np.zeros((len(texts), most), dtype=np.int64)
        for i, own in enumerate(words):
            for j, w in enumerate(own):
                vectors[i, j], mask[i, j] = (len(w), ord(w[0]) - 96, 1), 1
        return vectors, mask

    return run


def test_encoder(spark):
    names = spark.createDataFrame([("a", "acme co"), ("b", "tata"), ("c", ""), ("d", None)], "id string, name string")
    got = {r.id: r.vec for r in scoring.encode(names, toy_encoder, 1).collect()}
    assert set(got) == {"a", "b"}
    want = np.array([3.0, 2.0, 1.0])
    assert np.allclose(got["a"], want / np.linalg.norm(want), atol=1e-6)
    s1, targets = world(spark, SF)
    s1 = s1.where("k < 60")
    _, plain = linkage.predict_hybrid(s1, targets)
    found, matches = linkage.predict_hybrid(s1, targets, make_encoder=toy_encoder)
    assert matches.count() > 0 and {(r.s1_id, r.t_id) for r in matches.collect()} <= {(r.s1_id, r.t_id) for r in found.collect()}
    assert plain.count() > 0


def test_rows_of_many_files_are_numbered_in_file_order(spark, tmp_path):
    (tmp_path / "in").mkdir()
    n = 0
    for f in range(4):
        size = (50, 4000, 1, 700)[f]
        (tmp_path / "in" / f"part-{f}.tsv").write_text("entity_id\tcountry\n" + "".join(f"{n + i}\tUS\n" for i in range(size)))
        n += size
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = tsv.read_tsv(spark, str(tmp_path / "in"), spark.createDataFrame([], "entity_id string, country string").schema).collect()
        assert len(rows) == n and all(int(r.entity_id) == r.ord for r in rows)
        lines = validate.read_lines(spark, str(tmp_path / "in" / "part-1.tsv")).collect()
        assert sorted(r.line_no for r in lines) == list(range(2, 4002)) and all(int(r.value.split("\t")[0]) == r.line_no + 48 for r in lines)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def dataset(spark, root):
    """The linkage world as the files that the commands read."""
    s1, targets = world(spark, SF)
    s1 = s1.where("k < 80")
    for kind in ("train", "test"):
        (root / kind).mkdir(parents=True)
        for name, rows in (("source1", s1), ("source2", targets.where("source = 'S2'")), ("source3", targets.where("source = 'S3'"))):
            lines = ["\t".join(x or "" for x in r) for r in rows.orderBy("ord").select(*tsv.RECORD.names).collect()]
            (root / kind / f"{kind}_{name}.tsv").write_text("\n".join(["\t".join(tsv.RECORD.names), *lines]) + "\n")
    lists = "".join(f"{r.s1_id}\t{','.join(r.matched)}\n" for r in truth(spark, SF).collect())
    (root / "train" / "train_ground_truth.tsv").write_text("source1_entity_id\tmatched_entity_ids\n" + lists)


def test_commands(spark, tmp_path, capsys, monkeypatch):
    from tessera import cli

    root, out = tmp_path / "data", tmp_path / "out"
    dataset(spark, root)
    data, files = ["--data-dir", str(root)], [str(tmp_path / "model"), str(tmp_path / "t.json")]
    assert cli.run(spark, ["predict", *data, "--model-path", files[0]]) == 1 and "no such file" in capsys.readouterr().err
    assert cli.run(spark, ["predict", "--data-dir", str(tmp_path / "nowhere"), "--linear"]) == 1
    monkeypatch.setattr(training, "FULL_GRID", ([0.5], [0.3], [0.2], [3]))
    monkeypatch.setattr(training, "SMALL_GRID", ([0.4, 0.5], [0.3], [0.2], [3]))
    assert cli.run(spark, ["train", *data, "--model-out", files[0], "--threshold-out", files[1], "--trees", "2"]) == 0
    assert set(json.loads((tmp_path / "t.json").read_text())) == {"gate_threshold", "sibling_threshold", "best_threshold", "best_margin", "max_per_source", "val_f05"}
    assert cli.run(spark, ["calibrate", *data, "--model-path", files[0], "--out-path", str(tmp_path / "c.json")]) == 0
    assert cli.run(spark, ["predict", *data, "--model-path", files[0], "--threshold-path", files[1], "--output-dir", str(out)]) == 0
    check = ["validate", "-m", str(out / "matching_results.tsv"), "-c", str(out / "candidate_pairs.tsv"), "-t", str(root / "test"), "--check-ids"]
    assert cli.run(spark, check) == 0 and "PASS" in capsys.readouterr().out
    assert cli.run(spark, ["hybrid", *data, "--linear", "--limit", "5", "--output-dir", str(tmp_path / "h"), "--encoder", "tests.test_linkage:toy_encoder"]) == 0
    assert len((tmp_path / "h" / "matching_results.tsv").read_text().splitlines()) == 6
    (out / "matching_results.tsv").write_text((out / "matching_results.tsv").read_text() + "S1-999999\tS2-000001\n")
    assert cli.run(spark, check) == 1 and "unexpected_entity" in capsys.readouterr().out
    (root / "test" / "test_source3.tsv").unlink()
    assert cli.run(spark, [*check[:2], str(tmp_path / "h" / "matching_results.tsv"), *check[3:]]) == 1
    assert "test_source3.tsv is missing" in capsys.readouterr().out
    assert cli.run(spark, ["audit", *data]) == 0
    said = capsys.readouterr().out
    assert "test S3: no file" in said and "train: targets cover all countries" in said and "pair_recall" in said
    assert cli.run(spark, ["pipeline", "--mode", "predict", *data]) == 1


def test_training_ceiling(spark):
    pairs = spark.createDataFrame([(f"S1-{i}", f"t{j}", 0) for i in range(50) for j in range(4)], "s1_id string, t_id string, label int")
    kept = training.limit_pairs(pairs, 30).groupBy("s1_id").count().collect()
    assert all(r["count"] == 4 for r in kept) and len(kept) == 8
    assert training.limit_pairs(pairs, 1000).count() == 200


def test_files(spark, tmp_path):
    src = tmp_path / "a.tsv"
    src.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t"Quoted" Co\t\tUS\nS1-2\tNA\tx y\tnull\n')
    rows = tsv.read_tsv(spark, str(src)).orderBy("ord").collect()
    assert [(r.business_name, r.business_address, r.country) for r in rows] == [('"Quoted" Co', None, "US"), ("NA", "x y", "null")]
    assert [r.entity_id for r in tsv.read_tsv(spark, str(src), columns=["entity_id"], head=1).collect()] == ["S1-1"]
    (tmp_path / "bad.tsv").write_text("entity_id,x\n1,2\n")
    with pytest.raises(ValueError):
        tsv.read_tsv(spark, str(tmp_path / "bad.tsv"))
    with pytest.raises(ValueError):
        tsv.stream_tsv(spark, str(tmp_path / "bad.tsv"))
    assert tsv.stream_tsv(spark, str(src)).isStreaming
    (tmp_path / "t.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1, S3-2,,S2-1\nS1-2\t\n \tx\nS1-1\tS2-9\n")
    assert {r.s1_id: r.matched for r in tsv.read_truth(spark, str(tmp_path / "t.tsv")).collect()} == {"S1-1": ["S2-9"], "S1-2": []}
    assert sorted(r.entity_id for r in tsv.read_ids(spark, str(src)).collect()) == ["S1-1", "S1-2"]
    out = tmp_path / "out"
    s1 = spark.createDataFrame([("S1-1", 0), ("S1-2", 1)], "entity_id string, ord long")
    pairs = spark.createDataFrame([("S1-1", "S3-2", 2), ("S1-1", "S2-1", 1)], "s1_id string, t_id string, rank int")
    tsv.write_lists(tsv.id_lists(s1, pairs, "rank", "matched_entity_ids"), str(out), True)
    text = next(out.glob("part-*")).read_text()
    assert text == "source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S3-2\nS1-2\t\n"
    found = validate.validate(spark, str(out), None, s1).collect()
    assert [(r.rule, r.severity) for r in found] == [("ids_not_checked", "warning")]
    (tmp_path / "m.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,\nS1-1\tS1-2\nS1-3 no tab\n\nS1-4\tS2-1,S2-1\n")
    rules = {r.rule for r in validate.validate(spark, str(tmp_path / "m.tsv"), str(tmp_path / "none.tsv"), s1, spark.createDataFrame([("S2-7",)], "entity_id string")).collect()}
    assert rules == {"duplicate_row", "wrong_prefix", "self_match", "malformed_row", "missing_entity", "unexpected_entity", "duplicate_id", "unknown_id", "file_missing"}
    for text, rule in (("", "file_empty"), ("a,b\n", "header_commas"), ("x\ty\n", "header_names")):
        (tmp_path / "h.tsv").write_text(text)
        assert rule in {r.rule for r in validate.validate(spark, str(tmp_path / "h.tsv"), None, s1).collect()}


def test_thresholds(tmp_path):
    path = str(tmp_path / "t.json")
    tsv.save_thresholds(path, {"gate": 0.7, "sibling": 0.3}, 0.9)
    assert json.loads((tmp_path / "t.json").read_text()) == {"gate_threshold": 0.7, "sibling_threshold": 0.3, "best_threshold": 0.7, "best_margin": 0.22, "max_per_source": 3, "val_f05": 0.9}
    assert tsv.load_thresholds(path, {"gate": 0.5})["gate"] == 0.5 and tsv.load_thresholds(path, {"gate": 0.5}, True)["gate"] == 0.7
    assert tsv.load_thresholds(None) == tsv.DEFAULTS and tsv.load_thresholds(None, {"margin": 0.1}, True, tsv.HYBRID_DEFAULTS) == {"gate": 0.58, "sibling": 0.35, "margin": 0.1, "max_per_source": 3}
    (tmp_path / "old.json").write_text('{"best_threshold": 0.61, "max_per_source": 2.0}')
    assert tsv.load_thresholds(str(tmp_path / "old.json")) == {"gate": 0.61, "sibling": 0.38, "margin": 0.22, "max_per_source": 2}


def test_trees_and_model_files(spark, tmp_path):
    s1, targets = world(spark, SF)
    model, found, score = linkage.train(s1, targets, truth(spark, SF), k=6, points=training.grid([0.5], [0.3], [0.2], [3]), evaluate=20, maxIter=2, maxDepth=3, minInstancesPerNode=1)
    scoring.save_model(model, str(tmp_path / "m"))
    assert scoring.load_model(str(tmp_path / "m")).numFeatures == 45 and found.max_per_source == 3 and 0 < score <= 1
    again, _ = linkage.calibrate(s1, targets, truth(spark, SF), model, 6, training.grid([0.4, 0.6], [0.3], [0.2], [3]))
    assert again.gate in (0.4, 0.6)


def test_stream(spark, tmp_path):
    from tessera.streaming import incremental

    s1, targets = world(spark, SF)
    src = str(tmp_path / "in")
    targets.drop("k", "source").write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = incremental.start(s1, stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    got = incremental.resolve(spark.read.parquet(str(tmp_path / "out")))
    assert got.count() > 0 and got.groupBy("t_id").count().where("count > 1").isEmpty()


def test_head_and_countries(spark):
    s1, targets = world(spark, SF)
    assert evaluate.uncovered_countries(s1.withColumn("country", F.lit("Peru")), targets).collect()[0][0] == "PERU"
    row = evaluate.summary(s1, linkage.predict(s1, targets)[1]).first()
    assert row.entities == 200 and 0 < row.matches


def big_keys(spark, tmp_path, n=40):
    """A folder of tables whose parts have keys from a million on, so that ten share an id."""
    part = spark.read.parquet(f"{SF}/part.parquet").where(f"p_partkey < {n}")
    part.withColumn("p_partkey", F.col("p_partkey") + 1_000_000).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    spark.read.parquet(f"{SF}/embeddings.parquet").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def equals_sql(name, d, rows):
    """The query's SQL over a folder's tables has the same rows."""
    import duckdb

    import __spark_entry__ as entry

    db = duckdb.connect()
    for table in ("part", "embeddings"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{d}/{table}.parquet/*.parquet')")
    want = db.sql(f"SELECT {', '.join(rows.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, rows.collect())) == sorted(want) != []


def test_truth_of_entities_that_share_an_id(spark, tmp_path):
    from tessera.plans import queries

    d = big_keys(spark, tmp_path)
    rows = queries.scan_truth(spark, d)
    assert rows.count() == 40
    equals_sql("scan_truth", d, rows)


def test_candidates_of_targets_that_share_an_id(spark):
    """A list's first k targets are k ids, however many rows share one."""
    schema = "id string, ord long, country string, key_rank int, key_ord int, key string"
    targets = [(f"T{i // 10}", i, "A", 1, 0, "x") for i in range(60)] + [("T9", 99, "A", 2, 0, "y")]
    probes = [("S0", 0, "A", 1, 0, "x"), ("S0", 0, "A", 2, 0, "y"), ("S1", 1, "A", 2, 0, "y")]
    rows = blocking.candidates(spark.createDataFrame(probes, schema), spark.createDataFrame(targets, schema), 5).collect()
    assert [r.t_id for r in sorted(rows, key=lambda r: r.cand_rank) if r.s1_id == "S0"] == plain_candidates(probes, targets, 5)["S0"] == ["T0", "T1", "T2", "T3", "T4"]
    assert [r.t_id for r in rows if r.s1_id == "S1"] == ["T9"]


def test_written_tables_leave_no_shuffle_files(spark):
    from tessera.storage import stash

    files = lambda: {str(x) for x in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()) if "shuffle_" in str(x)}
    before = files()
    assert stash(spark.range(1000).groupBy(F.col("id") % 7).count(), "sums").count() == 7
    made = spark.range(1000).groupBy(F.col("id") % 5).count()
    stash(made, "sums")
    assert not [f for f in files() - before if f.endswith(".data")][2:]


def test_blending_by_numbers_and_slices(spark, monkeypatch):
    from tessera import storage

    rnd = random.Random(5)
    rows = [(f"S{i}", f"T{rnd.randrange(40)}x{j}", j, i, rnd.choice([0.2, 0.35, 0.5, 0.7, 0.9])) for i in range(60) for j in range(4)]
    scores = storage.stash(spark.createDataFrame(rows, "s1_id string, t_id string, cand_rank int, s1_ord long, p double"), "scores")
    numbers = spark.createDataFrame([(n, [float(np.cos(n)), float(np.sin(n))]) for n in range(7)], "n int, vec array<double>")
    s = spark.createDataFrame([(f"S{i}", i % 8) for i in range(50)], "id string, n int")
    t = spark.createDataFrame([(x, int(x[1:].split("x")[0]) % 7) for x in {r[1] for r in rows}], "id string, n int")
    whole = scoring.blend(scores, tuple(x.join(numbers, "n").select("id", "vec") for x in (s, t)))
    monkeypatch.setattr(storage, "SLICE_ROWS", 50)
    sliced = storage.stash_slices(scores, "s1_id", lambda part: scoring.blend(part, (s, t, numbers)), "blended")
    assert sorted(map(tuple, sliced.collect())) == sorted(map(tuple, whole.collect())) and sliced.count() == 240


@pytest.mark.parametrize("name", ["hybrid_blend", "hybrid_results"])
def test_hybrid_of_entities_that_share_an_id(spark, tmp_path, name):
    from tessera.plans import queries

    d = big_keys(spark, tmp_path)
    rows = queries.QUERIES[name](spark, d)
    equals_sql(name, d, rows.select(*[c for c in rows.columns if c != "ord"]))


def test_scores_of_entities_that_share_an_id(spark, tmp_path):
    """Forty entities with four ids have the candidates that they have each for themselves."""
    from tessera.plans import queries

    d = big_keys(spark, tmp_path)
    s1, targets = (linkage.entities(x.withColumn("entity_id", F.concat(F.substring("entity_id", 1, 3), "k")), "own") for x in world(spark, d))
    want = linkage.candidate_pairs(s1, targets, 35).count()
    got = queries.gbt_scores(spark, d)
    assert got.count() == want > 0 and got.where(F.length("s1_id") != 9).count() == 0


def test_scores_are_of_the_production_model(spark, monkeypatch):
    from tessera.plans import queries

    fit, models = scoring.fit_trees, []
    monkeypatch.setattr(scoring, "fit_trees", lambda *a, **k: models.append(fit(*a, **k)) or models[-1])
    assert queries.gbt_scores(spark, SF).count() > 0
    (model,) = models
    wanted = scoring.PRODUCTION
    assert model.getNumTrees == wanted["maxIter"] == 350 and {k: model.getOrDefault(k) for k in wanted} == wanted


def test_trees_do_not_depend_on_how_rows_are_dealt(spark, monkeypatch):
    """One task or four, and the file order, make the same trees; they follow a rule that one feature cannot tell."""
    from tessera.operators import boosting, features
    from tessera.storage import stash

    rnd = random.Random(3)
    rows = []
    for i in range(600):
        x = [round(rnd.random(), 2) for _ in features.NAMES]
        rows.append((f"S{i}", f"T{i}", int((x[0] > 0.5) != (x[40] > 0.3)), *x))
    names = ", ".join(f"{n} double" for n in features.NAMES)
    table = lambda r: stash(spark.createDataFrame(r, f"s1_id string, t_id string, label int, {names}"), "rows").withColumns({"cand_rank": F.lit(1), "s1_ord": F.lit(0)})
    size = {"maxIter": 12, "stepSize": 0.5, "maxDepth": 4, "minInstancesPerNode": 5}
    one = scoring.fit_trees(table(rows), **size)
    monkeypatch.setattr(boosting, "TASK_ROWS", 150)
    four = scoring.fit_trees(table(rows[::-1]), **size)
    assert one.toDebugString.split("\n")[1:] == four.toDebugString.split("\n")[1:] and max(t.depth for t in one.trees) == 4
    scored = {r.s1_id: r.p for r in scoring.trees(table(rows), one).collect()}
    assert sum((scored[r[0]] > 0.5) == (r[2] == 1) for r in rows) >= 588
