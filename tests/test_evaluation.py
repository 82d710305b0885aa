"""Taxonomy, boards, bootstraps, drift, files and suites on small cases."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from privlytics.__main__ import main
from privlytics.functions import taxonomy, tokens
from privlytics.operators import bootstrap, comparison, detectors, drift, leaderboard, population
from privlytics.plans import suite
from privlytics.sources import files
from privlytics.sources.fixtures import id_docs

SF = "/root/testdata/sf0.001"
SPANS = "array<struct<start:int,end:int,label:string>>"


def test_taxonomy(spark):
    types, walk = taxonomy.entities(spark), taxonomy.crosswalk(spark)
    assert taxonomy.bioes_labels(types).count() == 73 and [r.name for r in taxonomy.special_types(types).collect()] == ["HEALTH_CONDITION"]
    assert taxonomy.conflicts(walk).count() == 0
    assert walk.select("name").distinct().join(types, "name", "left_anti").count() == 0
    twice = walk.unionByName(spark.createDataFrame([("tab", "LOC", "COURT")], "scheme string, native string, name string"))
    assert [r.native for r in taxonomy.conflicts(twice).collect()] == ["LOC"]
    df = spark.createDataFrame([("Ana in Cluj", [(0, 3, "PERSON"), (7, 11, "LOC"), (4, 6, "what")]), ("", []), (None, None)], f"text string, e {SPANS}")
    got = [r.t for r in df.select(taxonomy.native_tags(tokens.whitespace_tokens(F.col("text")), F.col("e"), "tab").alias("t")).collect()]
    assert got[:2] == [["S-PERSON", "O", "S-ADDRESS"], []]
    assert [r.t for r in df.select(taxonomy.mapped_entities(F.col("e"), "no such").alias("t")).collect()] == [[], [], None]


def test_rate_gaps(spark):
    pairs = spark.createDataFrame([("a", 900, 1000, 700, 1000), ("b", 5, 10, 5, 10), ("none", 0, 0, 3, 4)], "name string, detected_a long, total_a long, detected_b long, total_b long")
    got = {r.name: r for r in bootstrap.rate_gaps(pairs, "detection_rate").collect()}
    assert got["a"].gap == pytest.approx(0.2) and got["a"].excludes_zero and not got["b"].excludes_zero
    # brute force: single draws for each subject
    rng = np.random.default_rng(1)
    draws = (rng.random((4000, 1000)) < 0.9).mean(1) - (rng.random((4000, 1000)) < 0.7).mean(1)
    assert (got["a"].ci_low, got["a"].ci_high) == pytest.approx(tuple(np.quantile(draws, [0.025, 0.975])), abs=0.004)
    assert got["none"].rate_a == 0 and got["none"].gap == pytest.approx(-0.75)
    assert sorted(map(str, bootstrap.rate_gaps(pairs.repartition(3), "detection_rate").collect())) == sorted(map(str, got.values()))
    assert bootstrap.rate_gaps(pairs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        bootstrap.rate_gaps(pairs, "other")


def test_f1_intervals(spark):
    rng = np.random.default_rng(2)
    gold = rng.integers(1, 5, 300)
    tp = np.minimum(gold, rng.integers(0, 5, 300))
    rows = [("x", int(t), int(g), int(g)) for t, g in zip(tp, gold)]
    df = spark.createDataFrame([*rows, ("zero", 0, 0, 0)], "detector string, tp int, n_pred int, n_gold int")
    got = {r.detector: r for r in bootstrap.f1_intervals(df, replicates=4000).collect()}
    pick = rng.integers(0, 300, (4000, 300))
    brute = np.sort(2 * tp[pick].sum(1) / (2 * gold[pick].sum(1)))
    assert got["x"].n == 300 and got["x"].f1 == pytest.approx(tp.sum() / gold.sum())
    assert (got["x"].ci_low, got["x"].ci_high) == pytest.approx((brute[100], brute[3900]), abs=0.01)
    assert (got["zero"].f1, got["zero"].ci_low, got["zero"].ci_high) == (0, 0, 0)
    assert sorted(map(str, bootstrap.f1_intervals(df.repartition(5), replicates=4000).collect())) == sorted(map(str, got.values()))


def test_paired_gaps(spark):
    sub = lambda f: spark.createDataFrame([("p", i, f(i)) for i in range(400)], "name string, doc_id int, detected boolean")
    better = bootstrap.paired_gaps(sub(lambda i: i % 10 > 0), sub(lambda i: i % 4 > 0), ["doc_id"]).first()
    assert better.n == 400 and better.gap == pytest.approx(0.1 - 0.25) and better.significant and better.ci_low < better.gap < better.ci_high
    same = bootstrap.paired_gaps(sub(lambda i: i % 4 > 0), sub(lambda i: i % 4 > 0), ["doc_id"]).first()
    assert same.gap == 0 and not same.significant


def test_centroid_intervals(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal([1, 0, 0], 0.5, (300, 3)), rng.normal([1, 1, 0], 0.5, (300, 3))
    rows = [(i, s, [float(v) for v in x]) for s, xs in (("a", a), ("b", b)) for i, x in enumerate(xs, 1000 * (s == "b"))]
    df = spark.createDataFrame([*rows, (-1, "a", None)], "id long, side string, vec array<double>")
    r = bootstrap.centroid_intervals(df, replicates=600).first()
    dist = lambda x, y: 1 - x.mean(0) @ y.mean(0) / np.linalg.norm(x.mean(0)) / np.linalg.norm(y.mean(0))
    assert r.point == pytest.approx(dist(a, b))
    brute = [dist(a[rng.integers(0, 300, 300)], b[rng.integers(0, 300, 300)]) for _ in range(600)]
    assert (r.ci_low, r.ci_high) == pytest.approx(tuple(np.quantile(brute, [0.025, 0.975])), abs=0.02)
    again = bootstrap.centroid_intervals(df.repartition(7), replicates=600).first()
    assert (again.ci_low, again.ci_high) == pytest.approx((r.ci_low, r.ci_high))


def test_drift(spark):
    area = lambda rows: drift.frontier_area(spark.createDataFrame(rows, "side string, cluster int")).first().score
    same = [(s, c) for s in "ab" for c in range(5) for _ in range(4)]
    apart = [("a", 0)] * 10 + [("b", 1)] * 10
    assert area(same) == pytest.approx(1.0) and area(apart) < 0.05
    near = area([("a", 0)] * 10 + [("b", 0)] * 9 + [("b", 1)])
    assert area(apart) < near < 1
    vecs = spark.createDataFrame([(s, [float(c * 10 + i % 2), 1.0]) for s, c in (("a", 0), ("b", 0), ("b", 1)) for i in range(20)], "side string, vec array<double>")
    assert drift.clusters(vecs, bins=2).groupBy("cluster").count().count() == 2
    v = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([],)], "v array<double>").select(drift.normalized(F.col("v")).alias("u")).collect()
    assert [r.u for r in v] == [[0.6, 0.8], [0.0, 0.0], []]
    d = spark.createDataFrame([("x", "a", 0.5, 0.4, 0.1), ("x", "b", 1.0, 0.1, 0.3), ("y", "a", 1.0, 0.1, 0.3), ("y", "b", 1.0, 0.1, 0.3)], "language string, side string, unique_ratio double, top_share double, ttr double")
    assert [(r.language, round(r.score, 9), r.place) for r in drift.most_templated(d).orderBy("place").collect()] == [("x", 1.0, 1), ("y", 0.0, 2)]
    rows = spark.createDataFrame([("m", "a", 5, 10, 0.9), ("m", "b", 30, 40, 0.7), ("only a", "a", 1, 2, 0.5), ("none", "a", None, None, 0.5), ("none", "b", 1, 2, None)], "name string, config string, detected long, total long, f1 double")
    table = drift.drift_table(rows, "a", "b").collect()
    assert [r.name for r in table] == ["m"] and table[0].gap == pytest.approx(-0.25) and table[0].f1_gap == pytest.approx(0.2)
    m = drift.matched_pairs(drift.drift_pairs(rows, "a", "b")).first()
    assert (m.detected_a, m.total_a, m.detected_b, m.total_b) == (5, 10, 8, 10)  # 7.5 goes to even
    both = lambda rows: spark.createDataFrame(rows, "name string, f1 double, ci_high double")
    got = drift.desaturation(both([("m", 0.999, 1.0), ("n", 0.9, 1.0), ("o", 0.9, 1.0)]), both([("m", 0.8, 0.85), ("n", 0.95, 0.97)])).orderBy("name").collect()
    assert [(r.name, r.drop, r.desaturates) for r in got] == [("m", 0.199, True), ("n", -0.05, False)]


def test_board(spark, tmp_path):
    df = spark.createDataFrame([("own", "m", "ai4privacy-openpii-ro-v1", "s2", 0.5), ("own", "m", "de", "s1", None), (None, None, None, None, 0.1), ("openmed", "x", "ai4privacy-openpii--v1", "s1", 0.2)], "adapter string, model_id string, config string, spec string, f1 double")
    marks = [r.contamination for r in leaderboard.annotate(df, own=("own",)).collect()]
    assert marks == ["unknown", "clean_held_out", "unknown", "in_distribution"]
    kept = leaderboard.annotate(df.withColumn("config_status", F.lit("citable-validated"))).first()
    assert kept.config_status == "citable-validated"
    board = leaderboard.build(df, own=("own",))
    path = tmp_path / "new" / "board.json"
    files.write_board(board, str(path))
    entries = json.loads(path.read_text())["entries"]
    assert sorted(entries) == ["?::?", "openmed::x", "own::m"] and [s["spec"] for s in entries["own::m"]] == ["s1", "s2"]
    card = dict.fromkeys(leaderboard.CARD_FIELDS, "x") | {"hf_model_id": "org/m@1", "adapter": "a"}
    assert leaderboard.validate_card(card, ("a",)) is card
    for bad in ([], card | {"domains": []}, card | {"adapter": "z"}, card | {"hf_model_id": "org/m"}):
        with pytest.raises(ValueError):
            leaderboard.validate_card(bad, ("a",))


def test_families(spark):
    gaps = spark.createDataFrame([("d", "f", True), ("e", "f", False), ("d", "g", False)], "detector string, family string, holds boolean")
    leaks = spark.createDataFrame([("p", "f", 1, 10, 0.3, 0.1), ("p", "g", 2, 10, 0.5, 0.2)], "detector string, family string, missed long, total long, ci_high double, leak_rate double")
    s = comparison.summary(gaps, leaks, "p")
    assert {r.family: (r.gaps, r.holding, r.holds, r.missed) for r in s.collect()} == {"f": (2, 1, True, 1), "g": (1, 0, False, 2)}
    assert tuple(comparison.consolidated(s).first()) == (0.5, 3, 20, False, 0.15)
    assert [tuple(r) for r in comparison.common_models(gaps).collect()] == [("d", False)]


def test_population_bounds(spark):
    joint = spark.createDataFrame([("a", "c", 0.5), ("a", "d", 0.25), ("b", "c", 0.25)], "x string, y string, p double")
    rows = spark.createDataFrame([("a", "c"), ("b", "d"), ("z", "c"), (None, "c")], "x string, y string")
    got = {(r.x, r.y): r.xi_upper for r in population.independent_uniqueness(rows, joint, ["x", "y"], 1).collect()}
    assert got == {("a", "c"): 1 - 0.75 * 0.75, ("b", "d"): 1 - 0.25 * 0.25, ("z", "c"): 1.0, (None, "c"): None}
    assert population.status(True)["reported"] is False and population.status(False, "x")["reference"] == "x"


def test_files(spark, tmp_path):
    (tmp_path / "rows.json").write_text(json.dumps([{"a": 1, "t": "x"}, {"a": 2}]))
    assert files.json_rows(spark, str(tmp_path / "rows.json"), "a").count() == 2
    with pytest.raises(ValueError):
        files.json_rows(spark, str(tmp_path / "rows.json"), "nope")
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "x").mkdir()
    (tmp_path / "s" / "x" / "no.yaml").write_text("name: no")
    (tmp_path / "s" / "b.yaml").write_text("name: B\ntask: detection\nlanguages: [ro]\nmetrics: [entity_f1]\ndataset: {config: en}\nother: 1\n")
    (tmp_path / "s" / "a.yaml").write_text("name: A\ntask: anonymization\ndataset: {config: gone}\n")
    specs = files.load_suite(str(tmp_path / "s"))
    assert [s.name for s in specs] == ["A", "B"] and specs[1].metrics == ("entity_f1",) and specs[1].extra == {"other": 1}
    for bad in ({"name": "x"}, {"name": "x", "task": "cook", "dataset": {}}, []):
        with pytest.raises(ValueError):
            files.parse_spec(bad)

    def load(spark, spec):
        return spark.read.parquet(str(tmp_path / "gone")) if spec.dataset["config"] == "gone" else id_docs(spark, SF)

    done, skipped = suite.run_suite(spark, specs, [detectors.DUMMY], load)
    assert skipped == ["A"] and [(r.detector, r.f1) for r in done["B"]["entity_f1"].collect()] == [("dummy", 0.0)]
    with pytest.raises(KeyError):
        suite.evaluate(id_docs(spark, SF), ("nope",))
    with pytest.raises(NotImplementedError):
        suite.evaluate(id_docs(spark, SF), ("membership_inference",))
    rows = spark.createDataFrame([("en", 2), ("en", 1), ("fr", 3)], "lang string, i int")
    assert sorted(map(tuple, files.head_per_group(rows, "lang", ["en"], 1, "i").collect())) == [("en", 1)]
    with pytest.raises(ValueError):
        files.head_per_group(rows, "lang", ["en", "xx"], 1, "i")
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.csv").write_bytes(b"hello")
    good = "2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824"
    manifest = spark.createDataFrame([("a.csv", good, "CC0"), ("b.csv", good, "CC0")], "path string, sha256 string, license string")
    assert [tuple(r) for r in files.check_manifest(spark, str(tmp_path / "m"), manifest, ["CC0"]).collect()] == [("b.csv", "missing")]
    assert [r.problem for r in files.check_manifest(spark, str(tmp_path / "m"), manifest.limit(1), ["MIT"]).collect()] == ["license"]
    assert files.markdown(rows.limit(1)).splitlines()[:2] == ["| lang | i |", "| --- | --- |"]
    with pytest.raises(ValueError):
        files.markdown(rows, limit=2)


def test_detectors(spark):
    docs = spark.createDataFrame([(1, "a@b c"), (2, ""), (3, None)], "doc_id int, text string")
    model = detectors.Batched("m", lambda: lambda texts: [[(0, 3, "EMAIL"), (4, 5, "unknown")] if t else [] for t in texts], scheme="openmed", batch=1)
    got = detectors.detect_all(docs, [detectors.DUMMY, model]).orderBy("detector", "doc_id").collect()
    assert [[tuple(s) for s in r.pred] for r in got] == [[], [], [], [(0, 3, "EMAIL")], [], []]
    assert detectors.redact(model.detect(docs)).orderBy("doc_id").first().redacted == "█ c"
    pieces = "array<struct<start:int,end:int,label:string,score:double>>"
    df = spark.createDataFrame([([(0, 4, "A"), (5, 6, "B")], [(0, 2, "A", 0.5), (2, 4, "A", 1.0), (0, 6, "C", 0.9)])], f"s {SPANS}, p {pieces}")
    assert [r.score for r in df.select(detectors.span_scores(F.col("s"), F.col("p")).alias("x")).first().x] == [0.75, 0.0]


def test_command_line(tmp_path, capsys):
    assert main(["list"]) == 0 and "met1_entity_scores" in capsys.readouterr().out
    assert main(["taxonomy"]) == 0 and capsys.readouterr().out.count("\n") == 18
    (tmp_path / "card.yaml").write_text("adapter: a\n")
    assert main(["validate-card", str(tmp_path / "card.yaml"), "--adapters", "a"]) == 1
    row = {"config": "en", "f1": 0.4149, "n": 1500, "taxonomy_version": "0.2.0"}
    (tmp_path / "board.json").write_text(json.dumps({"entries": {"a::m": [row]}}))
    assert main(["reproduce", str(tmp_path / "board.json"), "a::m"]) == 0 and main(["reproduce", str(tmp_path / "board.json"), "b::m"]) == 1


def test_desaturation_skips(spark):
    both = lambda rows: spark.createDataFrame(rows, "name string, f1 double, ci_high double")
    got = drift.desaturation_skips(both([("m", 0.9, 1.0), ("o", 0.9, 1.0), ("p", None, None)]), both([("m", 0.8, 0.85), ("n", 0.9, 1.0), ("p", None, None)])).collect()
    assert sorted((r.name, r.skipped) for r in got) == [("n", "no templated result"), ("o", "no diverse result"), ("p", "no templated result, no diverse result")]
