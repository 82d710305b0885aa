"""Reports, detectors by name, census specs and the command line, on cases that the tables lack."""

import json

import pytest
from pyspark.sql import functions as F

from privlytics.__main__ import main
from privlytics.functions.national_id import birth_place
from privlytics.operators import anonymization, comparison, corpus, detectors, drift, metrics, population


def test_violation_report(spark):
    rows = spark.createDataFrame([("x",), ("y",)], "detector string")
    left = spark.createDataFrame([("x", "1960-1964", "F", None), ("x", "1960-1964", "F", None), ("x", None, None, None)], "detector string, dob_band string, sex string, nuts2 string")
    got = {r.detector: r for r in metrics.k_anonymity_violation(rows, left).collect()}
    assert (got["x"].available, got["x"].n, got["x"].n_classes, [tuple(s) for s in got["x"].sizes]) == (True, 3, 2, [(1, 1), (2, 1)])
    assert got["x"].k1 == pytest.approx(1 / 3) and got["x"].k_lt5 == 1 and got["x"].reason is None
    assert (got["y"].available, got["y"].reason, got["y"].n) == (False, metrics.NO_TUPLES, None)
    # tuples of which none is set do not count as given
    assert metrics.k_anonymity_violation(rows.withColumn("qi_tuple", F.lit(None).cast("struct<a:int>")), left).filter("available").count() == 1


def test_surrogates(spark):
    docs = spark.createDataFrame([(1, "Ana B and Ana  B"), (2, "nobody"), (3, "Ana B")], "doc_id long, text string")
    span = lambda s, e, label: F.struct(F.lit(s).alias("start"), F.lit(e).alias("end"), F.lit(label).alias("label"))
    found = detectors.Expression("names", lambda text: F.when(text.startswith("Ana B and"), F.array(span(0, 5, "PERSON"), span(10, 16, "PERSON"))).when(text.startswith("Ana"), F.array(span(0, 5, "ORG"))).otherwise(F.array()))
    got = {r.doc_id: r.surrogates for r in found.pseudonymize(docs).collect()}
    assert got == {1: {"Ana B": "PERSON_1", "Ana  B": "PERSON_1"}, 2: {}, 3: {"Ana B": "ORG_1"}}
    assert [r.tags for r in found.predict_tags(docs).orderBy("doc_id").collect()][2] == ["B-ORG", "E-ORG"]
    again = spark.createDataFrame([(1, 0, "A", "v"), (1, 9, "B", "v")], "doc_id long, pos int, label string, value string")
    assert anonymization.surrogate_maps(again).first().surrogates == {"v": "B_1"}
    for method in (found.classify, found.leakage_probe):
        with pytest.raises(NotImplementedError):
            method(docs)


def test_detectors_by_name():
    assert detectors.build("dummy") is detectors.DUMMY
    with pytest.raises(KeyError, match="dummy"):
        detectors.build("nothing")


def test_places(spark):
    got = spark.createDataFrame([(" h501\n",), ("Z000",), ("A000",), (None,)], "c string").select(birth_place(F.col("c")).alias("p")).collect()
    assert [tuple(r.p) if r.p else None for r in got] == [("H501", "comune", "Roma"), ("Z000", "foreign_country", None), ("A000", "unknown", None), None]


def test_census_spec(spark, tmp_path):
    text = "meta: {axes: [sex, age], population_total: 10, %s}\naxes: {sex: [M, F], age: [a, b]}\nmarginals:\n- {axes: [sex], counts: {M: 4, F: 6}}\n- {axes: [sex, age], counts: {M|a: 1, M|b: 3, F|a: %d, F|b: 2}}\n"
    (tmp_path / "s.yaml").write_text(text % ("is_real_census: true, label: x", 4))
    joint = population.read_spec(str(tmp_path / "s.yaml"))
    assert (joint.axes, joint.n, joint.placeholder, joint.label) == (("sex", "age"), 10, False, "x")
    assert {(r.sex, r.age): round(r.p, 9) for r in joint.table(spark).collect()} == {("M", "a"): 0.1, ("M", "b"): 0.3, ("F", "a"): 0.4, ("F", "b"): 0.2}
    (tmp_path / "s.yaml").write_text(text % ("placeholder: false", 4))
    unmarked = population.read_spec(str(tmp_path / "s.yaml"))
    assert unmarked.placeholder and unmarked.label
    (tmp_path / "s.yaml").write_text(text % ("is_real_census: true", 40))
    with pytest.raises(ValueError):
        population.read_spec(str(tmp_path / "s.yaml"))


def test_corpora(spark):
    scores = spark.createDataFrame([("dummy", "en", 1.0), ("m", "en", 0.5), ("n", "en", 0.75)], "adapter string, language string, score double")
    assert tuple(comparison.language_spread(scores).first()) == ("en", 0.5, 0.75, 0.25)
    assert tuple(comparison.saturation_headline(scores).first()) == (0.75, False, "not saturating")
    assert tuple(comparison.saturation_headline(scores.filter("adapter = 'dummy'")).first()) == (None, False, "still saturating")
    row = drift.headline(spark.createDataFrame([(0.1,), (0.3,)], "gap double")).first()
    assert drift.headline_text(row) == "the detection rate of national ids overstates by 20.0 pp on average across 2 models (range +10.0 to +30.0 pp)"
    hashes = spark.createDataFrame([(f"{i * 2654435761 % 2**32:08x}",) for i in range(500)], "h string")
    one = corpus.content_hash(hashes, 1).first().corpus_hash
    assert one == corpus.content_hash(hashes.orderBy(F.desc("h")).repartition(7), 1).first().corpus_hash != corpus.content_hash(hashes.limit(499), 1).first().corpus_hash


def test_evaluate_and_leaderboard(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr("privlytics.__main__._spark", lambda: spark)
    cnp = "1960523410057"
    (tmp_path / "d.jsonl").write_text(json.dumps({"doc_id": 1, "text": f"CNP {cnp}", "spans": [{"start": 4, "end": 17, "label": "NATIONAL_ID"}]}) + "\n")
    suite = tmp_path / "suite"
    suite.mkdir()
    for name, path in (("one", "d.jsonl"), ("two", "none.jsonl")):
        (suite / f"{name}.yaml").write_text(f"name: {name}\ntask: detection\ndataset: {{path: {tmp_path / path}}}\n")
    monkeypatch.setitem(detectors._BUILDERS, "digits", lambda: detectors.Expression("digits", lambda text: F.array(F.struct(F.lit(4).alias("start"), F.lit(17).alias("end"), F.lit("NATIONAL_ID").alias("label")))))
    out = tmp_path / "b" / "board.json"
    assert main(["evaluate", str(suite), "--adapter", "digits", "--adapter", "dummy", "--out", str(out)]) == 0
    assert "skipped two" in capsys.readouterr().out
    assert sorted(json.loads(out.read_text())["entries"]) == ["digits::digits", "dummy::dummy"]
    assert main(["leaderboard", str(out)]) == 0
    lines = capsys.readouterr().out.splitlines()
    assert lines[0].split() == ["spec", "digits", "dummy"] and lines[1].split() == ["one", "1.000/1.000", "0.000/0.000"]
    with pytest.raises(SystemExit):
        main(["evaluate", str(suite), "--adapter", "nothing"])
