"""Tags, masks, quasi-identifiers, comparisons and the reference population on small cases."""

import pytest
from pyspark.sql import functions as F

from privlytics.functions import quasi, redaction, tags, tokens
from privlytics.operators import anonymization, comparison, population

SPANS = "array<struct<start:int,end:int,label:string>>"


def one(spark, schema, row, column):
    return spark.createDataFrame([row], schema).select(column.alias("x")).first().x


def test_tags(spark):
    text = "Ana Pop lives in Cluj now"
    t = tokens.whitespace_tokens(F.col("text"))
    got = lambda spans, f: one(spark, f"text string, spans {SPANS}", (text, spans), f(t, F.col("spans")))
    gold = [(0, 7, "PERSON"), (17, 21, "PLACE")]
    assert got(gold, tags.gold_tags) == ["B-PERSON", "E-PERSON", "O", "O", "S-PLACE", "O"]
    assert [tuple(s) for s in got(gold, lambda t, s: tags.tag_spans(t, tags.gold_tags(t, s)))] == gold
    assert got(gold, tags.gold_violation) is None
    assert got([(0, 7, "A"), (4, 9, "B")], tags.gold_violation) == "overlapping spans"
    assert got([(3, 4, "A")], tags.gold_violation) == "span without token"
    assert got([(0, 1, "A"), (1, 3, "B")], tags.gold_violation) == "token of two spans"
    assert got([(0, 3, "A"), (4, 7, "A"), (0, 7, "B")], tags.entity_tags) == ["B-A", "E-A", "O", "O", "O", "O"]
    assert got([], tags.entity_tags) == ["O"] * 6
    check = lambda x: one(spark, "x array<string>", (x,), tags.tags_violation(F.col("x")))
    assert [check(x) for x in (["O", "B-A", "I-A", "E-A", "S-B"], [], ["I-A"], ["B-A", "O"], ["B-A", "E-B"], ["O", "X-A"])] == [None, None, 0, 0, 0, 1]
    loose = one(spark, "text string, x array<string>", ("a b c d", ["B-A", "O", "I-A", "B-B"]), tags.tag_spans(t, F.col("x")))
    assert [tuple(s) for s in loose] == [(0, 1, "A"), (4, 5, "A"), (6, 7, "B")]
    assert one(spark, "x array<string>", (["B-A", "E-A", "S-B"],), tags.fair_tags(F.col("x"), F.array(F.lit("B")))) == ["O", "O", "S-B"]


@pytest.mark.parametrize(
    ("text", "spans", "want"),
    [("a b c d", [(2, 3), (6, 7)], "a █ c █"), ("abcdef", [(3, 5), (1, 3), (2, 4)], "a█f"), ("abc", [], "abc"), ("", [], ""), ("é🙂x", [(0, 2)], "█x"), ("abc", [(0, 3)], "█")],
)
def test_masks(spark, text, spans, want):
    assert one(spark, f"t string, s {SPANS}", (text, [(*s, "X") for s in spans]), redaction.mask_spans(F.col("t"), F.col("s"))) == want


def test_survival_and_mask_words(spark):
    for hay, value, want in (("id ends 5015", "1850715400015", False), ("id ends 0015", "1850715400015", True), ("x 18 50 y", "1850", True), ("x", "", False), ("no", "ab", False), ("cab", "ab", True)):
        assert one(spark, "h string, v string", (hay, value), redaction.value_survives(F.col("h"), F.col("v"))) is want
    for token, want in (("█", True), ("██", True), ("█.", False), ("[NAME]", False), ("[REDACTED]", True), ("-", False), ("--", True), ("xX", True), ("x", False), ("[]", False)):
        assert one(spark, "t string", (token,), redaction.is_mask(F.col("t"))) is want


def test_quasi(spark):
    for date, want in (("1987-03-01", "1985-1989"), ("2000-01-01", "2000-2004"), ("87-03-01", None), (None, None), ("", None)):
        assert one(spark, "d string", (date,), quasi.dob_band(F.col("d"))) == want
    assert [one(spark, "c string", (c,), quasi.county_nuts2(F.col("c"))) for c in ("40", "52", "99", None)] == ["RO32", "RO31", None, None]
    assert one(spark, "s string, r boolean", (None, False), quasi.qi_tuple(sex=F.col("s"), rare_condition=F.col("r"))) is None
    assert one(spark, "s string, r boolean", ("F", True), quasi.qi_tuple(sex=F.col("s"), rare_condition=F.col("r"))).rare_condition is True


def test_anonymization_metrics(spark):
    rate = lambda rows, *scope: anonymization.bijection_rate(spark.createDataFrame(rows, "doc_id int, entity string, surrogate string"), *scope).first().rate
    two = [(1, "a", "P_1"), (2, "a", "P_2")]
    assert rate(two, "doc_id") == 1 and rate(two) == 0 and rate([(1, "a", "P_1"), (1, "b", "P_1")]) == 0 and rate([]) == 1
    docs = spark.createDataFrame([(1, "a b c d", [(2, 3, "X"), (6, 7, "X")])], f"doc_id int, text string, gold {SPANS}")
    red = spark.createDataFrame([("x", 1, "a █ q █"), ("y", 1, "")], "detector string, doc_id int, redacted string")
    assert {r.detector: r.retention for r in anonymization.information_retention(docs, red).collect()} == {"x": 0.5, "y": 0.0}
    got = {r.detector: (r.mask_ratio, r.length_delta) for r in anonymization.structural_disruption(docs, red).collect()}
    assert got == {"x": (0.5, 0.0), "y": (0.0, 1.0)}
    mentions = spark.createDataFrame([(i, p, "L", f"v {(7 * i + p) % 50}") for i in range(100) for p in range(3)], "doc_id int, pos int, label string, value string")
    numbered = {r.entity: r.surrogate for r in anonymization.pseudonyms(mentions, buckets=7).collect()}
    want = {}
    for r in mentions.orderBy("doc_id", "pos").collect():
        want.setdefault(r.value.replace(" ", ""), f"L_{len(want) + 1}")
    assert numbered == want
    assert anonymization.pseudonyms(mentions.limit(0)).count() == 0


def test_comparison(spark):
    points = spark.createDataFrame([("a", 0.85, 0.30), ("b", 0.75, 0.35), ("c", 0.74, 0.0)], "name string, f1 double, leak double")
    assert sorted(r.name for r in comparison.bad_frontier(points).collect()) == ["a", "c"]
    assert [r.name for r in comparison.contrasts(points).collect()] == ["a", "c", "a"]
    gate = lambda f1, n, v: one(spark, "f double, n int, v string", (f1, n, v), comparison.reproduces(F.col("f"), F.col("n"), F.col("v")))
    assert [gate(0.4149, 1500, "0.2.0"), gate(0.4649, 1500, "0.2.0"), gate(0.4149, 100, "0.2.0"), gate(0.4149, 1500, "0.3.0"), gate(None, 1500, "0.2.0")] == [True, False, False, False, False]
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert {tuple(r) for r in comparison.overlay(old, spark.createDataFrame([("b", 3)], old.schema), "k").collect()} == {("a", 1), ("b", 3)}


def test_joint(spark):
    axes = {"x": ["a", "b"], "y": ["c", "d", "e"]}
    marginals = [(["x"], {("a",): 30, ("b",): 70}), (["y"], {("c",): 20, ("d",): 30, ("e",): 50})]
    cells, sweeps = population.fit_joint(axes, marginals)
    assert len(cells) == 6 and abs(sum(c[-1] for c in cells) - 1) < 1e-9 and sweeps <= 10
    assert abs(sum(p for x, _, p in cells if x == "a") - 0.3) < 1e-9 and abs(sum(p for _, y, p in cells if y == "e") - 0.5) < 1e-9
    pair = (["y", "x"], {(y, x): i + 1 for i, (y, x) in enumerate((y, x) for y in "cde" for x in "ab")})
    got = {(x, y): p for x, y, p in population.fit_joint(axes, [pair])[0]}
    assert abs(got["b", "c"] - 2 / 21) < 1e-9
    with pytest.raises(ValueError):
        population.fit_joint(axes, [(["x"], {("a",): 1}), (["x"], {("b",): 1})])
    with pytest.raises(ValueError):
        population.fit_joint(axes, [(["x"], {})])
    rows = spark.createDataFrame([("a", "c"), ("a", "z"), (None, "c")], "x string, y string")
    scored = population.score_rows(rows, spark.createDataFrame(cells, "x string, y string, p double"), ["x", "y"], 1000)
    xi = {(r.x, r.y): r.xi for r in scored.collect()}
    assert xi["a", "z"] == 1.0 and xi[None, "c"] is None and abs(xi["a", "c"] - 0.94**999) < 1e-12
    r = population.purr(scored).first()
    assert (r.scorable, r.flagged, r.purr, r.kappa) == (2, 1, 0.5, 0.0)
