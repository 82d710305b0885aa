"""Published anchor values of validators and statistics, and token edge cases."""

import pytest
from pyspark.sql import functions as F

from privlytics.functions import national_id, stats, tokens
from privlytics.operators import corpus, metrics


IDS = [
    ("RO", "1850715400015", (True, "M", "1985-07-15", "40")),
    ("RO", "2680219165213", (True, "F", "1968-02-19", "16")),
    ("RO", "1850715400016", (False, None, None, None)),
    ("PL", "44051401359", (True, "M", "1944-05-14", None)),
    ("PL", "02211500029", (True, "F", "2002-01-15", None)),
    ("PL", "44051401358", (False, None, None, None)),
    ("ES", "12345678Z", (True, None, None, None)),
    ("DE", "86095742719", (True, None, None, None)),
    ("EE", "37605030299", (True, "M", "1976-05-03", None)),
    ("SI", "0101006500006", (True, "M", "2006-01-01", "50")),
    ("IT", "RSSMRA85T10A562S", (True, "M", "85-12-10", "A562")),
    ("IT", "rssmra85t50a562w", (True, "F", "85-12-10", "A562")),
    ("IT", "RSSMRA85T10A562T", (False, None, None, None)),
    ("IT", "🙂SSMRA85T10A562S", (False, None, None, None)),
    ("FR", "18520750010010", (False, None, None, None)),
    ("SE", "850615-2449", (True, "F", "85-06-15", None)),
    ("SE", "19850615-2449", (True, "F", "1985-06-15", None)),
    ("SE", "8506152448", (False, None, None, None)),
    ("CZ", "855615/1010", (True, "F", "1985-06-15", None)),
    ("SK", "8556151010", (True, "F", "1985-06-15", None)),
    ("CZ", "8556151011", (False, None, None, None)),
    ("DK", "211062-0629", (True, "M", "1962-10-21", None)),
    ("DK", "21106206X9", (False, None, None, None)),
    ("FI", "131052-308T", (True, "F", "1952-10-13", None)),
    ("FI", "131052-308U", (False, None, None, None)),
    ("ES", "🙂🙂🙂🙂🙂🙂🙂🙂Z", (False, None, None, None)),
    ("XX", "1", (False, None, None, None)),
    ("RO", None, (False, None, None, None)),
    ("NL", "", (False, None, None, None)),
    ("DE", "not digits!", (False, None, None, None)),
]


def test_ids(spark):
    rows = spark.createDataFrame([(i, c, v) for i, (c, v, _) in enumerate(IDS)], "i int, c string, v string")
    got = rows.select("i", national_id.parse(F.col("c"), F.col("v")).alias("r")).orderBy("i").collect()
    assert [tuple(x.r) for x in got] == [want for _, _, want in IDS]


@pytest.mark.parametrize(("body", "sex", "date", "dept"), [("1850675001001", "M", "85-06", "75"), ("1852075001001", "M", None, "75"), ("285122A001001", "F", "85-12", "2A"), ("785122B001001", None, "85-12", "2B")])
def test_french_ids(spark, body, sex, date, dept):
    key = 97 - int(body.replace("2A", "19").replace("2B", "18")) % 97
    rows = spark.createDataFrame([(f"{body}{key:02d}",), (f"{body}{key % 97 + 1:02d}",)], "v string").select(national_id.parse(F.lit("FR"), F.col("v")).alias("r")).collect()
    assert tuple(rows[0].r) == (True, sex, date, dept) and not rows[1].r.valid


def test_intervals(spark):
    df = spark.createDataFrame([(16, 1123), (61, 1500), (0, 190), (0, 0)], "s int, n int")
    low, high = stats.wilson(F.col("s"), F.col("n"))
    rows = df.select(low.alias("l"), high.alias("h")).collect()
    assert [round(rows[0].l, 6), round(rows[0].h, 6)] == [0.008789, 0.023018]
    assert [round(rows[1].h, 6), round(rows[2].h, 6), rows[3].h] == [0.051891, 0.019817, 0.0]
    gap, lo, hi = stats.newcombe(*(F.lit(x) for x in (30, 200, 0, 200)))
    back = stats.newcombe(*(F.lit(x) for x in (0, 200, 30, 200)))
    r = spark.range(1).select(gap.alias("g"), lo.alias("l"), hi.alias("h"), back[1].alias("bl"), back[2].alias("bh")).first()
    assert abs(r.g - 0.15) < 1e-12 and r.l > 0 and abs(r.l + r.bh) < 1e-12 and abs(r.h + r.bl) < 1e-12


def test_binomial(spark):
    df = spark.createDataFrame([(10, 0), (10, 10), (0, 0), (339, 0)], "b int, c int")
    p = [r.p for r in df.select(stats.binomial_two_sided(F.col("b"), F.col("c")).alias("p")).collect()]
    assert abs(p[0] - 2 * 0.5**10) < 1e-12 and p[1] == 1 and p[2] == 1 and abs(p[3] / 1.79e-102 - 1) < 0.01


def test_tokens(spark):
    texts = ["", None, " a  b\n", "x y z w", "🙂 é"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(tokens.whitespace_tokens(F.col("t")).alias("x"), tokens.token_count(F.col("t")).alias("n")).collect()
    for t, r in zip(texts, rows, strict=True):
        if t is not None:
            assert [x.tok for x in r.x] == t.split() and r.n == len(t.split())
            assert all(t[x.s : x.e] == x.tok for x in r.x)
    tags = spark.range(1).select(tokens.bioes(F.array(*map(F.lit, (0, 0, 0, -1, 1, 2, 2))), F.array(*map(F.lit, ("A", "A", "A", None, "B", "A", "A")))).alias("x")).first().x
    assert tags == ["B-A", "I-A", "E-A", "O", "S-B", "B-A", "E-A"]


def test_k_anonymity_and_distances(spark):
    rows = spark.createDataFrame([("a",), ("a",), ("b",)], "q string")
    assert round(metrics.k_anonymity(rows, ["q"]).first().k1, 9) == round(1 / 3, 9)
    same = spark.createDataFrame([("a", "x", 3), ("b", "x", 5)], "side string, category string, n int")
    r = corpus.distances(same).first()
    assert (r.tv, r.js) == (0, 0)
    r = corpus.distances(spark.createDataFrame([("a", "x", 3), ("b", "y", 5)], "side string, category string, n int")).first()
    assert (r.tv, r.js) == (1, 1)
    points = spark.createDataFrame([("a", 0), ("a", 2), ("b", 1), ("b", 3)], "side string, x int")
    assert corpus.wasserstein(points).first().w1 == 1
