"""Work on documents is dealt out by their number and not done twice, with the same results."""

import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from privlytics.functions import redaction, tags, tokens
from privlytics.operators import anonymization, bootstrap, metrics
from privlytics.plans.registry import ORACLE_SQL, QUERIES
from privlytics.sources import fixtures

SF = "/root/testdata/sf0.001"
DEALT = [
    "met6_country_counts",
    "met7_cnp_report",
    "sig12_track_drivers",
    "sub1_subjects_of_countries",
    "tag5_entity_tags_of_countries",
    "met1_scores_of_countries",
    "met6_leak_report",
    "ano8_retention_of_countries",
    "ano8_information_retention",
    "ano10_detection_recall",
    "met1_entity_scores",
    "sig12_track_scores",
    "sig11_summary",
    "sig1_detector_gaps",
    "sig2_dissociation",
    "met6_national_id_leakage",
    "met7_cnp_leakage",
    "met9_entity_leakage",
    "sig3_mcnemar",
    "sig9_family_leaks",
    "sub1_national_id_subjects",
    "sub5_entity_subjects",
    "met8_name_context",
    "boo4_paired_points",
    "tag1_tags_of_countries",
]


@pytest.fixture(scope="module")
def forty(tmp_path_factory):
    """The customers forty times over, with keys of their own: 6000, in one file."""
    where = tmp_path_factory.mktemp("forty")
    duckdb.sql(f"copy (select c_custkey + i * 150 as c_custkey, * exclude (c_custkey) from '{SF}/customer.parquet', range(40) t(i)) to '{where}/customer.parquet' (format parquet)")
    return str(where)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def before_the_deal(plan):
    """For each scan of the customers, what is done with its rows before they are dealt out, and to how many tasks."""
    depth = lambda line: re.search("[A-Za-z]", line).start()
    found = []
    for at, line in enumerate(plan):
        if "FileScan" not in line:
            continue
        here, done = depth(line), []
        for above in reversed(plan[:at]):
            if depth(above) < here:
                here = depth(above)
                if "Exchange" in above:
                    found.append((done, int(re.search(r"partitioning\(.*, (\d+)\)", above)[1])))
                    break
                done.append(above[here:])
        else:
            found.append((done, 0))
    return found


@pytest.mark.parametrize("name", DEALT)
def test_dealt_out_before_anything_is_made_of_documents(spark, forty, name):
    found = before_the_deal(plan_of(QUERIES[name](spark, forty)))
    assert found
    for done, n in found:
        assert n == 3
        assert not any(re.search("Generate|Aggregate|transform|concat", line) for line in done)


@pytest.mark.parametrize("name", DEALT)
def test_same_results_over_many_tasks(spark, monkeypatch, name):
    monkeypatch.setattr(fixtures, "DOCS_A_TASK", 10)
    con = duckdb.connect()
    con.sql(f"create view customer as select * from '{SF}/customer.parquet'")
    df = QUERIES[name](spark, SF)
    columns, wanted = sorted(df.columns), con.sql(ORACLE_SQL[name])
    same = lambda x: float(f"{x:.9g}") if isinstance(x, float) else x
    rows = lambda found, names: sorted((tuple(same(r[names.index(c)]) for c in columns) for r in found), key=str)
    assert rows(df.collect(), df.columns) == rows(wanted.fetchall(), wanted.columns)


def test_texts_are_split_once_for_all_detectors_and_spans(spark):
    plan = plan_of(QUERIES["met6_country_counts"](spark, SF))
    detectors = next(i for i, line in enumerate(plan) if "struct(detector" in line)
    assert [i > detectors for i, line in enumerate(plan) if "regexp_extract_all" in line] == [True]


def test_white_space_by_sign_and_by_pattern(spark):
    draw = random.Random(1)
    texts = ["".join(draw.choice(tokens.SIGNS + "ab█é😀​$") for _ in range(draw.randrange(20))) for _ in range(500)] + [f"x{chr(c)}y{chr(c)}" for c in range(1, 0x3100)] + [None, ""]
    runs = F.regexp_extract_all("t", F.lit(f"[^{tokens.SPACE}]+"), F.lit(0))
    ends = F.regexp_replace("t", f"^[{tokens.SPACE}]+|[{tokens.SPACE}]+$", "")
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", runs.alias("runs"), ends.alias("ends"), tokens.whitespace_tokens(F.col("t")).alias("x"), redaction.words(F.col("t")).alias("w"), tokens.strip(F.col("t")).alias("s"), tokens.token_count(F.col("t")).alias("n"), tokens.blanks(F.col("t")).alias("b"))
    for r in df.collect():
        assert r.s == r.ends and r.w == r.runs and (r.t is None or (r.n == len(r.runs) and len(r.b) == len(r.t)))
        assert r.t is None or [(x.tok, r.t[x.s : x.e]) for x in r.x] == [(w, w) for w in r.runs]


def test_tags_hold_what_they_look_at_once(spark):
    df = spark.createDataFrame([("a b c d", [(0, 3, "X"), (6, 7, "Y")])], "text string, e array<struct<start:int,end:int,label:string>>").withColumn("t", tokens.whitespace_tokens(F.col("text")))
    for made, what in ((tags.entity_tags, "array_distinct("), (tags.gold_tags, "array_position(")):
        tagged = df.select(made(F.col("t"), F.col("e")).alias("tags"))
        assert tagged._jdf.queryExecution().analyzed().toString().count(what) == 1
        assert tagged.first().tags == ["B-X", "E-X", "O", "S-Y"]


def test_retention_by_document(spark):
    """Rows of one document under one id count together; no join deals words out again."""
    docs = [(1, "a b b Ana", [(6, 9)]), (1, "b c", []), (2, "x y", []), (3, "", None), (None, "a", [])]
    out = [("d", 1, "b b b"), ("d", 1, "a"), ("d", 2, "y y"), ("e", 2, "z"), ("d", None, "a"), ("d", 4, "a")]
    left = spark.createDataFrame(docs, "doc_id long, text string, gold array<struct<start:int,end:int>>")
    got = anonymization.information_retention(left, spark.createDataFrame(out, "detector string, doc_id long, redacted string"))
    gold = {1: Counter("abbbc"), 2: Counter("xy")}
    kept = {d: sum(sum((gold[k] & sum((Counter(t.split()) for e, i, t in out if (e, i) == (d, k)), Counter())).values()) for k in gold) for d in "de"}
    total = sum(sum(c.values()) for c in gold.values()) + 1  # and the text without an id
    assert {r.detector: r.retention for r in got.collect()} == {d: n / total for d, n in kept.items()}
    joined = [line for line in plan_of(got) if "SortMergeJoin" in line]
    assert joined and not any("tok" in line for line in joined)


def test_names_and_ids_are_counted_without_a_join(spark):
    schema = "detector string, doc_id long, detected boolean"
    names = [("d", 1, False), ("d", 1, True), ("d", 2, True), ("d", 3, True), ("d", 4, None), ("d", None, False), (None, 1, False), ("e", 1, True)]
    ids = [("d", 1, False), ("d", 2, True), ("d", 2, False), ("d", 4, True), ("d", 5, False), ("d", None, False), (None, 1, False), ("e", 1, True)]
    got = metrics.name_context(spark.createDataFrame(names, schema), spark.createDataFrame(ids, schema))
    assert sorted(tuple(r) for r in got.collect()) == [("d", 1, 0, 1, 0), ("e", 0, 0, 0, 1)]
    assert not any("Join" in line for line in plan_of(got))


def test_subjects_are_never_sent_to_all(spark):
    """However small Spark takes them for, by the size of the file that they are made of."""
    some = spark.createDataFrame([("x", 1, True), ("x", 2, False)], "name string, doc_id long, detected boolean")
    plan = plan_of(bootstrap.paired_gaps(some, some, ["doc_id"]))
    assert any("SortMergeJoin" in line for line in plan) and not any("Broadcast" in line for line in plan)
