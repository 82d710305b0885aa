"""White space, sources and gold rows; and that the SQL of the reports sees faults in what it checks."""

import duckdb
import pytest
from pyspark.sql import functions as F

from privlytics.functions import national_id, tags
from privlytics.operators import anonymization, metrics, subjects
from privlytics.plans import reports  # noqa: F401  it is patched below
from privlytics.plans.registry import ORACLE_SQL, QUERIES
from privlytics.sources import files

SF = "/root/testdata/sf0.001"


def test_white_space_around_ids(spark):
    gold = "array<struct<start:int,end:int,label:string,value:string>>"
    text = "1850715400015 and\u00a01850715400015\n end"
    spans = [(0, 13, "NATIONAL_ID", text[0:13]), (17, 32, "NATIONAL_ID", text[17:32])]
    rows = spark.createDataFrame([("d", 1, "RO", text, spans, spans[:1])], f"detector string, doc_id long, country string, text string, gold {gold}, pred {gold}")
    out = subjects.with_disclosed(subjects.national_id_subjects(rows)).collect()
    assert [(r.value, r.detected, r.qi) for r in out] == [("1850715400015", False, 3)]
    values = ["\t8506152449 ", "\u20288506152449", "x8506152449"]
    got = spark.createDataFrame([(v,) for v in values], "v string").select(national_id.parse(F.lit("SE"), F.col("v")).valid.alias("ok")).collect()
    assert [r.ok for r in got] == [True, True, False]
    assert national_id.supported_countries() == sorted("RO PL ES DE NL EE LT SI IT FR SE CZ SK DK FI".split())


def test_reports_of_nothing(spark):
    none = spark.createDataFrame([], "detector string, country string, decode_bearing boolean, detected boolean, qi long")
    assert [r.leak_rate for r in metrics.leak_report(none).collect()] == [0.0] and metrics.leak_report(none, "detector").count() == 0
    only = spark.createDataFrame([("d", "NL", False, True, 0)], none.schema)
    r = metrics.leak_report(only, "detector").first()
    assert (r.leak_rate, r.coverage_only_total, r.coverage_only_detection_rate, r.leaked_quasi_identifiers) == (0.0, 1, 1.0, 0)


def test_tail_and_sample(spark):
    df = spark.range(10).toDF("doc_id")
    assert sorted(r.doc_id for r in files.tail(df, 3, "doc_id").collect()) == [7, 8, 9]
    with pytest.raises(ValueError, match="11 rows"):
        files.tail(df, 11, "doc_id")
    for n in (0, -1, 10, 12):
        assert [r.doc_id for r in files.seeded_sample(df, n, 3, "doc_id").collect()] == list(range(10))
    some = [r.doc_id for r in files.seeded_sample(df, 4, 3, "doc_id").collect()]
    assert some == sorted(some) and len(some) == 4 and some == [r.doc_id for r in files.seeded_sample(df.repartition(4), 4, 3, "doc_id").collect()]


def test_gold_rows(spark):
    schema = "id int, text string, spans array<struct<start:int,end:int,label:string>>"
    good = [(1, "Ana Pop, Cluj", [(0, 7, "PERSON"), (9, 13, "CITY")]), (2, "", []), (3, "nothing here", [])]
    rows = files.gold_tags_checked(spark.createDataFrame(good, schema), "id").orderBy("id").collect()
    assert [r.tags for r in rows] == [["B-PERSON", "E-PERSON", "S-CITY"], [], ["O", "O"]]
    for spans in ([(0, 5, "A"), (3, 7, "B")], [(3, 4, "A")], [(0, 2, "A"), (2, 3, "B")], None):
        with pytest.raises(ValueError, match="bad gold row"):
            files.gold_tags_checked(spark.createDataFrame([*good, (4, "Ana Pop", spans)], schema))


def _any_detection(rows):
    return real_occurrences(rows).withColumn("detected", F.lit(True))


real_occurrences = subjects.occurrences
FAULTS = [
    ("sub1_subjects_of_countries", subjects, "occurrences", _any_detection),
    ("met6_leak_report", subjects, "DECODE_BEARING", ("RO", "PL", "NL")),
    ("met6_leak_report", subjects, "disclosed", lambda parsed, country: F.lit(3)),
    ("ano1_masks_of_countries", anonymization, "mask_spans", lambda text, spans: F.aggregate(spans, text, lambda t, s: F.overlay(t, F.lit("█"), s["start"] + 1, s["end"] - s["start"]))),
    ("ano5_redaction_report", anonymization, "value_survives", lambda redacted, value: F.contains(redacted, value)),
    ("tag5_entity_tags_of_countries", tags, "label_tags", lambda labels: F.transform(labels, lambda x: F.coalesce(F.concat(F.lit("S-"), x), F.lit("O")))),
    ("ano8_retention_of_countries", anonymization, "words", lambda text: F.array_distinct(F.split(text, " "))),
]


@pytest.mark.parametrize("name, module, what, broken", FAULTS, ids=[f"{f[0]}-{f[2]}" for f in FAULTS])
def test_sql_sees_faults(spark, monkeypatch, name, module, what, broken):
    con = duckdb.connect()
    con.sql(f"create view customer as select * from '{SF}/customer.parquet'")
    monkeypatch.setattr(module, what, broken)
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = lambda found, names: sorted((tuple(float(f"{r[names.index(c)]:.9g}") if isinstance(r[names.index(c)], float) else r[names.index(c)] for c in columns) for r in found), key=str)
    wanted = con.sql(ORACLE_SQL[name])
    assert rows(df.collect(), df.columns) != rows(wanted.fetchall(), wanted.columns)
