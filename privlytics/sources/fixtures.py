"""Deterministic documents with gold spans and detectors, derived from key columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from privlytics.functions.bind import once
from privlytics.functions.national_id import BSN_WEIGHTS, CNP_WEIGHTS, PESEL_WEIGHTS, weighted
from privlytics.functions.tokens import whitespace_tokens

SPANS = "array<struct<start:int,end:int,label:string,value:string>>"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Documents of one task.
DOCS_A_TASK = 2500


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt by ``key`` over tasks of some ``DOCS_A_TASK`` rows: one task reads a small file, whatever is made of its rows.

    What is grouped by the key and more afterwards stays in its task.
    """
    return rows.repartition(rows.count() // DOCS_A_TASK + 1, key)


def _ro_check(body):
    return once(weighted(body, CNP_WEIGHTS) % 11, lambda rem: F.when(rem == 10, 1).otherwise(rem))


def id_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, country, text, name, gold): an id, wrong in every 7th document and repeated in every 4th, and a name."""
    k = F.col("c_custkey")
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    body = F.concat((k % 6 + 1).cast("string"), pad(k * 7 % 100, 2), pad(k % 12 + 1, 2), pad(k % 28 + 1, 2), pad(k % 46 + 1, 2), pad(k * 13 % 1000, 3))
    control = lambda check: F.when(k % 7 == 0, (check + 1) % 10).otherwise(check).cast("string")
    value = once(body, lambda b: F.concat(b, once(_ro_check(b), control)))
    keys = spread(read_table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey")
    rows = keys.select(k.alias("doc_id"), value.alias("value"), F.col("c_name").alias("name"))
    text = F.concat(F.lit("CNP "), F.col("value"), F.lit(" name "), F.col("name"), F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit(" again "), F.col("value"))).otherwise(""))
    n = F.length("name")
    span = lambda s, e, label, v: F.struct(s.cast("int").alias("start"), e.cast("int").alias("end"), F.lit(label).alias("label"), v.alias("value"))
    first = [span(F.lit(4), F.lit(17), "NATIONAL_ID", F.col("value")), span(F.lit(23), n + 23, "PERSON", F.col("name"))]
    again = span(n + 30, n + 43, "NATIONAL_ID", F.col("value"))
    gold = F.when(F.col("doc_id") % 4 == 0, F.array(*first, again)).otherwise(F.array(*first))
    return rows.select("doc_id", F.lit("RO").alias("country"), text.alias("text"), "name", gold.cast(SPANS).alias("gold"))


def _tokenized(docs: DataFrame) -> DataFrame:
    """With ``tokens``, which all detectors of a document share."""
    return docs.withColumn("tokens", whitespace_tokens(F.col("text")))


def detected(docs: DataFrame) -> DataFrame:
    """One row per document and detector with ``pred`` spans: all; none; all but every 3rd document; no repeated ids."""
    spans = F.col("gold")
    preds = {"full": spans, "none": F.slice(spans, 1, 0), "third": F.when(F.col("doc_id") % 3 == 0, F.slice(spans, 1, 0)).otherwise(spans), "first": F.slice(spans, 1, 2)}
    rows = F.array(*(F.struct(F.lit(k).alias("detector"), v.alias("pred")) for k, v in preds.items()))
    return _tokenized(docs).withColumn("d", F.explode(rows)).select("*", "d.detector", "d.pred").drop("d")


def mixed_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, country, text, gold) of three countries, one of which has ids that give nothing away.

    Names have two or three tokens, ids stand between signs, some are wrong; every 5th document has its id only once.
    """
    k = F.col("c_custkey")
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    country = F.when(k % 4 == 1, "PL").when(k % 4 == 2, "NL").otherwise("RO")
    wrong = lambda check, at: once(check, lambda c: F.when(k % 8 == at, (c + 1) % 10).otherwise(c).cast("string"))
    ro = F.concat((k % 6 + 1).cast("string"), pad(k * 7 % 100, 2), pad(k % 12 + 1, 2), pad(k % 28 + 1, 2), pad(k % 46 + 1, 2), pad(k * 13 % 1000, 3))
    pl = F.concat(pad(k * 3 % 100, 2), pad(k % 12 + 1, 2), pad(k % 28 + 1, 2), pad(k * 17 % 10000, 4))
    nl = pad(10_000_000 + k * 37, 8)
    value = F.when(country == "PL", once(pl, lambda v: F.concat(v, wrong((10 - weighted(v, PESEL_WEIGHTS) % 10) % 10, 5))))
    value = value.when(country == "NL", once(nl, lambda v: F.concat(v, (weighted(v, BSN_WEIGHTS[:8]) % 11 % 10).cast("string"))))
    value = value.otherwise(once(ro, lambda v: F.concat(v, wrong(_ro_check(v), 3))))
    name = F.concat(F.when(k % 3 == 0, "Ion Vasile ").otherwise("Ana "), F.col("c_name"))
    keys = spread(read_table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey")
    rows = keys.select(k.alias("doc_id"), country.alias("country"), name.alias("name"), value.alias("value"))
    twice = F.col("doc_id") % 5 != 0
    text = F.concat(F.lit("Patient "), "name", F.lit(", id "), "value", F.lit(" of "), "name", F.when(twice, F.concat(F.lit(" ("), "value", F.lit(")"))).otherwise(""), F.lit(" of note"))
    n, v = F.length("name"), F.length("value")
    span = lambda start, label, value: F.struct(start.cast("int").alias("start"), (start + F.length(value)).cast("int").alias("end"), F.lit(label).alias("label"), F.col(value).alias("value"))
    three = [span(F.lit(8), "PERSON", "name"), span(n + 13, "NATIONAL_ID", "value"), span(n + v + 17, "PERSON", "name")]
    gold = F.when(twice, F.array(*three, span(2 * n + v + 19, "NATIONAL_ID", "value"))).otherwise(F.array(*three))
    return rows.select("doc_id", "country", text.alias("text"), gold.cast(SPANS).alias("gold"))


def mixed_detectors(docs: DataFrame) -> DataFrame:
    """One row per document and detector with ``pred``: exact; the beginning of each span; shifted ones; the first two; wrong labels with stray and touching spans; none."""
    spans = F.col("gold")
    made = lambda s, start, end, label: F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), label.alias("label"), s["value"].alias("value"))
    stray = lambda a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit("ORG").alias("label"), F.lit("").alias("value"))
    preds = {
        "exact": spans,
        "part": F.transform(spans, lambda s: made(s, s["start"], s["start"] + F.when(s["label"] == "PERSON", 3).otherwise(4), s["label"])),
        "late": F.transform(spans, lambda s: made(s, s["start"] + 1, s["end"] + 2, s["label"])),
        "first": F.slice(spans, 1, 2),
        "wrong": F.concat(F.array(stray(0, 7), stray(7, 9)).cast(SPANS), F.transform(F.filter(spans, lambda s: s["label"] == "NATIONAL_ID"), lambda s: made(s, s["start"], s["end"], F.lit("PERSON")))),
        "none": F.slice(spans, 1, 0),
    }
    rows = F.array(*(F.struct(F.lit(k).alias("detector"), v.cast(SPANS).alias("pred")) for k, v in preds.items()))
    return _tokenized(docs).withColumn("d", F.explode(rows)).select("*", "d.detector", "d.pred").drop("d")
