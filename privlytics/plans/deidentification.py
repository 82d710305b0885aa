"""Queries of tags, masked texts, residual quasi-identifiers, comparisons and the reference population."""

from __future__ import annotations

from pyspark.sql import functions as F

from privlytics.functions import quasi, tags, tokens
from privlytics.operators import anonymization, comparison, metrics, population, subjects
from privlytics.plans.registry import IDS, LEAK, query, wilson_sql
from privlytics.sources.fixtures import detected, id_docs, read_table

_AGAIN = "CASE WHEN k % 4 = 0 THEN {} ELSE '' END"
_MASKED = "SELECT detector, k AS doc_id, concat('CNP ', max(CASE WHEN detected THEN '█' ELSE value END) FILTER (nth = 1), ' name ', max(CASE WHEN detected THEN '█' ELSE value END) FILTER (nth = 2), coalesce(' again ' || max(CASE WHEN detected THEN '█' ELSE value END) FILTER (nth = 3), '')) AS redacted FROM det GROUP BY detector, k"
_NUTS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in quasi.COUNTY_NUTS2.items()) + "}"
_BAND = "CAST(substr(birth_date, 1, 4) AS INT) // 5 * 5"
_RESIDUAL = f"res AS (SELECT detector, doc_id, value, concat({_BAND}, '-', {_BAND} + 4) AS dob_band, sex, {_NUTS}[place_code] AS nuts2 FROM sub WHERE NOT detected)"


def _rows(spark, sf_dir):
    return detected(id_docs(spark, sf_dir))


@query("tag1_gold_tags", f"WITH {IDS} SELECT k AS doc_id, concat('O,S-NATIONAL_ID,O,S-PERSON', {_AGAIN.format(chr(39) + ',O,S-NATIONAL_ID' + chr(39))}) AS tags FROM f2")
def tag1(spark, sf_dir):
    rows = id_docs(spark, sf_dir).withColumn("t", tokens.whitespace_tokens(F.col("text")))
    return rows.select("doc_id", F.array_join(tags.gold_tags(F.col("t"), F.col("gold")), ",").alias("tags"))


@query("tag6_tag_spans", f"WITH {IDS} SELECT k AS doc_id, label, CAST(s AS INT) AS start, CAST(e AS INT) AS \"end\" FROM det WHERE detector = 'first' AND detected")
def tag6(spark, sf_dir):
    rows = _rows(spark, sf_dir).filter("detector = 'first'")
    spans = tags.tag_spans(F.col("tokens"), tags.entity_tags(F.col("tokens"), F.col("pred")))
    return rows.select("doc_id", F.explode(spans).alias("s")).select("doc_id", "s.label", "s.start", "s.end")


@query("ano1_mask_spans", f"WITH {IDS} {_MASKED}")
def ano1(spark, sf_dir):
    return anonymization.anonymize(_rows(spark, sf_dir))


@query("ano3_pseudonyms", f"WITH {IDS}, m AS (SELECT label, value AS entity, min(k * 10 + nth) AS seen FROM det WHERE detector = 'first' AND detected GROUP BY label, value) SELECT label, entity, concat(label, '_', row_number() OVER (PARTITION BY label ORDER BY seen)) AS surrogate FROM m")
def ano3(spark, sf_dir):
    rows = _rows(spark, sf_dir).filter("detector = 'first'").select("doc_id", F.explode("pred").alias("s"))
    return anonymization.pseudonyms(rows.select("doc_id", F.col("s.start").alias("pos"), "s.label", "s.value"))


@query("ano5_redaction_leakage", f"WITH {IDS} {LEAK.format(by='detector', src='sub')}")
def ano5(spark, sf_dir):
    docs = id_docs(spark, sf_dir)
    kept = anonymization.survivors(subjects.quasi_identifier_subjects(docs), anonymization.anonymize(detected(docs)))
    return metrics.leak_rates(kept, "detector")


@query("ano6_bijection", f"WITH {IDS}, x AS (SELECT DISTINCT k, value AS entity, substr(value, 1, 6) AS surrogate FROM det WHERE detector = 'full' AND label = 'NATIONAL_ID'), s AS (SELECT surrogate, count(DISTINCT entity) AS c FROM x GROUP BY surrogate) SELECT count(DISTINCT entity) FILTER (c = 1) * 1.0e0 / count(DISTINCT entity) AS rate FROM x JOIN s USING (surrogate)")
def ano6(spark, sf_dir):
    ids = id_docs(spark, sf_dir).select("doc_id", F.explode("gold").alias("g")).filter("g.label = 'NATIONAL_ID'")
    return anonymization.bijection_rate(ids.select(F.col("g.value").alias("entity"), F.substring("g.value", 1, 6).alias("surrogate")))


@query("ano8_information_retention", f"""WITH {IDS}, r AS ({_MASKED}), t AS (SELECT k, unnest(list_concat(['CNP', value, 'name', name], CASE WHEN k % 4 = 0 THEN ['again', value] ELSE [] END)) AS w, value, name FROM f2),
a AS (SELECT k, w, count(*) AS c FROM t WHERE w NOT IN (value, name) GROUP BY ALL), b AS (SELECT detector, doc_id AS k, unnest(string_split(redacted, ' ')) AS w FROM r), n AS (SELECT detector, k, w, count(*) AS c FROM b GROUP BY ALL)
SELECT detector, sum(least(a.c, n.c)) * 1.0e0 / (SELECT sum(c) FROM a) AS retention FROM a JOIN n USING (k, w) GROUP BY detector""")
def ano8(spark, sf_dir):
    docs = id_docs(spark, sf_dir)
    return anonymization.information_retention(docs, anonymization.anonymize(detected(docs)))


@query("ano9_structural_disruption", f"WITH {IDS}, n AS (SELECT detector, k, count(*) * 2 AS n, count(*) FILTER (detected) AS m FROM det GROUP BY detector, k) SELECT detector, sum(m) * 1.0e0 / sum(n) AS mask_ratio, 0.0e0 AS length_delta FROM n GROUP BY detector")
def ano9(spark, sf_dir):
    docs = id_docs(spark, sf_dir)
    return anonymization.structural_disruption(docs, anonymization.anonymize(detected(docs)))


@query("sub4_quasi_identifier_subjects", f"WITH {IDS} SELECT doc_id, country, value, sex, birth_date, place_code FROM sub WHERE detector = 'none'")
def sub4(spark, sf_dir):
    return subjects.quasi_identifier_subjects(id_docs(spark, sf_dir))


@query("sub6_residual_rows", f"WITH {IDS}, {_RESIDUAL} SELECT * FROM res")
def sub6(spark, sf_dir):
    return subjects.residual_rows(_rows(spark, sf_dir))


def _entities(spark, sf_dir):
    found = subjects.occurrences(_rows(spark, sf_dir))
    kind = F.when(F.col("label") == "PERSON", "direct").otherwise("Quasi")
    return subjects.entity_subjects(found.select("detector", "doc_id", F.col("value").alias("entity_id"), kind.alias("identifier_type"), "detected"))


_ENTITIES = "ent AS (SELECT detector, k AS doc_id, value AS entity_id, CASE label WHEN 'PERSON' THEN 'DIRECT' ELSE 'QUASI' END AS identifier_type, bool_and(detected) AS detected FROM det GROUP BY ALL)"


@query("sub5_entity_subjects", f"WITH {IDS}, {_ENTITIES} SELECT * FROM ent")
def sub5(spark, sf_dir):
    return _entities(spark, sf_dir)


@query("met9_entity_leakage", f"WITH {IDS}, {_ENTITIES}, b AS (SELECT detector, identifier_type AS scope, detected FROM ent UNION ALL SELECT detector, 'ALL', detected FROM ent) {LEAK.format(by='detector, scope', src='b')}")
def met9(spark, sf_dir):
    # a row counts for its type and for all: the subjects are read once
    both = _entities(spark, sf_dir).select("detector", "detected", F.explode(F.array(F.lit("ALL"), F.col("identifier_type"))).alias("scope"))
    return metrics.leak_rates(both, "detector", "scope")


@query("met7_cnp_leakage", f"WITH {IDS} SELECT detector, count(*) AS cnp_total, count(*) FILTER (NOT detected) AS cnp_missed, count(*) FILTER (NOT detected) * 1.0e0 / count(*) AS cnp_leak_rate FROM sub GROUP BY detector")
def met7(spark, sf_dir):
    found = metrics.leak_rates(subjects.national_id_subjects(_rows(spark, sf_dir).withColumn("country", F.lit("RO"))), "detector")
    return found.select("detector", F.col("total").alias("cnp_total"), F.col("missed").alias("cnp_missed"), F.col("leak_rate").alias("cnp_leak_rate"))


@query("met10_k_anonymity_violation", f"WITH {IDS}, {_RESIDUAL}, s AS (SELECT count(*) AS c FROM res WHERE detector = 'third' GROUP BY dob_band, sex, nuts2) SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS classes, coalesce(sum(c) FILTER (c = 1), 0) * 1.0e0 / sum(c) AS k1, coalesce(sum(c) FILTER (c < 5), 0) * 1.0e0 / sum(c) AS k_lt5 FROM s")
def met10(spark, sf_dir):
    return metrics.k_anonymity(subjects.residual_rows(_rows(spark, sf_dir)).filter("detector = 'third'"), ["dob_band", "sex", "nuts2"])


@query("div1_label_counts", f"WITH {IDS} SELECT label, count(*) AS n FROM occ GROUP BY label")
def div1(spark, sf_dir):
    return id_docs(spark, sf_dir).select(F.explode("gold.label").alias("label")).groupBy("label").agg(F.count("*").alias("n"))


def _points(spark, sf_dir):
    g = read_table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 40).cast("string").alias("name"))
    return g.agg(F.max("o_totalprice").alias("f1"), F.min("o_totalprice").alias("leak"))


_POINTS = "p AS (SELECT CAST(o_custkey % 40 AS VARCHAR) AS name, max(o_totalprice) AS f1, min(o_totalprice) AS leak FROM orders GROUP BY 1)"


@query("sig7_bad_frontier", f"WITH {_POINTS} SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.f1 > p.f1 AND q.leak <= p.leak)")
def sig7(spark, sf_dir):
    return comparison.bad_frontier(_points(spark, sf_dir))


@query("sig6_contrasts", f"WITH {_POINTS} (SELECT 'f1 leader' AS role, name FROM p WHERE leak > 0 ORDER BY f1 DESC, name LIMIT 1) UNION ALL (SELECT 'lowest leak', name FROM p ORDER BY leak, f1 DESC, name LIMIT 1) UNION ALL (SELECT 'lowest leak above 0', name FROM p WHERE leak > 0 ORDER BY leak, f1 DESC, name LIMIT 1)")
def sig6(spark, sf_dir):
    return comparison.contrasts(_points(spark, sf_dir))


@query("ldb6_board", f"WITH {_POINTS} SELECT name AS adapter, rank() OVER (ORDER BY leak) AS rank, leak FROM p")
def ldb6(spark, sf_dir):
    return comparison.board(_points(spark, sf_dir).select(F.col("name").alias("adapter"), "leak")).withColumn("rank", F.col("rank").cast("long"))


@query("div16_saturation", "SELECT o_orderpriority AS adapter, min(o_totalprice / 500000) AS least, max(o_totalprice / 500000) AS most, round(avg(o_totalprice / 500000), 9) AS mean, max(o_totalprice / 500000) >= 0.999 AS saturates FROM orders GROUP BY 1")
def div16(spark, sf_dir):
    return comparison.saturation(read_table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("adapter"), (F.col("o_totalprice") / 500000).alias("score")))


_AXES = ["c_mktsegment", "c_nationkey"]
_JOINT = "j AS (SELECT c_mktsegment, c_nationkey, count(*) * 1.0e0 / (SELECT count(*) FROM customer WHERE c_custkey % 3 = 0) AS p FROM customer WHERE c_custkey % 3 = 0 GROUP BY ALL)"


def _joint(spark, sf_dir):
    """The reference population: a part of the customers, so that some of those who are scored are not of it."""
    return _shares(read_table(spark, sf_dir, "customer").filter("c_custkey % 3 = 0"))


def _shares(some):
    total = some.agg(F.count("*").alias("total"))
    return some.groupBy(*_AXES).count().join(F.broadcast(total)).select(*_AXES, (F.col("count") / F.col("total").cast("double")).alias("p"))  # one row


_SCORED = f"{_JOINT}, x AS (SELECT c_custkey, CASE WHEN p IS NULL OR p <= 0 THEN 1.0e0 ELSE pow(1 - p, 1) END AS xi FROM customer LEFT JOIN j USING (c_mktsegment, c_nationkey))"


@query("pop5_population_uniqueness", f"WITH {_SCORED} SELECT * FROM x")
def pop5(spark, sf_dir):
    return population.score_rows(read_table(spark, sf_dir, "customer").select("c_custkey", *_AXES), _joint(spark, sf_dir), _AXES, 2).select("c_custkey", "xi")


@query("pop7_purr", f"WITH {_SCORED}, g AS (SELECT count(xi) AS n, count(*) FILTER (xi >= 0.95) AS s, coalesce(round(avg(1 - xi) FILTER (xi >= 0.95), 9), 0) AS kappa FROM x) SELECT n AS scorable, s AS flagged, s * 1.0e0 / n AS purr, round({wilson_sql('s', 'n', '-')}, 12) AS ci_low, round({wilson_sql('s', 'n', '+')}, 12) AS ci_high, kappa FROM g")
def pop7(spark, sf_dir):
    return population.purr(population.score_rows(read_table(spark, sf_dir, "customer").select("c_custkey", *_AXES), _joint(spark, sf_dir), _AXES, 2))


@query("pop4_joint_entropy", f"WITH {_JOINT.replace(' WHERE c_custkey % 3 = 0', '')} SELECT round(-sum(p * log2(p)), 9) AS bits FROM j")
def pop4(spark, sf_dir):
    return population.entropy_bits(_shares(read_table(spark, sf_dir, "customer"))).select(F.round("bits", 9).alias("bits"))


@query("pop10_in_sample_uniqueness", "WITH s AS (SELECT count(*) AS c FROM customer GROUP BY c_mktsegment, c_nationkey) SELECT CAST(sum(c) AS BIGINT) AS n, count(*) FILTER (c = 1) * 1.0e0 / sum(c) AS k1 FROM s")
def pop10(spark, sf_dir):
    return population.in_sample_uniqueness(read_table(spark, sf_dir, "customer"), _AXES)
