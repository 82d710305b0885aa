"""Whole leak reports, tags and masks on documents of several countries; their SQL joins spans with tokens and signs."""

from __future__ import annotations

from pyspark.sql import functions as F

from privlytics.functions import national_id, tags, tokens
from privlytics.operators import anonymization, metrics, subjects
from privlytics.plans.registry import _BODY, _w, query, wilson_sql
from privlytics.sources.fixtures import mixed_detectors, mixed_docs

_PAD = "lpad(CAST({} AS VARCHAR), {}, '0')".format
# documents, gold spans (g), predicted spans (p, in list order), tokens (tk), and whether a gold span is detected (det)
MIXED = f"""
m0 AS (SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 1 THEN 'PL' WHEN 2 THEN 'NL' ELSE 'RO' END AS country, concat(CASE WHEN c_custkey % 3 = 0 THEN 'Ion Vasile ' ELSE 'Ana ' END, c_name) AS name,
  {_BODY.replace('k ', 'c_custkey ')} AS ro, concat({_PAD('c_custkey * 3 % 100', 2)}, {_PAD('c_custkey % 12 + 1', 2)}, {_PAD('c_custkey % 28 + 1', 2)}, {_PAD('c_custkey * 17 % 10000', 4)}) AS pl, {_PAD('10000000 + c_custkey * 37', 8)} AS nl FROM customer),
m1 AS (SELECT *, CASE WHEN {_w('ro', national_id.CNP_WEIGHTS)} % 11 = 10 THEN 1 ELSE {_w('ro', national_id.CNP_WEIGHTS)} % 11 END AS rc, (10 - {_w('pl', national_id.PESEL_WEIGHTS)} % 10) % 10 AS pc, {_w('nl', national_id.BSN_WEIGHTS[:8])} % 11 AS nc FROM m0),
m2 AS (SELECT k, country, name, CASE country WHEN 'PL' THEN concat(pl, CASE WHEN k % 8 = 5 THEN (pc + 1) % 10 ELSE pc END) WHEN 'NL' THEN concat(nl, nc % 10) ELSE concat(ro, CASE WHEN k % 8 = 3 THEN (rc + 1) % 10 ELSE rc END) END AS value,
  CASE country WHEN 'PL' THEN k % 8 <> 5 WHEN 'NL' THEN nc < 10 ELSE k % 8 <> 3 END AS ok FROM m1),
m AS (SELECT *, concat('Patient ', name, ', id ', value, ' of ', name, CASE WHEN k % 5 <> 0 THEN concat(' (', value, ')') ELSE '' END, ' of note') AS text, CAST(length(name) AS INT) AS n, CAST(length(value) AS INT) AS v FROM m2),
g AS (SELECT k, country, 1 AS nth, 'PERSON' AS label, 8 AS s, 8 + n AS e, name AS value, ok FROM m UNION ALL SELECT k, country, 2, 'NATIONAL_ID', n + 13, n + 13 + v, value, ok FROM m
  UNION ALL SELECT k, country, 3, 'PERSON', n + v + 17, 2 * n + v + 17, name, ok FROM m UNION ALL SELECT k, country, 4, 'NATIONAL_ID', 2 * n + v + 19, 2 * n + 2 * v + 19, value, ok FROM m WHERE k % 5 <> 0),
dd AS (SELECT unnest(['exact', 'part', 'late', 'first', 'wrong', 'none']) AS detector),
p AS (SELECT 'exact' AS detector, k, nth, label, s, e FROM g UNION ALL SELECT 'part', k, nth, label, s, s + CASE label WHEN 'PERSON' THEN 3 ELSE 4 END FROM g UNION ALL SELECT 'late', k, nth, label, s + 1, e + 2 FROM g
  UNION ALL SELECT 'first', k, nth, label, s, e FROM g WHERE nth < 3 UNION ALL SELECT 'wrong', k, nth, 'PERSON', s, e FROM g WHERE label = 'NATIONAL_ID' UNION ALL SELECT 'wrong', k, -1, 'ORG', 0, 7 FROM m UNION ALL SELECT 'wrong', k, 0, 'ORG', 7, 9 FROM m),
tk AS (SELECT k, i, w, CAST(sum(length(w) + 1) OVER (PARTITION BY k ORDER BY i) - length(w) - 1 AS INT) AS s, CAST(sum(length(w) + 1) OVER (PARTITION BY k ORDER BY i) - 1 AS INT) AS e
  FROM (SELECT k, generate_subscripts(l, 1) AS i, unnest(l) AS w FROM (SELECT k, string_split(text, ' ') AS l FROM m))),
tt AS (SELECT detector, tk.k, i, arg_min(label, nth) AS label FROM tk JOIN p ON p.k = tk.k AND tk.s < p.e AND tk.e > p.s GROUP BY ALL),
det AS (SELECT dd.detector, g.k, country, nth, g.label, value, ok, count(tt.i) > 0 AS detected FROM g CROSS JOIN dd JOIN tk ON tk.k = g.k AND tk.s < g.e AND tk.e > g.s LEFT JOIN tt ON tt.detector = dd.detector AND tt.k = tk.k AND tt.i = tk.i GROUP BY ALL),
sub AS (SELECT detector, k AS doc_id, country, value, bool_and(detected) AS detected, country <> 'NL' AS decode_bearing, CASE country WHEN 'RO' THEN 3 WHEN 'PL' THEN 2 ELSE 0 END AS qi FROM det WHERE label = 'NATIONAL_ID' AND ok GROUP BY ALL),
ch AS (SELECT dd.detector, k, i, c, EXISTS (SELECT 1 FROM p WHERE p.detector = dd.detector AND p.k = x.k AND p.s < x.i AND x.i <= p.e) AS hid FROM (SELECT k, generate_subscripts(l, 1) AS i, unnest(l) AS c FROM (SELECT k, string_split(text, '') AS l FROM m)) x CROSS JOIN dd),
red AS (SELECT detector, k, string_agg(CASE WHEN NOT hid THEN c WHEN before THEN '' ELSE '█' END, '' ORDER BY i) AS redacted FROM (SELECT *, coalesce(lag(hid) OVER (PARTITION BY detector, k ORDER BY i), false) AS before FROM ch) GROUP BY ALL)
"""
_LEFT = "lv AS (SELECT red.detector, sub.doc_id, sub.qi, list_bool_or(list_transform(range(1, length(value) - 2), lambda i: contains(replace(redacted, ' ', ''), substr(value, i, 4)))) AS l FROM red JOIN sub ON sub.doc_id = red.k AND sub.detector = 'none' AND decode_bearing)"


def _shown(count: str, total: str, name: str) -> str:
    return f"CASE WHEN {total} > 0 THEN {count} * 1.0e0 / {total} ELSE 0 END AS {name}"


def _interval(s: str, n: str) -> str:
    return f"round({wilson_sql(s, n, '-')}, 12) AS leak_rate_ci_low, round({wilson_sql(s, n, '+')}, 12) AS leak_rate_ci_high"


_REPORT = f"""r AS (SELECT detector, count(*) FILTER (decode_bearing) AS t, count(*) FILTER (decode_bearing AND detected) AS d, count(*) FILTER (decode_bearing AND NOT detected) AS x, CAST(coalesce(sum(qi) FILTER (decode_bearing AND NOT detected), 0) AS BIGINT) AS q,
  count(*) FILTER (NOT decode_bearing) AS ct, count(*) FILTER (NOT decode_bearing AND detected) AS cd FROM sub WHERE {{where}} GROUP BY detector)"""


def _rows(spark, sf_dir):
    return mixed_detectors(mixed_docs(spark, sf_dir))


def _subjects(spark, sf_dir):
    return subjects.with_disclosed(subjects.national_id_subjects(_rows(spark, sf_dir)))


@query("sub1_subjects_of_countries", f"WITH {MIXED} SELECT detector, doc_id, country, value, detected, decode_bearing, CAST(qi AS BIGINT) AS qi FROM sub")
def sub1(spark, sf_dir):
    return _subjects(spark, sf_dir).select("detector", "doc_id", "country", "value", "detected", "decode_bearing", "qi")


@query("met6_leak_report", f"WITH {MIXED}, {_REPORT.format(where='true')} SELECT detector, t AS decode_bearing_total, d AS decode_bearing_detected, x AS decode_bearing_missed, {_shown('x', 't', 'leak_rate')}, {_interval('x', 't')}, {_shown('d', 't', 'detection_rate')}, q AS leaked_quasi_identifiers, ct AS coverage_only_total, cd AS coverage_only_detected, {_shown('cd', 'ct', 'coverage_only_detection_rate')} FROM r")
def met6(spark, sf_dir):
    return metrics.leak_report(_subjects(spark, sf_dir), "detector")


@query("met6_country_counts", f"WITH {MIXED} SELECT detector, country, count(*) AS total, count(*) FILTER (detected) AS detected FROM sub GROUP BY ALL")
def met6_countries(spark, sf_dir):
    return metrics.country_counts(_subjects(spark, sf_dir), "detector")


_IS_RO = "country = 'RO'"


@query("met7_cnp_report", f"WITH {MIXED}, {_REPORT.format(where=_IS_RO)} SELECT detector, t AS cnp_total, d AS cnp_detected, x AS cnp_missed, {_shown('x', 't', 'leak_rate')}, {_interval('x', 't')}, {_shown('d', 't', 'detection_rate')}, q AS leaked_quasi_identifiers FROM r")
def met7(spark, sf_dir):
    rows = _rows(spark, sf_dir).withColumn("country", F.lit("RO"))
    return metrics.cnp_report(subjects.with_disclosed(subjects.national_id_subjects(rows)), "detector")


@query("met11_class_sizes", f"WITH {MIXED}, c AS (SELECT substr(value, 1, 1) IN ('1', '3', '5') AS x, substr(value, 2, 2) AS y, substr(value, 8, 2) AS z, substr(value, 1, 1) IN ('5', '6') AS u, substr(value, 1, 1) IN ('3', '4') AS w, count(*) AS size FROM sub WHERE detector = 'none' AND country = 'RO' GROUP BY ALL) SELECT size, count(*) AS classes FROM c GROUP BY size")
def met11(spark, sf_dir):
    rows = _subjects(spark, sf_dir).filter("detector = 'none' and country = 'RO'").withColumn("year", F.substring("birth_date", 1, 4))
    return metrics.class_sizes(rows, ["sex", "year", "place_code"])


@query("met1_scores_of_countries", f"""WITH {MIXED}, c AS (SELECT dd.detector, (SELECT count(*) FROM p JOIN g USING (k, label, s, e) WHERE p.detector = dd.detector) AS tp, (SELECT count(*) FROM g) AS n_gold, (SELECT count(*) FROM p WHERE p.detector = dd.detector) AS n_pred FROM dd),
r AS (SELECT *, {_shown('tp', 'n_pred', 'precision')}, tp * 1.0e0 / n_gold AS recall, 2.0e0 * tp / (n_gold + n_pred) AS f1 FROM c) SELECT *, CASE WHEN precision + recall > 0 THEN 5 * precision * recall / (4 * precision + recall) ELSE 0 END AS f2 FROM r""")
def met1(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return metrics.entity_scores(metrics.spans_of(rows, "gold"), metrics.spans_of(rows, "pred"))


_BIOES = "CASE WHEN label IS NULL THEN 'O' ELSE concat(CASE WHEN first AND last THEN 'S-' WHEN first THEN 'B-' WHEN last THEN 'E-' ELSE 'I-' END, label) END"


@query("tag1_tags_of_countries", f"WITH {MIXED}, o AS (SELECT tk.k, i, nth, label FROM tk LEFT JOIN g ON g.k = tk.k AND tk.s < g.e AND tk.e > g.s), b AS (SELECT k, i, label, lag(nth) OVER w IS DISTINCT FROM nth AS first, lead(nth) OVER w IS DISTINCT FROM nth AS last FROM o WINDOW w AS (PARTITION BY k ORDER BY i)) SELECT k AS doc_id, string_agg({_BIOES}, ',' ORDER BY i) AS tags FROM b GROUP BY k")
def tag1(spark, sf_dir):
    rows = mixed_docs(spark, sf_dir).withColumn("t", tokens.whitespace_tokens(F.col("text")))
    return rows.select("doc_id", F.array_join(tags.gold_tags(F.col("t"), F.col("gold")), ",").alias("tags"))


@query("tag5_entity_tags_of_countries", f"WITH {MIXED}, o AS (SELECT dd.detector, tk.k, tk.i, tt.label FROM tk CROSS JOIN dd LEFT JOIN tt ON tt.detector = dd.detector AND tt.k = tk.k AND tt.i = tk.i), b AS (SELECT detector, k, i, label, lag(label) OVER w IS DISTINCT FROM label AS first, lead(label) OVER w IS DISTINCT FROM label AS last FROM o WINDOW w AS (PARTITION BY detector, k ORDER BY i)) SELECT detector, k AS doc_id, string_agg({_BIOES}, ',' ORDER BY i) AS tags FROM b GROUP BY ALL")
def tag5(spark, sf_dir):
    return _rows(spark, sf_dir).select("detector", "doc_id", F.array_join(tags.entity_tags(F.col("tokens"), F.col("pred")), ",").alias("tags"))


@query("ano1_masks_of_countries", f"WITH {MIXED} SELECT detector, k AS doc_id, redacted FROM red")
def ano1(spark, sf_dir):
    return anonymization.anonymize(_rows(spark, sf_dir))


@query("ano5_redaction_report", f"WITH {MIXED}, {_LEFT}, r AS (SELECT detector, count(*) AS t, count(*) FILTER (l) AS x, CAST(coalesce(sum(qi) FILTER (l), 0) AS BIGINT) AS q FROM lv GROUP BY detector) SELECT detector, t AS subjects_total, x AS subjects_leaked, x * 1.0e0 / t AS leak_rate, {_interval('x', 't')}, q AS leaked_quasi_identifiers FROM r")
def ano5(spark, sf_dir):
    docs = mixed_docs(spark, sf_dir)
    return anonymization.redaction_report(subjects.with_disclosed(subjects.quasi_identifier_subjects(docs)), anonymization.anonymize(mixed_detectors(docs)))


@query("ano8_retention_of_countries", f"""WITH {MIXED}, a AS (SELECT k, w, count(*) AS c FROM tk WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.k = tk.k AND tk.s < g.e AND tk.e > g.s) GROUP BY ALL),
b AS (SELECT detector, k, w, count(*) AS c FROM (SELECT detector, k, unnest(string_split(redacted, ' ')) AS w FROM red) WHERE w <> '' GROUP BY ALL),
h AS (SELECT detector, sum(least(a.c, b.c)) AS kept FROM a JOIN b USING (k, w) GROUP BY detector) SELECT detector, coalesce(kept, 0) * 1.0e0 / (SELECT sum(c) FROM a) AS retention FROM dd LEFT JOIN h USING (detector)""")
def ano8(spark, sf_dir):
    docs = mixed_docs(spark, sf_dir)
    return anonymization.information_retention(docs, anonymization.anonymize(mixed_detectors(docs)))


def _same_rule(name: str, of: str, country: str) -> None:
    """Slovak ids follow the Czech rule and Lithuanian ones the Estonian: the same values, taken as ids of the other country."""
    from privlytics.plans.registry import ORACLE_SQL, QUERIES

    @query(name, ORACLE_SQL[of])
    def other(spark, sf_dir):
        rows = QUERIES[of](spark, sf_dir)
        id_ = national_id.parse(F.lit(country), F.col("value"))
        return rows.select(*(id_["valid"].alias(c) if c == "valid" else F.col(c) for c in rows.columns))


_same_rule("nid_sk", "nid_cz", "SK")
_same_rule("nid_lt", "nid_ee", "LT")
