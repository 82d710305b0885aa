"""Queries of whole reports: classes by detector, surrogates by document, tracks, corpora, saturation, places, points of the bootstraps."""

from __future__ import annotations

from pyspark.sql import functions as F

from privlytics.functions import national_id
from privlytics.operators import anonymization, bootstrap, comparison, detectors, drift, metrics, population, subjects
from privlytics.plans import suite
from privlytics.plans.deidentification import _RESIDUAL
from privlytics.plans.evaluation import _DRIFT, _drift_rows
from privlytics.plans.registry import IDS, query
from privlytics.plans.reports import _REPORT, MIXED, _shown
from privlytics.sources.fixtures import detected, id_docs, mixed_detectors, mixed_docs, read_table

_REPORT_COLUMNS = ("detector", "available", "reason", "n", "n_classes", "k1", "k_lt5", "sizes")
_CLASSES = f"""h AS (SELECT detector, c AS size, count(*) AS classes FROM s GROUP BY ALL), r AS (SELECT detector, CAST(sum(size * classes) AS BIGINT) AS n, CAST(sum(classes) AS BIGINT) AS n_classes, coalesce(sum(size * classes) FILTER (size = 1), 0) * 1.0e0 / sum(size * classes) AS k1,
coalesce(sum(size * classes) FILTER (size < 5), 0) * 1.0e0 / sum(size * classes) AS k_lt5, string_agg(concat(size, ':', classes), ' ' ORDER BY size) AS sizes FROM h GROUP BY detector)
SELECT detector, n IS NOT NULL AS available, CASE WHEN n IS NULL THEN '{metrics.NO_TUPLES}' END AS reason, n, n_classes, k1, k_lt5, sizes FROM d LEFT JOIN r USING (detector)"""


def _with_sizes(report):
    sizes = F.array_join(F.transform("sizes", lambda s: F.concat_ws(":", s["size"].cast("string"), s["classes"].cast("string"))), " ")
    return report.withColumn("sizes", sizes).select(*_REPORT_COLUMNS)


@query("met10_violation_report", f"WITH {IDS}, {_RESIDUAL}, d AS (SELECT DISTINCT detector FROM sub), s AS (SELECT detector, count(*) AS c FROM res GROUP BY detector, dob_band, sex, nuts2), {_CLASSES}")
def met10(spark, sf_dir):
    rows = detected(id_docs(spark, sf_dir))
    return _with_sizes(metrics.k_anonymity_violation(rows, subjects.residual_rows(rows)))


@query("met10_given_tuples", f"WITH x AS (SELECT concat('d', c_custkey % 2) AS detector, c_nationkey % 5 AS region, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS sex, c_custkey % 7 = 0 AS without FROM customer), d AS (SELECT DISTINCT detector FROM x), s AS (SELECT detector, count(*) AS c FROM x GROUP BY detector, CASE WHEN without THEN NULL ELSE region END, CASE WHEN without THEN NULL ELSE sex END), {_CLASSES}")
def met10_given(spark, sf_dir):
    k = F.col("c_custkey")
    given = F.struct((F.col("c_nationkey") % 5).alias("region"), F.when(k % 3 > 0, F.col("c_mktsegment")).alias("sex"))
    rows = read_table(spark, sf_dir, "customer").select(F.concat(F.lit("d"), (k % 2).cast("string")).alias("detector"), F.when(k % 7 > 0, given).alias("qi_tuple"))
    return _with_sizes(metrics.k_anonymity_violation(rows, spark.createDataFrame([], "detector string, dob_band string, sex string, nuts2 string")))


_MENTIONS = "mt AS (SELECT p.k, p.s, p.label, substr(text, p.s + 1, p.e - p.s) AS value FROM p JOIN m USING (k) WHERE detector = 'part'), en AS (SELECT label, replace(value, ' ', '') AS entity, min(struct_pack(k := k, s := s)) AS seen FROM mt GROUP BY ALL), su AS (SELECT label, entity, concat(label, '_', row_number() OVER (PARTITION BY label ORDER BY seen)) AS surrogate FROM en)"


@query("ano3_surrogate_maps", f"WITH {MIXED}, {_MENTIONS} SELECT k AS doc_id, value, arg_max(surrogate, s) AS surrogate FROM mt JOIN su ON mt.label = su.label AND replace(value, ' ', '') = entity GROUP BY ALL")
def ano3(spark, sf_dir):
    found = mixed_detectors(mixed_docs(spark, sf_dir)).filter("detector = 'part'")
    maps = anonymization.surrogate_maps(detectors.mentions(found))
    return maps.select("doc_id", F.explode("surrogates").alias("value", "surrogate"))


@query("sig12_track_drivers", f"""WITH {MIXED}, {_REPORT.format(where='true')}, c AS (SELECT dd.detector, (SELECT count(*) FROM p JOIN g USING (k, label, s, e) WHERE p.detector = dd.detector) AS tp, (SELECT count(*) FROM g) AS n_gold, (SELECT count(*) FROM p WHERE p.detector = dd.detector AND label <> 'ORG') AS n_pred FROM dd),
o AS (SELECT detector, 2.0e0 * tp / (n_gold + n_pred) AS f1, CASE WHEN n_pred > 0 THEN tp * 1.0e0 / n_pred ELSE 0 END AS pr, tp * 1.0e0 / n_gold AS re FROM c)
SELECT detector, f1, CASE WHEN pr + re > 0 THEN 5 * pr * re / (4 * pr + re) ELSE 0 END AS f2, {_shown('x', 't', 'leak_rate')}, x AS missed, t AS total, q AS leaked_qi FROM o JOIN r USING (detector)""")
def sig12(spark, sf_dir):
    return suite.track_drivers(mixed_detectors(mixed_docs(spark, sf_dir)))


@query("div15_description", f"""WITH {MIXED}, l AS (SELECT label, count(*) FILTER (k % 2 = 0) AS a, count(*) FILTER (k % 2 = 1) AS b FROM g GROUP BY label), s AS (SELECT a * 1.0e0 / sum(a) OVER () AS p, b * 1.0e0 / sum(b) OVER () AS q FROM l),
dv AS (SELECT sum(abs(p - q)) / 2 AS tv, sqrt(greatest(0, sum((CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2))) AS js FROM s),
ln AS (SELECT k, count(*) AS x FROM tk GROUP BY k), mn AS (SELECT avg(x) FILTER (k % 2 = 0) AS mean_tokens_a, avg(x) FILTER (k % 2 = 1) AS mean_tokens_b FROM ln), xs AS (SELECT x, count(*) FILTER (k % 2 = 0) AS a, count(*) FILTER (k % 2 = 1) AS b FROM ln GROUP BY x),
fn AS (SELECT lead(x) OVER (ORDER BY x) - x AS dx, sum(a) OVER (ORDER BY x) * 1.0e0 / sum(a) OVER () AS f, sum(b) OVER (ORDER BY x) * 1.0e0 / sum(b) OVER () AS h FROM xs), ws AS (SELECT coalesce(sum(abs(f - h) * dx), 0) AS w1 FROM fn)
SELECT round(tv, 9) AS tv, round(js, 9) AS js, round(w1, 9) AS w1_tokens, round(mean_tokens_a, 9) AS mean_tokens_a, round(mean_tokens_b, 9) AS mean_tokens_b FROM dv, mn, ws""")
def div15(spark, sf_dir):
    side = F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b")
    found = drift.description(mixed_docs(spark, sf_dir).select(side.alias("side"), "text", F.col("gold.label").alias("labels")))
    return found.select(*(F.round(c, 9).alias(c) for c in found.columns))


_SCORES = f"{_DRIFT}, sc AS (SELECT CASE WHEN name = '5-LOW' THEN 'dummy' ELSE name END AS adapter, config AS language, f1 AS score FROM d)"


def _scores(spark, sf_dir):
    name = F.when(F.col("name") == "5-LOW", "dummy").otherwise(F.col("name"))
    return _drift_rows(spark, sf_dir).select(name.alias("adapter"), F.col("config").alias("language"), F.col("f1").alias("score"))


@query("div16_language_spread", f"WITH {_SCORES} SELECT language, round(min(score), 4) AS least, round(max(score), 4) AS most, round(max(score) - min(score), 4) AS spread FROM sc WHERE adapter <> 'dummy' GROUP BY language")
def div16_spread(spark, sf_dir):
    return comparison.language_spread(_scores(spark, sf_dir))


@query("div16_headline", f"WITH {_SCORES} SELECT round(max(score), 4) AS most, max(score) >= 0.999 AS saturates, CASE WHEN max(score) < 0.999 THEN 'not saturating' ELSE 'still saturating' END AS verdict FROM sc WHERE adapter <> 'dummy'")
def div16_headline(spark, sf_dir):
    return comparison.saturation_headline(_scores(spark, sf_dir))


def _f1(found):
    """Detectors' F1 with the interval over resampled documents; the exact one goes by the same name on both corpora."""
    exact = lambda s: F.struct(s["start"], s["end"], s["label"])
    hits = F.size(F.array_intersect(F.transform("gold", exact), F.transform("pred", exact)))
    name = F.when(F.col("detector") == "full", "exact").otherwise(F.col("detector"))
    counts = found.select(name.alias("detector"), hits.alias("tp"), F.size("pred").alias("n_pred"), F.size("gold").alias("n_gold"))
    return bootstrap.f1_intervals(counts).withColumnRenamed("detector", "name")


_F1S = f"""ta AS (WITH {IDS} SELECT CASE detector WHEN 'full' THEN 'exact' ELSE detector END AS name, 2.0e0 * count(*) FILTER (detected) / (count(*) + count(*) FILTER (detected)) AS f1 FROM det GROUP BY detector),
tb AS (WITH {MIXED} SELECT detector AS name, 2.0e0 * (SELECT count(*) FROM p JOIN g USING (k, label, s, e) WHERE p.detector = dd.detector) / ((SELECT count(*) FROM g) + (SELECT count(*) FROM p WHERE p.detector = dd.detector)) AS f1 FROM dd)"""


# the interval comes from draws that SQL does not repeat; that it ends below 0.999 where f1 is below 0.95 is what the SQL adds
@query("div18_with_intervals", f"WITH {_F1S} SELECT name, round(ta.f1, 9) AS f1_templated, round(tb.f1, 9) AS f1_diverse, round(ta.f1 - tb.f1, 4) AS drop, tb.f1 < 0.95 AND tb.f1 < ta.f1 AS desaturates FROM ta JOIN tb USING (name)")
def div18(spark, sf_dir):
    templated, diverse = _f1(detected(id_docs(spark, sf_dir))), _f1(mixed_detectors(mixed_docs(spark, sf_dir)))
    return drift.desaturation(templated, diverse).withColumns({c: F.round(c, 9) for c in ("f1_templated", "f1_diverse")})


@query("div18_skips", f"WITH {_F1S} SELECT coalesce(ta.name, tb.name) AS name, CASE WHEN ta.name IS NULL THEN 'no templated result' ELSE 'no diverse result' END AS skipped FROM ta FULL JOIN tb USING (name) WHERE ta.name IS NULL OR tb.name IS NULL")
def div18_skips(spark, sf_dir):
    return drift.desaturation_skips(_f1(detected(id_docs(spark, sf_dir))), _f1(mixed_detectors(mixed_docs(spark, sf_dir))))


_CODES = ("H501", "f205 ", "Z404", "Z999", "X123", "a662", "z133", "L736", "")
_PLACES = "(VALUES " + ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in (national_id.TOWNS | national_id.COUNTRIES).items()) + ") w(c, place)"


@query("nid_birth_places", f"WITH q AS (SELECT c_custkey AS k, upper(trim([{', '.join(repr(c) for c in _CODES)}][c_custkey % {len(_CODES)} + 1])) AS code FROM customer) SELECT k, code, CASE WHEN code LIKE 'Z%' THEN 'foreign_country' WHEN place IS NULL THEN 'unknown' ELSE 'comune' END AS kind, place AS name FROM q LEFT JOIN {_PLACES} ON c = code")
def nid_birth_places(spark, sf_dir):
    k = F.col("c_custkey")
    code = F.element_at(F.array(*map(F.lit, _CODES)), (k % len(_CODES) + 1).cast("int"))
    return read_table(spark, sf_dir, "customer").select(k.alias("k"), national_id.birth_place(code).alias("p")).select("k", "p.code", "p.kind", "p.name")


_SPEC = {
    "meta": {"axes": ["sex", "region"], "population_total": 1000, "placeholder": True},
    "axes": {"sex": ["M", "F"], "region": ["R1", "R2", "R3"]},
    "marginals": [{"axes": ["sex"], "counts": {"M": 485, "F": 515}}, {"axes": ["region"], "counts": {"R1": 450, "R2": 350, "R3": 200}}],
}


@query("pop3_joint_of_spec", "SELECT sex, region, round(s * r / 1000000.0e0, 9) AS p FROM (VALUES ('M', 485), ('F', 515)) a(sex, s), (VALUES ('R1', 450), ('R2', 350), ('R3', 200)) b(region, r)")
def pop3(spark, sf_dir):
    return population.joint_from_spec(_SPEC).table(spark).withColumn("p", F.round("p", 9))


# --- what the bootstraps resample: the points, which do not depend on draws --------------------------------------------


@query("boo1_leak_gap_points", f"WITH {_DRIFT} SELECT name, round(1 - detected_a / total_a, 9) AS rate_a, round(1 - detected_b / total_b, 9) AS rate_b, round(detected_b / total_b - detected_a / total_a, 9) AS gap FROM dp")
def boo1(spark, sf_dir):
    found = bootstrap.rate_gaps(drift.drift_pairs(_drift_rows(spark, sf_dir), "0", "1"))
    return found.select("name", *(F.round(c, 9).alias(c) for c in ("rate_a", "rate_b", "gap")))


@query("boo3_f1_points", f"WITH {MIXED} SELECT detector AS name, (SELECT count(*) FROM m) AS n, round(2.0e0 * (SELECT count(*) FROM p JOIN g USING (k, label, s, e) WHERE p.detector = dd.detector) / ((SELECT count(*) FROM g) + (SELECT count(*) FROM p WHERE p.detector = dd.detector)), 9) AS f1 FROM dd")
def boo3(spark, sf_dir):
    return _f1(mixed_detectors(mixed_docs(spark, sf_dir))).select("name", "n", F.round("f1", 9).alias("f1"))


@query("boo4_paired_points", f"WITH {MIXED} SELECT 'first - part' AS name, count(*) AS n, round((count(*) FILTER (NOT a.detected) - count(*) FILTER (NOT b.detected)) * 1.0e0 / count(*), 9) AS gap FROM sub a JOIN sub b USING (doc_id, country, value) WHERE a.detector = 'first' AND b.detector = 'part'")
def boo4(spark, sf_dir):
    found = subjects.national_id_subjects(mixed_detectors(mixed_docs(spark, sf_dir))).withColumn("name", F.lit("first - part"))
    gaps = bootstrap.paired_gaps(found.filter("detector = 'first'"), found.filter("detector = 'part'"), ["doc_id", "country", "value"])
    return gaps.select("name", "n", F.round("gap", 9).alias("gap"))


@query("boo5_centroid_point", """WITH e AS (SELECT label % 2 AS side, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS v FROM embeddings), c AS (SELECT side, i, sum(CAST(v AS DOUBLE)) AS m FROM e GROUP BY ALL),
w AS (SELECT i, max(m) FILTER (side = 0) AS a, max(m) FILTER (side = 1) AS b FROM c GROUP BY i) SELECT round(1 - sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))), 6) AS point FROM w""")
def boo5(spark, sf_dir):
    side = F.when(F.col("label") % 2 == 0, "a").otherwise("b")
    rows = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), side.alias("side"), F.col("embedding").alias("vec"))
    return bootstrap.centroid_intervals(rows, replicates=20).select(F.round("point", 6).alias("point"))
