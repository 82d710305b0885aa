"""Queries of taxonomies, boards, families of gaps, drift, bootstraps and population bounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from privlytics.functions import tags, taxonomy, tokens
from privlytics.operators import bootstrap, comparison, corpus, detectors, drift, leaderboard, metrics, population, subjects
from privlytics.plans import suite
from privlytics.plans.deidentification import _AXES, _JOINT, _joint
from privlytics.plans.registry import IDS, LEAK, query, wilson_sql
from privlytics.sources.files import head_per_group
from privlytics.sources.fixtures import detected, id_docs, read_table


def _rows(spark, sf_dir):
    return detected(id_docs(spark, sf_dir))


def _strings(xs) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


def _pick(xs, key):
    """The element of a short list at a key's remainder."""
    return F.element_at(F.array(*map(F.lit, xs)), (key % len(xs) + 1).cast("int"))


def _pick_sql(xs, key: str) -> str:
    return f"{_strings(xs)}[{key} % {len(xs)} + 1]"


# --- sources and taxonomy --------------------------------------------------------------------------------------------


@query("src5_fill_languages", "SELECT lang, doc_id FROM documents WHERE lang IN ('en', 'fr') QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 30")
def src5(spark, sf_dir):
    return head_per_group(read_table(spark, sf_dir, "documents").select("lang", "doc_id"), "lang", ["en", "fr"], 30, "doc_id")


_TYPES = f"ty AS (SELECT unnest({_strings(n for n, *_ in taxonomy.ENTITIES)}) AS name)"


@query("tag9_bioes_labels", f"WITH {_TYPES} SELECT 'O' AS label UNION ALL SELECT k || '-' || name FROM ty, (VALUES ('B'), ('I'), ('E'), ('S')) v(k)")
def tag9(spark, sf_dir):
    return taxonomy.bioes_labels(taxonomy.entities(spark))


_SCHEMES = sorted({s for _, s, _ in taxonomy.CROSSWALK})
_NATIVES = sorted({x for _, _, natives in taxonomy.CROSSWALK for x in natives.split()})
_WALK = "walk AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{s}', '{x}')" for n, s, natives in taxonomy.CROSSWALK for x in natives.split()) + ") w(name, scheme, native))"


@query("map1_labels", f"WITH {_WALK}, c AS (SELECT c_custkey AS k, {_pick_sql(_SCHEMES, 'c_custkey')} AS scheme, {_pick_sql(_NATIVES, 'c_custkey')} AS native FROM customer) SELECT k, scheme, native, name FROM c LEFT JOIN walk USING (scheme, native)")
def map1(spark, sf_dir):
    k = F.col("c_custkey")
    rows = read_table(spark, sf_dir, "customer").select(k.alias("k"), _pick(_SCHEMES, k).alias("scheme"), _pick(_NATIVES, k).alias("native"))
    return taxonomy.map_labels(rows, taxonomy.crosswalk(spark)).select("k", "scheme", "native", "name")


@query("map2_conflicts", "SELECT c_mktsegment AS scheme, c_nationkey AS native, count(DISTINCT c_custkey % 3) AS names FROM customer GROUP BY ALL HAVING names > 1")
def map2(spark, sf_dir):
    return taxonomy.conflicts(read_table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("scheme"), F.col("c_nationkey").alias("native"), (F.col("c_custkey") % 3).alias("name")))


@query("tag5_native_tags", f"WITH {IDS} SELECT k AS doc_id, concat('O,S-NATIONAL_ID,O,O', CASE WHEN k % 4 = 0 THEN ',O,S-NATIONAL_ID' ELSE '' END) AS tags FROM f2")
def tag5(spark, sf_dir):
    rows = id_docs(spark, sf_dir).withColumn("t", tokens.whitespace_tokens(F.col("text")))
    return rows.select("doc_id", F.array_join(taxonomy.native_tags(F.col("t"), F.col("gold"), "tabularisai"), ",").alias("tags"))


@query("adp5_span_scores", f"WITH {IDS} SELECT k AS doc_id, label, CAST(s AS INT) AS start, CASE label WHEN 'PERSON' THEN 0.0e0 ELSE (k % 10 + 5) / 20.0e0 END AS score FROM occ")
def adp5(spark, sf_dir):
    # each gold span is backed by two pieces under its label and one under another; names by none of their own
    label = lambda g: F.when(g["label"] == "PERSON", "OTHER").otherwise(g["label"])
    piece = lambda g, a, b, x, name: F.struct(a.alias("start"), b.alias("end"), name.alias("label"), x.alias("score"))
    low, high = (F.col("doc_id") % 10) / 10.0, F.lit(0.5)
    pieces = F.flatten(F.transform("gold", lambda g: F.array(piece(g, g["start"], g["start"] + 2, low, label(g)), piece(g, g["start"] + 2, g["end"], high, label(g)), piece(g, g["start"], g["end"], F.lit(1.0), F.lit("OTHER")))))
    scored = id_docs(spark, sf_dir).select("doc_id", F.explode(detectors.span_scores(F.col("gold"), pieces)).alias("s"))
    return scored.select("doc_id", "s.label", "s.start", F.round("s.score", 12).alias("score"))


# --- boards ----------------------------------------------------------------------------------------------------------

_ADAPTERS = ("presidio", "openmed", "tabularisai", "own", "other")
_CONFIGS = ("en", "fr", "xx", "ro-synthetic-v1", "ro-realskeleton-v1", "tab-echr-legal-en-v1", "ai4privacy-openpii-ro-v1", "ai4privacy-openpii-fr-v1", "ai4privacy-openpii-fr")


def _board(spark, sf_dir):
    k = F.col("c_custkey")
    return read_table(spark, sf_dir, "customer").select(
        k.alias("k"), _pick(_ADAPTERS, k).alias("adapter"), _pick(("m1", "m2", "m3"), k).alias("model_id"), _pick(_CONFIGS, k).alias("config"), F.concat(F.lit("spec "), (k % 20).cast("string")).alias("spec"),
        F.when(k % 11 > 0, k % 1000 / 1000.0).alias("f1"), (k % 500 / 500.0).alias("f2"), F.when(k % 3 == 0, k % 7 / 7.0).alias("leak_rate"), F.when(k % 3 == 1, k % 5 / 5.0).alias("cnp_leak_rate"), (k % 9).alias("missed"), (k % 4).alias("leaked_qi"),
    )


_BOARD = f"""b AS (SELECT c_custkey AS k, {_pick_sql(_ADAPTERS, 'c_custkey')} AS adapter, {_pick_sql(('m1', 'm2', 'm3'), 'c_custkey')} AS model_id, {_pick_sql(_CONFIGS, 'c_custkey')} AS config, 'spec ' || c_custkey % 20 AS spec,
CASE WHEN c_custkey % 11 > 0 THEN c_custkey % 1000 / 1000.0e0 END AS f1, c_custkey % 500 / 500.0e0 AS f2, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 7 / 7.0e0 END AS leak_rate, CASE WHEN c_custkey % 3 = 1 THEN c_custkey % 5 / 5.0e0 END AS cnp_leak_rate, c_custkey % 9 AS missed, c_custkey % 4 AS leaked_qi FROM customer)"""
_MARKED = f"""m AS (SELECT *, CASE WHEN config IN ('ro-realskeleton-v1', 'tab-echr-legal-en-v1') OR adapter = 'presidio' THEN 'clean_held_out'
WHEN config LIKE 'ai4privacy-openpii-%-v1' AND adapter IN ('openmed', 'tabularisai') THEN 'in_distribution'
WHEN config LIKE 'ai4privacy-openpii-%-v1' AND adapter = 'own' THEN CASE WHEN config = 'ai4privacy-openpii-ro-v1' THEN 'unknown' ELSE 'clean_held_out' END
WHEN adapter IN ('openmed', 'tabularisai') AND config IN ('en', 'fr') THEN 'in_distribution' WHEN adapter = 'own' AND config = 'ro-synthetic-v1' THEN 'in_distribution' WHEN adapter = 'own' AND config = 'fr' THEN 'clean_held_out' ELSE 'unknown' END AS contamination,
CASE WHEN config = 'tab-echr-legal-en-v1' THEN 'real-external-gold' ELSE 'dev' END AS config_status FROM b)"""


@query("ldb1_contamination", f"WITH {_BOARD}, {_MARKED} SELECT k, adapter, config, contamination, config_status FROM m")
def ldb1(spark, sf_dir):
    return leaderboard.annotate(_board(spark, sf_dir), own=("own",)).select("k", "adapter", "config", "contamination", "config_status")


@query("ldb4_board", f"WITH {_BOARD} SELECT adapter || '::' || model_id AS entry, count(*) AS n, string_agg(spec, ',' ORDER BY spec) AS specs FROM b GROUP BY ALL")
def ldb4(spark, sf_dir):
    board = leaderboard.build(_board(spark, sf_dir), own=("own",))
    return board.select("entry", F.size("specs").cast("long").alias("n"), F.array_join(F.col("specs.spec"), ",").alias("specs"))


_CELL = "CASE WHEN f1 IS NOT NULL THEN printf('%.3f/%.3f', f1, f2) ELSE '-' END"


@query("ldb5_score_pivot", f"WITH {_BOARD}, x AS (SELECT spec, adapter, model_id, {_CELL} AS cell FROM b) SELECT spec, " + ", ".join(f"coalesce((max({{'m': model_id, 'c': cell}}) FILTER (adapter = '{a}')).c, '-') AS {a}" for a in _ADAPTERS) + " FROM x GROUP BY spec")
def ldb5(spark, sf_dir):
    return leaderboard.score_pivot(_board(spark, sf_dir), list(_ADAPTERS))


@query("ldb5_leak_rows", f"WITH {_BOARD} SELECT spec, adapter, coalesce(leak_rate, cnp_leak_rate) AS leak_rate, missed, leaked_qi FROM b WHERE coalesce(leak_rate, cnp_leak_rate) IS NOT NULL")
def ldb5_leaks(spark, sf_dir):
    return leaderboard.leak_rows(_board(spark, sf_dir))


@query("ldb7_upsert", f"WITH {_BOARD} SELECT k, config, f1 FROM b WHERE config <> 'fr' UNION ALL SELECT k, config, f2 FROM b WHERE config = 'fr' AND k % 2 = 0")
def ldb7(spark, sf_dir):
    board = _board(spark, sf_dir).select("k", "config", "f1", "f2")
    fresh = board.filter("config = 'fr' and k % 2 = 0").select("k", "config", F.col("f2").alias("f1"))
    return leaderboard.upsert(board.drop("f2"), fresh, "fr")


@query("sig8_track_points", f"WITH {_BOARD} SELECT adapter, f1, coalesce(leak_rate, cnp_leak_rate) AS leak_rate, missed FROM b WHERE config = 'fr' AND coalesce(leak_rate, cnp_leak_rate) IS NOT NULL")
def sig8(spark, sf_dir):
    return leaderboard.track_points(_board(spark, sf_dir), "fr")


# --- gaps by family --------------------------------------------------------------------------------------------------

_P0, _P1 = "(m0 * 1.0e0 / n0)", "(missed * 1.0e0 / total)"
_L = lambda s, n: wilson_sql(s, n, "-")
_U = lambda s, n: wilson_sql(s, n, "+")
_GAP_LOW = f"({_P1} - {_P0}) - sqrt(({_P1} - ({_L('missed', 'total')})) ** 2 + (({_U('m0', 'n0')}) - {_P0}) ** 2)"
_GAP_HIGH = f"({_P1} - {_P0}) + sqrt((({_U('missed', 'total')}) - {_P1}) ** 2 + ({_P0} - ({_L('m0', 'n0')})) ** 2)"
_FAMILY = "CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END"
_GAPS = f"""fl AS (SELECT detector, {_FAMILY} AS family, count(*) AS total, count(*) FILTER (NOT detected) AS missed FROM sub GROUP BY ALL),
fp AS (SELECT family, missed AS m0, total AS n0 FROM fl WHERE detector = 'full'),
fg AS (SELECT detector, family, {_P1} - {_P0} AS gap, {_GAP_LOW} AS ci_low, {_GAP_HIGH} AS ci_high FROM fl JOIN fp USING (family) WHERE detector <> 'full')"""


def _family_leaks(spark, sf_dir):
    family = F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd")
    return metrics.leak_rates(subjects.national_id_subjects(_rows(spark, sf_dir)).withColumn("family", family), "detector", "family")


@query("sig9_family_leaks", f"WITH {IDS}, s AS (SELECT *, {_FAMILY} AS family FROM sub) {LEAK.format(by='detector, family', src='s')}")
def sig9(spark, sf_dir):
    return _family_leaks(spark, sf_dir)


@query("sig1_detector_gaps", f"WITH {IDS}, {_GAPS} SELECT detector, family, round(gap, 9) AS gap, round(ci_low, 9) AS ci_low, round(ci_high, 9) AS ci_high, ci_low > 0 AS holds FROM fg")
def sig1(spark, sf_dir):
    gaps = metrics.detector_gaps(_family_leaks(spark, sf_dir), "full", "family")
    return gaps.select("detector", "family", *(F.round(c, 9).alias(c) for c in ("gap", "ci_low", "ci_high")), "holds")


@query("sig2_dissociation", f"WITH {IDS}, {_GAPS} SELECT family, count(*) AS gaps, count(*) FILTER (ci_low > 0) AS holding, bool_or(ci_low > 0) AS holds FROM fg GROUP BY family")
def sig2(spark, sf_dir):
    return comparison.dissociation(metrics.detector_gaps(_family_leaks(spark, sf_dir), "full", "family"), "family")


_SUMMARY = f"""{_GAPS}, fs AS (SELECT family, any_value(m0) AS missed, any_value(n0) AS total, bool_or(ci_low > 0) AS holds FROM fg JOIN fp USING (family) GROUP BY family)"""


@query("sig11_summary", f"WITH {IDS}, {_SUMMARY} SELECT max(round({_U('missed', 'total')}, 12)) AS worst_upper, CAST(sum(missed) AS BIGINT) AS missed, CAST(sum(total) AS BIGINT) AS total, bool_and(holds) AS holds, sum(missed) * 1.0e0 / sum(total) AS leak_rate FROM fs")
def sig11(spark, sf_dir):
    leaks = _family_leaks(spark, sf_dir)
    return comparison.consolidated(comparison.summary(metrics.detector_gaps(leaks, "full", "family"), leaks, "full"))


@query("sig11_common_models", "WITH x AS (SELECT DISTINCT c_nationkey AS d, c_mktsegment AS f FROM customer), n AS (SELECT d, count(*) AS n, (SELECT count(DISTINCT f) FROM x) AS k FROM x GROUP BY d) SELECT d AS detector, (SELECT bool_and(n = k) FROM n) AS uniform FROM n WHERE n = k")
def sig11_models(spark, sf_dir):
    return comparison.common_models(read_table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("detector"), F.col("c_mktsegment").alias("family")))


@query("sig12_track_scores", f"""WITH {IDS}, e AS (SELECT detector, 2.0e0 * count(*) FILTER (detected) / (count(*) + count(*) FILTER (detected)) AS f1 FROM det GROUP BY detector), l AS (SELECT detector, count(*) AS total, count(*) FILTER (NOT detected) AS missed FROM sub GROUP BY detector)
SELECT detector, f1, missed * 1.0e0 / total AS leak_rate, missed, total FROM e JOIN l USING (detector)""")
def sig12(spark, sf_dir):
    found = suite.evaluate(_rows(spark, sf_dir), ("entity_f1", "national_id_leakage"))
    return found["entity_f1"].select("detector", "f1").join(found["national_id_leakage"].select("detector", "leak_rate", "missed", "total"), "detector")


@query("sig5_verdict", "SELECT c_custkey AS k, CASE WHEN c_custkey % 20 / 100.0e0 < 0.05 THEN 'significant' ELSE 'not significant' END AS verdict FROM customer")
def sig5(spark, sf_dir):
    return read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), comparison.verdict(F.col("c_custkey") % 20 / 100.0).alias("verdict"))


@query("ano10_detection_recall", f"WITH {IDS}, c AS (SELECT detector, count(*) FILTER (detected) * 1.0e0 AS tp, count(*) AS g FROM det GROUP BY detector) SELECT detector, tp / g AS recall, CASE WHEN tp > 0 THEN 5 * (tp / g) / (4 + tp / g) ELSE 0 END AS f2 FROM c")
def ano10(spark, sf_dir):
    return suite.evaluate(_rows(spark, sf_dir), ("detection_recall",))["detection_recall"]


# --- bootstraps ------------------------------------------------------------------------------------------------------


def _drift_rows(spark, sf_dir):
    g = read_table(spark, sf_dir, "orders").groupBy("o_orderpriority", (F.col("o_orderkey") % 3).cast("string").alias("config"))
    return g.agg(F.count_if(F.col("o_totalprice") < 150000).alias("detected"), F.count("*").alias("total"), F.round(F.max("o_totalprice") / 600000, 6).alias("f1")).withColumnRenamed("o_orderpriority", "name")


_DRIFT = """d AS (SELECT o_orderpriority AS name, CAST(o_orderkey % 3 AS VARCHAR) AS config, count(*) FILTER (o_totalprice < 150000) AS detected, count(*) AS total, round(max(o_totalprice) / 600000, 6) AS f1 FROM orders GROUP BY ALL),
dp AS (SELECT a.name, a.detected AS detected_a, a.total AS total_a, b.detected AS detected_b, b.total AS total_b, a.f1 - b.f1 AS f1_gap FROM d a JOIN d b USING (name) WHERE a.config = '0' AND b.config = '1')"""


@query("boo1_leak_gap_interval")
def boo1(spark, sf_dir):
    return bootstrap.rate_gaps(drift.drift_pairs(_drift_rows(spark, sf_dir), "0", "1"))


@query("boo3_f1_interval")
def boo3(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    hits = F.size(F.array_intersect("gold", "pred"))
    return bootstrap.f1_intervals(rows.select("detector", hits.alias("tp"), F.size("pred").alias("n_pred"), F.size("gold").alias("n_gold")))


@query("boo4_paired_gap")
def boo4(spark, sf_dir):
    found = subjects.national_id_subjects(_rows(spark, sf_dir)).withColumn("name", F.lit("first - third"))
    return bootstrap.paired_gaps(found.filter("detector = 'first'"), found.filter("detector = 'third'"), ["doc_id", "country", "value"])


@query("boo5_centroid_interval")
def boo5(spark, sf_dir):
    side = F.when(F.col("label") % 2 == 0, "a").otherwise("b")
    return bootstrap.centroid_intervals(read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), side.alias("side"), F.col("embedding").alias("vec")), replicates=200)


# --- drift -----------------------------------------------------------------------------------------------------------


@query("div11_frontier_area", """WITH n AS (SELECT label, count(*) FILTER (vec_id % 3 = 0) AS a, count(*) FILTER (vec_id % 3 <> 0) AS b FROM embeddings GROUP BY label), s AS (SELECT a * 1.0e0 / sum(a) OVER () AS p, b * 1.0e0 / sum(b) OVER () AS q FROM n),
r AS (SELECT g, p, q, greatest(g / 49.0e0 * p + (1 - g / 49.0e0) * q, 1e-12) AS r FROM s, range(50) t(g)), c AS (SELECT g, exp(-5 * sum(CASE WHEN q > 0 THEN q * ln(q / r) ELSE 0 END)) AS x, exp(-5 * sum(CASE WHEN p > 0 THEN p * ln(p / r) ELSE 0 END)) AS y FROM r GROUP BY g),
e AS (SELECT * FROM c UNION ALL VALUES (-1, 0.0e0, 1.0e0), (50, 1.0e0, 0.0e0)), t AS (SELECT (lead(x) OVER o - x) * (lead(y) OVER o + y) / 2 AS t FROM e WINDOW o AS (ORDER BY x, g)) SELECT round(least(1, greatest(0, sum(t))), 9) AS score FROM t""")
def div11(spark, sf_dir):
    side = F.when(F.col("vec_id") % 3 == 0, "a").otherwise("b")
    area = drift.frontier_area(read_table(spark, sf_dir, "embeddings").select(side.alias("side"), F.col("label").alias("cluster")))
    return area.select(F.round("score", 9).alias("score"))


@query("div12_normalized", "SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) ** 2))), 9) AS v1, len(embedding) AS dim FROM embeddings")
def div12(spark, sf_dir):
    unit = read_table(spark, sf_dir, "embeddings").select("vec_id", drift.normalized(F.col("embedding")).alias("u"))
    return unit.select("vec_id", F.round(F.col("u")[0], 9).alias("v1"), F.size("u").cast("long").alias("dim"))


@query("div13_most_templated", r"""WITH d AS (SELECT lang AS language, doc_id % 2 AS side, text FROM documents WHERE lang IS NOT NULL),
s AS (SELECT language, side, lower(trim(regexp_replace(regexp_replace(text, '[0-9]', '0', 'g'), '[ \t\r\n]+', ' ', 'g'))) AS sk, count(*) AS n FROM d GROUP BY ALL), u AS (SELECT language, side, count(*) * 1.0e0 / sum(n) AS unique_ratio, max(n) * 1.0e0 / sum(n) AS top_share FROM s GROUP BY ALL),
w AS (SELECT language, side, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM d), t AS (SELECT language, side, count(DISTINCT w) * 1.0e0 / count(*) AS ttr FROM w GROUP BY ALL), j AS (SELECT * FROM u JOIN t USING (language, side)),
g AS (SELECT a.language, b.unique_ratio - a.unique_ratio AS unique_deficit, a.top_share - b.top_share AS top_excess, b.ttr - a.ttr AS ttr_deficit FROM j a JOIN j b USING (language) WHERE a.side = 0 AND b.side = 1)
SELECT language, round(unique_deficit, 9) AS unique_deficit, round(top_excess, 9) AS top_excess, round(ttr_deficit, 9) AS ttr_deficit, round(unique_deficit + top_excess + ttr_deficit, 9) AS score FROM g""")
def div13(spark, sf_dir):
    side = F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b")
    docs = read_table(spark, sf_dir, "documents").filter("lang is not null").select(F.col("lang").alias("language"), side.alias("side"), "text")
    none = F.array().cast(f"array<{tags.SPAN}>")
    # texts are grouped by a digest of their skeleton: whole texts are not shuffled
    sk = docs.groupBy("language", "side", F.sha2(corpus.label_skeleton(F.col("text"), none), 256).alias("sk")).count()
    u = sk.groupBy("language", "side").agg((F.count("*") / F.sum("count").cast("double")).alias("unique_ratio"), (F.max("count") / F.sum("count").cast("double")).alias("top_share"))
    w = docs.select("language", "side", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("w")).groupBy("language", "side", "w").count()
    t = w.groupBy("language", "side").agg((F.count("*") / F.sum("count").cast("double")).alias("ttr"))
    return drift.most_templated(u.join(t, ["language", "side"])).select("language", *(F.round(c, 9).alias(c) for c in ("unique_deficit", "top_excess", "ttr_deficit", "score")))


@query("div14_drift_pairs", f"WITH {_DRIFT} SELECT name, detected_a, total_a, detected_b, total_b, round(f1_gap, 9) AS f1_gap FROM dp")
def div14(spark, sf_dir):
    return drift.drift_pairs(_drift_rows(spark, sf_dir), "0", "1").withColumn("f1_gap", F.round("f1_gap", 9))


@query("div14_matched_pairs", f"WITH {_DRIFT}, m AS (SELECT *, least(total_a, total_b) AS n FROM dp) SELECT name, CAST(round_even(detected_a / total_a * n, 0) AS BIGINT) AS detected_a, n AS total_a, CAST(round_even(detected_b / total_b * n, 0) AS BIGINT) AS detected_b, n AS total_b FROM m")
def div14_matched(spark, sf_dir):
    return drift.matched_pairs(drift.drift_pairs(_drift_rows(spark, sf_dir), "0", "1"))


@query("div15_headline", f"WITH {_DRIFT}, g AS (SELECT detected_a / total_a - detected_b / total_b AS gap FROM dp) SELECT count(*) AS models, round(avg(gap), 9) AS mean_gap, min(gap) AS least, max(gap) AS most, CASE WHEN avg(gap) > 0 THEN 'overstates' ELSE 'understates' END AS direction FROM g")
def div15(spark, sf_dir):
    rate = lambda s: F.col(f"detected_{s}") / F.col(f"total_{s}").cast("double")
    return drift.headline(drift.drift_pairs(_drift_rows(spark, sf_dir), "0", "1").select((rate("a") - rate("b")).alias("gap")))


@query("div17_residual_bounds", f"WITH {IDS}, s AS (SELECT * REPLACE (CASE detector WHEN 'none' THEN 'null' ELSE 'perfect' END AS detector) FROM sub WHERE detector IN ('none', 'full')) {LEAK.format(by='detector', src='s')}")
def div17(spark, sf_dir):
    return metrics.leak_rates(subjects.national_id_subjects(drift.residual_bounds(id_docs(spark, sf_dir))), "detector")


@query("div18_desaturation", f"WITH {_DRIFT} SELECT a.name, a.f1 AS f1_templated, b.f1 AS f1_diverse, round(a.f1 - b.f1, 4) AS drop, b.f1 + 0.01 < 0.999 AND b.f1 < a.f1 AS desaturates FROM d a JOIN d b USING (name) WHERE a.config = '0' AND b.config = '1'")
def div18(spark, sf_dir):
    rows = _drift_rows(spark, sf_dir).withColumn("ci_high", F.col("f1") + 0.01)
    return drift.desaturation(rows.filter("config = '0'"), rows.filter("config = '1'"))


# --- population ------------------------------------------------------------------------------------------------------

_XI = "CASE WHEN p IS NULL OR p <= 0 THEN 1.0e0 ELSE 1 - p END"


@query("pop8_delta_purr", f"WITH {_JOINT}, x AS (SELECT c_custkey % 2 AS s, {_XI} AS xi FROM customer LEFT JOIN j USING (c_mktsegment, c_nationkey)), g AS (SELECT avg(CASE WHEN xi >= 0.99 THEN 1.0e0 ELSE 0 END) FILTER (s = 0) AS baseline_purr, avg(CASE WHEN xi >= 0.99 THEN 1.0e0 ELSE 0 END) FILTER (s = 1) AS model_purr FROM x) SELECT baseline_purr, model_purr, baseline_purr - model_purr AS delta_purr FROM g")
def pop8(spark, sf_dir):
    scored = population.score_rows(read_table(spark, sf_dir, "customer").select("c_custkey", *_AXES), _joint(spark, sf_dir), _AXES, 2)
    return population.delta_purr(scored.filter("c_custkey % 2 = 0"), scored.filter("c_custkey % 2 = 1"), 0.99)


@query("pop9_independent_uniqueness", f"WITH {_JOINT}, a AS (SELECT c_mktsegment, sum(p) AS pa FROM j GROUP BY ALL), b AS (SELECT c_nationkey, sum(p) AS pb FROM j GROUP BY ALL) SELECT c_custkey, round(1 - coalesce(pa, 0) * coalesce(pb, 0), 9) AS xi_upper FROM customer LEFT JOIN a USING (c_mktsegment) LEFT JOIN b USING (c_nationkey)")
def pop9(spark, sf_dir):
    out = population.independent_uniqueness(read_table(spark, sf_dir, "customer").select("c_custkey", *_AXES), _joint(spark, sf_dir), _AXES, 2)
    return out.select("c_custkey", F.round("xi_upper", 9).alias("xi_upper"))
