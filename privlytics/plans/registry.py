"""All queries of the library by inventory name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from privlytics.functions import national_id, stats, tokens
from privlytics.operators import corpus, metrics, subjects
from privlytics.sources.files import seeded_sample, tail
from privlytics.sources.fixtures import detected, id_docs, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _w(v: str, weights) -> str:
    """SQL: weighted sum of the first digits of ``v``."""
    return "(" + " + ".join(f"CAST(substr({v}, {i + 1}, 1) AS INT) * ({w})" for i, w in enumerate(weights)) + ")"


_WILSON = "CASE WHEN {n} > 0 THEN (({s} * 1.0e0 / {n} + 1.95996e0 * 1.95996e0 / (2.0e0 * {n})) {sign} 1.95996e0 * sqrt(({s} * 1.0e0 / {n}) * (1 - {s} * 1.0e0 / {n}) / {n} + 1.95996e0 * 1.95996e0 / (4.0e0 * {n} * {n}))) / (1 + 1.95996e0 * 1.95996e0 / {n}) ELSE 0 END"


def wilson_sql(s: str, n: str, sign: str) -> str:
    return _WILSON.format(s=s, n=n, sign=sign)


_BODY = "concat(k % 6 + 1, lpad(CAST(k * 7 % 100 AS VARCHAR), 2, '0'), lpad(CAST(k % 12 + 1 AS VARCHAR), 2, '0'), lpad(CAST(k % 28 + 1 AS VARCHAR), 2, '0'), lpad(CAST(k % 46 + 1 AS VARCHAR), 2, '0'), lpad(CAST(k * 13 % 1000 AS VARCHAR), 3, '0'))"
# fixture rows by occurrence, then by detector; dates of the fixture are valid and years are 18yy, 19yy or 20yy
IDS = f"""
f0 AS (SELECT c_custkey AS k, c_name AS name, {_BODY.replace('k ', 'c_custkey ')} AS body FROM customer),
f1 AS (SELECT *, {_w('body', national_id.CNP_WEIGHTS)} % 11 AS r FROM f0),
f2 AS (SELECT k, name, concat(body, CASE WHEN k % 7 = 0 THEN (CASE WHEN r = 10 THEN 1 ELSE r END + 1) % 10 WHEN r = 10 THEN 1 ELSE r END) AS value FROM f1),
occ AS (SELECT k, 'NATIONAL_ID' AS label, value, 4 AS s, 17 AS e, 1 AS nth FROM f2 UNION ALL SELECT k, 'PERSON', name, 23, 23 + length(name), 2 FROM f2 UNION ALL SELECT k, 'NATIONAL_ID', value, length(name) + 30, length(name) + 43, 3 FROM f2 WHERE k % 4 = 0),
det AS (SELECT d.detector, o.*, CASE d.detector WHEN 'full' THEN true WHEN 'none' THEN false WHEN 'third' THEN k % 3 <> 0 ELSE nth < 3 END AS detected FROM occ o, (VALUES ('full'), ('none'), ('third'), ('first')) d(detector)),
sub AS (SELECT detector, k AS doc_id, 'RO' AS country, value, bool_and(detected) AS detected, true AS decode_bearing, CASE WHEN CAST(substr(value, 1, 1) AS INT) % 2 = 1 THEN 'M' ELSE 'F' END AS sex,
  CASE WHEN substr(value, 1, 1) IN ('1', '2') THEN '19' WHEN substr(value, 1, 1) IN ('3', '4') THEN '18' ELSE '20' END || substr(value, 2, 2) || '-' || substr(value, 4, 2) || '-' || substr(value, 6, 2) AS birth_date, substr(value, 8, 2) AS place_code
  FROM det WHERE label = 'NATIONAL_ID' AND k % 7 <> 0 GROUP BY detector, k, value),
per AS (SELECT detector, k AS doc_id, value, bool_and(detected) AS detected FROM det WHERE label = 'PERSON' GROUP BY detector, k, value)
"""


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detected(id_docs(spark, sf_dir))


# --- tokens and sources ----------------------------------------------------------------------------------------------


@query("tok1_whitespace_tokens", r"""
WITH t AS (SELECT item_id, text, regexp_extract_all(text, '[ \n]*[^ \n]+') AS r FROM benchmark),
x AS (SELECT item_id, i AS tok_idx, r[i + 1] AS run, list_sum(list_transform(r[1:i + 1], lambda y: length(y))) AS e FROM (SELECT *, unnest(range(0, len(r))) AS i FROM t))
SELECT item_id, CAST(tok_idx AS INT) AS tok_idx, ltrim(run, chr(10) || ' ') AS tok, CAST(e - length(ltrim(run, chr(10) || ' ')) AS INT) AS s, CAST(e AS INT) AS e FROM x""")
def tok1(spark, sf_dir):
    t = tokens.whitespace_tokens(F.col("text"))
    return read_table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(t).alias("tok_idx", "t")).select("item_id", "tok_idx", "t.tok", "t.s", "t.e")


@query("tok2_token_count", r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[^ \n]+')) AS INT) AS n_tokens FROM documents")
def tok2(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", tokens.token_count(F.col("text")).alias("n_tokens"))


@query("src4_head_per_language", "SELECT lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 20")
def src4(spark, sf_dir):
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))
    return read_table(spark, sf_dir, "documents").select("lang", "doc_id", rank.alias("r")).filter("r <= 20").drop("r")


@query("src3_tail", "SELECT doc_id FROM documents ORDER BY doc_id DESC LIMIT 50")
def src3(spark, sf_dir):
    return tail(read_table(spark, sf_dir, "documents").select("doc_id"), 50, "doc_id")


@query("src6_seeded_sample", "SELECT doc_id FROM documents ORDER BY md5('7' || doc_id), doc_id LIMIT 100")
def src6(spark, sf_dir):
    return seeded_sample(read_table(spark, sf_dir, "documents").select("doc_id"), 100, 7, "doc_id")


# --- validators ------------------------------------------------------------------------------------------------------


def _keys(spark, sf_dir, n: int):
    """Digit strings of length ``n`` from the keys of orders, spread by a multiplication."""
    k = F.col("o_orderkey")
    return read_table(spark, sf_dir, "orders").select(k.alias("k"), F.lpad((k * 7919 * 104729 % 10**n).cast("string"), n, "0").alias("value"))


def _key_sql(n: int) -> str:
    return f"v AS (SELECT o_orderkey AS k, lpad(CAST(o_orderkey * 7919 * 104729 % {10**n} AS VARCHAR), {n}, '0') AS value FROM orders)"


def _date_ok(y: str, m: str, d: str) -> str:
    return f"({m} BETWEEN 1 AND 12 AND {d} >= 1 AND {d} <= CASE WHEN {m} IN (4, 6, 9, 11) THEN 30 WHEN {m} = 2 THEN CASE WHEN {y} % 4 = 0 AND ({y} % 100 <> 0 OR {y} % 400 = 0) THEN 29 ELSE 28 END ELSE 31 END)"


def _n(v: str, a: int, n: int) -> str:
    return f"CAST(substr({v}, {a}, {n}) AS INT)"


_VALID = {
    "NL": (9, f"{_w('value', national_id.BSN_WEIGHTS)} % 11 = 0 AND {_w('value', national_id.BSN_WEIGHTS)} <> 0"),
    "PL": (11, f"(10 - {_w('value', national_id.PESEL_WEIGHTS)} % 10) % 10 = {_n('value', 11, 1)} AND {_date_ok('(CASE ' + _n('value', 3, 2) + ' // 20 WHEN 0 THEN 1900 WHEN 1 THEN 2000 WHEN 2 THEN 2100 WHEN 3 THEN 2200 ELSE 1800 END + ' + _n('value', 1, 2) + ')', '(' + _n('value', 3, 2) + ' % 20)', _n('value', 5, 2))}"),
    "EE": (11, f"{_n('value', 1, 1)} BETWEEN 1 AND 8 AND (CASE WHEN {_w('value', national_id.BALTIC_FIRST)} % 11 < 10 THEN {_w('value', national_id.BALTIC_FIRST)} % 11 WHEN {_w('value', national_id.BALTIC_SECOND)} % 11 < 10 THEN {_w('value', national_id.BALTIC_SECOND)} % 11 ELSE 0 END) = {_n('value', 11, 1)} AND {_date_ok('(1800 + ((' + _n('value', 1, 1) + ' - 1) // 2) * 100 + ' + _n('value', 2, 2) + ')', _n('value', 4, 2), _n('value', 6, 2))}"),
    "SI": (13, f"(CASE WHEN 11 - {_w('value', national_id.EMSO_WEIGHTS)} % 11 >= 10 THEN 0 ELSE 11 - {_w('value', national_id.EMSO_WEIGHTS)} % 11 END) = {_n('value', 13, 1)} AND {_date_ok('(CASE WHEN ' + _n('value', 5, 3) + ' > 800 THEN 1000 ELSE 2000 END + ' + _n('value', 5, 3) + ')', _n('value', 3, 2), _n('value', 1, 2))}"),
    "RO": (13, f"(CASE WHEN {_w('value', national_id.CNP_WEIGHTS)} % 11 = 10 THEN 1 ELSE {_w('value', national_id.CNP_WEIGHTS)} % 11 END) = {_n('value', 13, 1)} AND {_n('value', 1, 1)} <> 0 AND CASE WHEN {_n('value', 1, 1)} > 6 THEN {_n('value', 4, 2)} BETWEEN 1 AND 12 AND {_n('value', 6, 2)} BETWEEN 1 AND 31 ELSE {_date_ok('(CASE (' + _n('value', 1, 1) + ' - 1) // 2 WHEN 0 THEN 1900 WHEN 1 THEN 1800 ELSE 2000 END + ' + _n('value', 2, 2) + ')', _n('value', 4, 2), _n('value', 6, 2))} END"),
}

_LUHN = "(" + " + ".join(f"({_n('value', i, 1)} * 2 - CASE WHEN {_n('value', i, 1)} > 4 THEN 9 ELSE 0 END)" if i % 2 else _n("value", i, 1) for i in range(1, 10)) + ")"
_CZ_MONTH = f"(CASE WHEN {_n('value', 3, 2)} BETWEEN 51 AND 62 THEN {_n('value', 3, 2)} - 50 WHEN {_n('value', 3, 2)} BETWEEN 71 AND 82 THEN {_n('value', 3, 2)} - 70 WHEN {_n('value', 3, 2)} BETWEEN 21 AND 32 THEN {_n('value', 3, 2)} - 20 ELSE {_n('value', 3, 2)} END)"
_VALID |= {
    "FR": (15, "97 - CAST(substr(value, 1, 13) AS BIGINT) % 97 = CAST(substr(value, 14, 2) AS BIGINT)"),
    "SE": (10, f"(10 - {_LUHN} % 10) % 10 = {_n('value', 10, 1)} AND {_n('value', 3, 2)} BETWEEN 1 AND 12 AND ({_n('value', 5, 2)} BETWEEN 1 AND 31 OR {_n('value', 5, 2)} BETWEEN 61 AND 91)"),
    "CZ": (10, f"(CAST(value AS BIGINT) % 11 = 0 OR (CAST(substr(value, 1, 9) AS BIGINT) % 11 = 10 AND {_n('value', 10, 1)} = 0)) AND {_date_ok('(CASE WHEN ' + _n('value', 1, 2) + ' >= 54 THEN 1900 ELSE 2000 END + ' + _n('value', 1, 2) + ')', _CZ_MONTH, _n('value', 5, 2))}"),
    "DK": (10, _date_ok(f"((CASE WHEN {_n('value', 7, 1)} <= 3 THEN 1900 WHEN {_n('value', 7, 1)} IN (4, 9) THEN CASE WHEN {_n('value', 5, 2)} < 37 THEN 2000 ELSE 1900 END WHEN {_n('value', 5, 2)} < 58 THEN 2000 ELSE 1800 END) + {_n('value', 5, 2)})", _n("value", 3, 2), _n("value", 1, 2))),
}


def _validator(cc: str, n: int):
    def run(spark, sf_dir):
        parsed = national_id.PARSERS[cc](F.col("value"))
        return _keys(spark, sf_dir, n).select("k", "value", parsed["valid"].alias("valid"))

    return run


for _cc, (_len, _cond) in _VALID.items():
    query(f"nid_{_cc.lower()}", f"WITH {_key_sql(_len)} SELECT k, value, ({_cond}) AS valid FROM v")(_validator(_cc, _len))


@query("nid_es", f"WITH {_key_sql(8)} SELECT k, value, true AS valid, substr('{national_id.DNI_LETTERS}', CAST(CAST(value AS BIGINT) % 23 AS INT) + 1, 1) AS letter FROM v")
def nid_es(spark, sf_dir):
    letter = F.substr(F.lit(national_id.DNI_LETTERS), (F.col("value").cast("long") % 23 + 1).cast("int"), F.lit(1))
    rows = _keys(spark, sf_dir, 8).withColumn("letter", letter)
    return rows.select("k", "value", national_id.parse_es(F.concat("value", "letter"))["valid"].alias("valid"), "letter")


@query("nid_fi", f"""WITH {_key_sql(9)}, x AS (SELECT k, value AS v, substr('{national_id.HETU_CONTROLS}', CAST(CAST(value AS BIGINT) % 31 AS INT) + 1, 1) AS c, k % 2 = 0 AS ok FROM v)
SELECT k, concat(substr(v, 1, 6), '-', substr(v, 7, 3), CASE WHEN ok THEN c ELSE 'G' END) AS value, ok AND {_date_ok('(1900 + ' + _n('v', 5, 2) + ')', _n('v', 3, 2), _n('v', 1, 2))} AS valid FROM x""")
def nid_fi(spark, sf_dir):
    v = F.col("value")
    control = F.substr(F.lit(national_id.HETU_CONTROLS), (v.cast("long") % 31 + 1).cast("int"), F.lit(1))
    value = F.concat(F.substring(v, 1, 6), F.lit("-"), F.substring(v, 7, 3), F.when(F.col("k") % 2 == 0, control).otherwise("G"))
    rows = _keys(spark, sf_dir, 9).select("k", value.alias("value"))
    return rows.select("k", "value", national_id.parse_fi(F.col("value"))["valid"].alias("valid"))


_CF_INDEX = "CASE WHEN ascii(substr(value, i, 1)) < 58 THEN ascii(substr(value, i, 1)) - 48 ELSE ascii(substr(value, i, 1)) - 65 END"


@query("nid_it", f"""WITH {_key_sql(7)}, x AS (SELECT k, concat('RSSMRA', substr(value, 1, 2), substr('{national_id.CF_MONTHS}', k % 12 + 1, 1), substr(value, 3, 2), 'A', substr(value, 5, 3), chr(CAST(65 + k % 26 AS INT))) AS value, {_n('value', 3, 2)} AS d, k % 12 + 1 AS m FROM v),
t AS (SELECT *, list_sum(list_transform(range(1, 16), lambda i: CASE WHEN i % 2 = 1 THEN {list(national_id.CF_ODD)}[{_CF_INDEX} + 1] ELSE {_CF_INDEX} END)) % 26 AS t FROM x)
SELECT k, value, t = k % 26 AND {_date_ok('2000', 'm', '(CASE WHEN d > 40 THEN d - 40 ELSE d END)')} AS valid FROM t""")
def nid_it(spark, sf_dir):
    last = F.substr(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (F.col("k") % 26 + 1).cast("int"), F.lit(1))
    month = F.substr(F.lit(national_id.CF_MONTHS), (F.col("k") % 12 + 1).cast("int"), F.lit(1))
    value = F.concat(F.lit("RSSMRA"), F.substring("value", 1, 2), month, F.substring("value", 3, 2), F.lit("A"), F.substring("value", 5, 3), last)
    return _keys(spark, sf_dir, 7).select("k", value.alias("value")).select("k", "value", national_id.parse_it(F.col("value"))["valid"].alias("valid"))


@query("nid_de", f"""WITH {_key_sql(11)}, p AS (SELECT k, value, list_reduce(list_prepend(10, list_transform(range(1, 11), lambda i: CAST(substr(value, i, 1) AS BIGINT))), lambda p, d: (CASE WHEN (d + p) % 10 = 0 THEN 10 ELSE (d + p) % 10 END) * 2 % 11) AS p FROM v)
SELECT k, value, substr(value, 1, 1) <> '0' AND (11 - p) % 10 = {_n('value', 11, 1)} AS valid FROM p""")
def nid_de(spark, sf_dir):
    return _keys(spark, sf_dir, 11).select("k", "value", national_id.parse_de(F.col("value"))["valid"].alias("valid"))


# --- subjects and metrics --------------------------------------------------------------------------------------------


@query("sub1_national_id_subjects", f"WITH {IDS} SELECT * FROM sub")
def sub1(spark, sf_dir):
    return subjects.national_id_subjects(_rows(spark, sf_dir))


@query("sub3_person_subjects", f"WITH {IDS} SELECT * FROM per")
def sub3(spark, sf_dir):
    return subjects.person_subjects(_rows(spark, sf_dir))


LEAK = f"SELECT {{by}}, count(*) AS total, count(*) FILTER (detected) AS detected, count(*) FILTER (NOT detected) AS missed, count(*) FILTER (NOT detected) * 1.0e0 / count(*) AS leak_rate, round({wilson_sql('count(*) FILTER (NOT detected)', 'count(*)', '-')}, 12) AS ci_low, round({wilson_sql('count(*) FILTER (NOT detected)', 'count(*)', '+')}, 12) AS ci_high FROM {{src}} GROUP BY {{by}}"


@query("met6_national_id_leakage", f"WITH {IDS} {LEAK.format(by='detector, country', src='sub')}")
def met6(spark, sf_dir):
    return metrics.leak_rates(subjects.national_id_subjects(_rows(spark, sf_dir)), "detector", "country")


@query("met8_name_leakage", f"WITH {IDS} {LEAK.format(by='detector', src='per')}")
def met8(spark, sf_dir):
    return metrics.leak_rates(subjects.person_subjects(_rows(spark, sf_dir)), "detector")


@query("met8_name_context", f"""WITH {IDS}, n AS (SELECT detector, doc_id, bool_or(NOT detected) AS x FROM per GROUP BY ALL), i AS (SELECT detector, doc_id, bool_or(NOT detected) AS y FROM sub GROUP BY ALL)
SELECT detector, count(*) FILTER (x AND y) AS both_leak, count(*) FILTER (x AND NOT y) AS name_only, count(*) FILTER (NOT x AND y) AS id_only, count(*) FILTER (NOT x AND NOT y) AS neither FROM n JOIN i USING (detector, doc_id) GROUP BY detector""")
def met8_context(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return metrics.name_context(subjects.person_subjects(rows), subjects.national_id_subjects(rows))


@query("met1_entity_scores", f"""WITH {IDS}, c AS (SELECT detector, count(*) FILTER (detected) AS tp, count(*) AS n_gold, count(*) FILTER (detected) AS n_pred FROM det GROUP BY detector),
p AS (SELECT *, CASE WHEN n_pred > 0 THEN tp * 1.0e0 / n_pred ELSE 0 END AS precision, tp * 1.0e0 / n_gold AS recall FROM c)
SELECT detector, tp, n_gold, n_pred, precision, recall, 2.0e0 * tp / (n_gold + n_pred) AS f1, CASE WHEN 4 * precision + recall > 0 THEN 5 * precision * recall / (4 * precision + recall) ELSE 0 END AS f2 FROM p""")
def met1(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return metrics.entity_scores(metrics.spans_of(rows, "gold"), metrics.spans_of(rows, "pred"))


@query("met11_k_anonymity", f"""WITH {IDS}, s AS (SELECT count(*) AS c FROM sub WHERE detector = 'none' GROUP BY sex, CAST(substr(birth_date, 1, 4) AS INT) // 5, place_code)
SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS classes, sum(CASE WHEN c = 1 THEN c ELSE 0 END) * 1.0e0 / sum(c) AS k1, sum(CASE WHEN c < 5 THEN c ELSE 0 END) * 1.0e0 / sum(c) AS k_lt5 FROM s""")
def met11(spark, sf_dir):
    rows = subjects.national_id_subjects(_rows(spark, sf_dir)).filter("detector = 'none'")
    return metrics.k_anonymity(rows.withColumn("band", F.floor(F.substring("birth_date", 1, 4).cast("int") / 5)), ["sex", "band", "place_code"])


@query("sig3_mcnemar", f"""WITH {IDS}, p AS (SELECT doc_id, value, bool_or(detected) FILTER (detector = 'first') AS x, bool_or(detected) FILTER (detector = 'third') AS y FROM sub GROUP BY ALL),
n AS (SELECT count(*) FILTER (x AND y) AS n_both, count(*) FILTER (NOT x AND NOT y) AS n_neither, count(*) FILTER (NOT x AND y) AS b, count(*) FILTER (x AND NOT y) AS c FROM p)
SELECT n_both, n_neither, b, c, (abs(b - c) - 1) ** 2 * 1.0e0 / (b + c) AS chi2_cc, least(1.0e0, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2.0e0))))) AS p_value FROM n""")
def sig3(spark, sf_dir):
    return metrics.mcnemar(subjects.national_id_subjects(_rows(spark, sf_dir)), "first", "third")


# --- corpora ---------------------------------------------------------------------------------------------------------


@query("div2_div3_distances", """WITH c AS (SELECT lang AS category, count(*) FILTER (doc_id % 2 = 0) AS a, count(*) FILTER (doc_id % 2 = 1) AS b FROM documents GROUP BY lang),
p AS (SELECT a * 1.0e0 / sum(a) OVER () AS p, b * 1.0e0 / sum(b) OVER () AS q FROM c)
SELECT sum(abs(p - q)) / 2 AS tv, sqrt(greatest(0, sum((CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2))) AS js FROM p""")
def div23(spark, sf_dir):
    side = F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b")
    counts = read_table(spark, sf_dir, "documents").groupBy(side.alias("side"), F.col("lang").alias("category")).agg(F.count("*").alias("n"))
    return corpus.distances(counts)


@query("div4_wasserstein", """WITH c AS (SELECT n_chars AS x, count(*) FILTER (lang = 'en') AS a, count(*) FILTER (lang = 'fr') AS b FROM documents WHERE lang IN ('en', 'fr') GROUP BY n_chars),
f AS (SELECT lead(x) OVER (ORDER BY x) - x AS dx, sum(a) OVER (ORDER BY x) * 1.0e0 / sum(a) OVER () AS f, sum(b) OVER (ORDER BY x) * 1.0e0 / sum(b) OVER () AS g FROM c)
SELECT coalesce(sum(abs(f - g) * dx), 0) AS w1 FROM f""")
def div4(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").filter(F.col("lang").isin("en", "fr"))
    return corpus.wasserstein(docs.select(F.when(F.col("lang") == "en", "a").otherwise("b").alias("side"), F.col("n_chars").alias("x")))


@query("div5_content_hash", """WITH h AS (SELECT sha256(doc_id || chr(9) || text) AS h FROM documents), b AS (SELECT substr(h, 1, 4) AS part, sha256(string_agg(h, '' ORDER BY h)) AS digest FROM h GROUP BY 1)
SELECT sha256(string_agg(digest, '' ORDER BY part)) AS corpus_hash FROM b""")
def div5(spark, sf_dir):
    h = F.sha2(F.concat_ws("\t", F.col("doc_id").cast("string"), "text"), 256)
    return corpus.content_hash(read_table(spark, sf_dir, "documents").select(h.alias("h")))


@query("div6_type_token_ratio", r"""WITH w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM documents)
SELECT lang, count(DISTINCT w) AS types, count(*) AS tokens, count(DISTINCT w) * 1.0e0 / count(*) AS ttr FROM w GROUP BY lang""")
def div6(spark, sf_dir):
    w = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    by = read_table(spark, sf_dir, "documents").select("lang", F.explode_outer(w).alias("w")).filter("w is not null").groupBy("lang", "w").count()
    return by.groupBy("lang").agg(F.count("*").alias("types"), F.sum("count").alias("tokens"), (F.count("*") / F.sum("count").cast("double")).alias("ttr"))


@query("div7_sentence_length_variance", r"""WITH s AS (SELECT lang, unnest(regexp_split_to_array(text, '[.!?\n]+')) AS s FROM documents), n AS (SELECT lang, len(regexp_extract_all(s, '[^ \n]+')) AS n FROM s)
SELECT lang, count(*) AS sentences, round(var_pop(n), 6) AS variance FROM n WHERE n > 0 GROUP BY lang""")
def div7(spark, sf_dir):
    s = read_table(spark, sf_dir, "documents").select("lang", F.explode_outer(F.split("text", r"[.!?\n]+")).alias("s"))
    n = s.select("lang", tokens.token_count(F.col("s")).alias("n")).filter("n > 0")
    return n.groupBy("lang").agg(F.count("*").alias("sentences"), F.round(F.var_pop("n"), 6).alias("variance"))


@query("div10_centroid_distance", """WITH e AS (SELECT label % 2 AS side, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS v FROM embeddings), c AS (SELECT side, i, avg(v) AS m FROM e GROUP BY ALL),
w AS (SELECT i, max(m) FILTER (side = 0) AS a, max(m) FILTER (side = 1) AS b FROM c GROUP BY i) SELECT round(1 - sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))), 6) AS distance FROM w""")
def div10(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings").select((F.col("label") % 2).alias("side"), F.posexplode("embedding").alias("i", "v"))
    w = e.groupBy("i").agg(F.avg(F.when(F.col("side") == 0, F.col("v"))).alias("a"), F.avg(F.when(F.col("side") == 1, F.col("v"))).alias("b"))
    return w.agg(F.round(1 - F.sum(F.col("a") * F.col("b")) / (F.sqrt(F.sum(F.col("a") ** 2)) * F.sqrt(F.sum(F.col("b") ** 2))), 6).alias("distance"))


@query("div9_template_repetition", f"""WITH {IDS}, s AS (SELECT CASE WHEN k % 4 = 0 THEN 'cnp [national_id] name [person] again [national_id]' ELSE 'cnp [national_id] name [person]' END AS sk FROM f2), g AS (SELECT sk, count(*) AS c FROM s GROUP BY sk)
SELECT count(*) * 1.0e0 / sum(c) AS unique_ratio, max(c) * 1.0e0 / sum(c) AS top_share FROM g""")
def div9(spark, sf_dir):
    sk = corpus.label_skeleton(F.col("text"), F.col("gold"))
    g = id_docs(spark, sf_dir).groupBy(sk.alias("sk")).agg(F.count("*").alias("c"))
    return g.agg((F.count("*") / F.sum("c").cast("double")).alias("unique_ratio"), (F.max("c") / F.sum("c").cast("double")).alias("top_share"))


@query("met3_wilson", f"SELECT q.quality, count(*) AS n, CAST(sum(toxic) AS BIGINT) AS s, {wilson_sql('sum(toxic)', 'count(*)', '-')} AS ci_low, {wilson_sql('sum(toxic)', 'count(*)', '+')} AS ci_high FROM labels q GROUP BY q.quality")
def met3(spark, sf_dir):
    g = read_table(spark, sf_dir, "labels").groupBy("quality").agg(F.count("*").alias("n"), F.sum("toxic").alias("s"))
    low, high = stats.wilson(F.col("s"), F.col("n"))
    return g.select("quality", "n", "s", low.alias("ci_low"), high.alias("ci_high"))


@query("boo2_percentiles", "SELECT lang, quantile_cont(n_chars, 0.025) AS p025, quantile_cont(n_chars, 0.975) AS p975 FROM documents GROUP BY lang")
def boo2(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").groupBy("lang").agg(F.percentile("n_chars", F.lit(0.025)).alias("p025"), F.percentile("n_chars", F.lit(0.975)).alias("p975"))


from privlytics.plans import deidentification, evaluation, reports, summaries  # noqa: E402, F401  they register their queries
