"""Detection, leak and k-anonymity metrics: integer counts first, one division last."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from privlytics.functions.stats import newcombe, wilson


def spans_of(rows: DataFrame, column: str) -> DataFrame:
    """(detector, doc_id, label, start, end) of an array of spans."""
    # not the bare column: Spark would filter by its size before rows are dealt out, in the task that reads them
    each = F.transform(column, lambda s: F.struct(s["label"].alias("label"), s["start"].alias("start"), s["end"].alias("end")))
    return rows.select("detector", "doc_id", F.explode(each).alias("s")).select("detector", "doc_id", "s.label", "s.start", "s.end")


def entity_scores(gold: DataFrame, pred: DataFrame, by: str = "detector") -> DataFrame:
    """Strict precision, recall, F1 and F2 of entities (by, doc_id, label, start, end), all columns but counts 0 where undefined."""
    key = [by, "doc_id", "label", "start", "end"]
    both = gold.select(*key, F.lit(1).alias("g"), F.lit(0).alias("p")).unionByName(pred.select(*key, F.lit(0).alias("g"), F.lit(1).alias("p")))
    each = both.groupBy(*key).agg(F.max("g").alias("g"), F.max("p").alias("p"))
    n = each.groupBy(by).agg(F.sum(F.col("g") * F.col("p")).alias("tp"), F.sum("g").alias("n_gold"), F.sum("p").alias("n_pred"))
    tp, ng, np_ = (F.col(c).cast("double") for c in ("tp", "n_gold", "n_pred"))
    p, r = F.when(np_ > 0, tp / np_).otherwise(0.0), F.when(ng > 0, tp / ng).otherwise(0.0)
    f1 = F.when(ng + np_ > 0, 2 * tp / (ng + np_)).otherwise(0.0)
    f2 = F.when(4 * p + r > 0, 5 * p * r / (4 * p + r)).otherwise(0.0)
    return n.select(by, "tp", "n_gold", "n_pred", p.alias("precision"), r.alias("recall"), f1.alias("f1"), f2.alias("f2"))


def leak_rates(subjects: DataFrame, *by: str) -> DataFrame:
    """Counts, missed share and its Wilson interval, rounded to 12 digits as its bounds may miss 0 by rounding."""
    n = subjects.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(F.col("detected")).alias("detected"), F.count_if(~F.col("detected")).alias("missed"))
    low, high = wilson(F.col("missed"), F.col("total"))
    return n.select(*by, "total", "detected", "missed", (F.col("missed") / F.col("total").cast("double")).alias("leak_rate"), F.round(low, 12).alias("ci_low"), F.round(high, 12).alias("ci_high"))


def _share(part: str, whole: str):
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole).cast("double")).otherwise(0.0)


def leak_report(subjects: DataFrame, *by: str) -> DataFrame:
    """The whole leak report of national ids (``by``, decode_bearing, detected, qi): ids that give something away apart from those that do not.

    Leak rate and interval are of the decode-bearing ids; coverage-only ids have a detection rate alone. Rates of nothing are 0.
    """
    told, hit = F.col("decode_bearing"), F.col("detected")
    n = subjects.groupBy(*by).agg(
        F.count_if(told).alias("decode_bearing_total"), F.count_if(told & hit).alias("decode_bearing_detected"), F.count_if(told & ~hit).alias("decode_bearing_missed"),
        F.coalesce(F.sum(F.when(told & ~hit, F.col("qi"))), F.lit(0)).cast("long").alias("leaked_quasi_identifiers"), F.count_if(~told).alias("coverage_only_total"), F.count_if(~told & hit).alias("coverage_only_detected"),
    )
    low, high = wilson(F.col("decode_bearing_missed"), F.col("decode_bearing_total"))
    return n.select(
        *by, "decode_bearing_total", "decode_bearing_detected", "decode_bearing_missed", _share("decode_bearing_missed", "decode_bearing_total").alias("leak_rate"),
        F.round(low, 12).alias("leak_rate_ci_low"), F.round(high, 12).alias("leak_rate_ci_high"), _share("decode_bearing_detected", "decode_bearing_total").alias("detection_rate"), "leaked_quasi_identifiers",
        "coverage_only_total", "coverage_only_detected", _share("coverage_only_detected", "coverage_only_total").alias("coverage_only_detection_rate"),
    )


def country_counts(subjects: DataFrame, *by: str) -> DataFrame:
    """Subjects and detected ones of each country, of both kinds of ids."""
    return subjects.groupBy(*by, "country").agg(F.count("*").alias("total"), F.count_if(F.col("detected")).alias("detected"))


def cnp_report(subjects: DataFrame, *by: str) -> DataFrame:
    """The leak report under the names of the Romanian one; ``subjects``: of rows whose country was set to RO."""
    names = {"decode_bearing_total": "cnp_total", "decode_bearing_detected": "cnp_detected", "decode_bearing_missed": "cnp_missed"}
    kept = [*by, *names, "leak_rate", "leak_rate_ci_low", "leak_rate_ci_high", "detection_rate", "leaked_quasi_identifiers"]
    return leak_report(subjects, *by).select(*kept).withColumnsRenamed(names)


def class_sizes(rows: DataFrame, qi: list[str], *by: str) -> DataFrame:
    """The histogram of equivalence classes: how many classes there are of each size (distinctiveness in the sample, not in the population)."""
    return rows.groupBy(*by, *qi).agg(F.count("*").alias("size")).groupBy(*by, "size").agg(F.count("*").alias("classes"))


#: Why there is no k-anonymity to report, and what it is of.
NO_TUPLES = "no tuples are given, and nothing that survives gives any away"
SAMPLE_ONLY = "sample distinctiveness, not population re-identification"


def class_report(rows: DataFrame, qi: list[str], *by: str) -> DataFrame:
    """By ``by``: subjects, classes, shares in classes of one and of fewer than five, and the histogram of sizes, smallest first."""
    of = lambda most: F.coalesce(F.sum(F.when(F.col("size") <= most, F.col("size") * F.col("classes"))), F.lit(0))
    n = F.sum(F.col("size") * F.col("classes"))
    sizes = F.array_sort(F.collect_list(F.struct("size", "classes")))  # different sizes: fewer than the root of twice the subjects
    return class_sizes(rows, qi, *by).groupBy(*by).agg(n.alias("n"), F.sum("classes").alias("n_classes"), (of(1) / n.cast("double")).alias("k1"), (of(4) / n.cast("double")).alias("k_lt5"), sizes.alias("sizes"))


def k_anonymity_violation(rows: DataFrame, residual: DataFrame, given: str = "qi_tuple") -> DataFrame:
    """One row for each detector of ``rows``: whether there are tuples, else why not, and the class report.

    If any row has a tuple of its own (a struct ``given``), all rows count by these, those without as one class. Else the subjects
    (detector, dob_band, sex, nuts2) of ``residual`` count; a detector that leaves none has nothing to report.
    """
    if given in rows.columns and not rows.filter(F.col(given).isNotNull()).isEmpty():
        # as JSON a tuple has its values only, so that an empty one and none at all are the same
        found = class_report(rows.select("detector", F.coalesce(F.to_json(given), F.lit("{}")).alias("qi")), ["qi"], "detector")
    else:
        found = class_report(residual, ["dob_band", "sex", "nuts2"], "detector")
    every = rows.select("detector").distinct().join(found, "detector", "left")
    there = F.col("n").isNotNull()
    return every.select("detector", there.alias("available"), F.when(~there, NO_TUPLES).alias("reason"), F.lit(SAMPLE_ONLY).alias("label"), "n", "n_classes", "k1", "k_lt5", "sizes")


def name_context(persons: DataFrame, ids: DataFrame) -> DataFrame:
    """Per detector, documents with both channels, by whether a name and an id leaked."""
    # counted together and not joined: a join by two keys would deal out again what is dealt by document
    of = lambda df, kind: df.select("detector", "doc_id", F.lit(kind).alias("kind"), (~F.col("detected")).alias("leak"))
    leak = lambda kind: [F.bool_or(F.when(F.col("kind") == kind, F.col("leak"))).alias(kind), F.count_if(F.col("kind") == kind).alias(f"{kind}s")]
    each = of(persons, "name").unionByName(of(ids, "id")).filter("detector is not null and doc_id is not null").groupBy("detector", "doc_id")
    both = each.agg(*leak("name"), *leak("id")).filter("names > 0 and ids > 0")
    n, i = F.col("name"), F.col("id")
    return both.groupBy("detector").agg(F.count_if(n & i).alias("both_leak"), F.count_if(n & ~i).alias("name_only"), F.count_if(~n & i).alias("id_only"), F.count_if(~n & ~i).alias("neither"))


def k_anonymity(rows: DataFrame, qi: list[str]) -> DataFrame:
    """n, classes, share of subjects in classes of one and of fewer than five."""
    sizes = rows.groupBy(*qi).count()
    n = F.sum("count").cast("double")
    return sizes.agg(F.sum("count").alias("n"), F.count("*").alias("classes"), (F.sum(F.when(F.col("count") == 1, F.col("count")).otherwise(0)) / n).alias("k1"), (F.sum(F.when(F.col("count") < 5, F.col("count")).otherwise(0)) / n).alias("k_lt5"))


def detector_gaps(leaks: DataFrame, protector: str, *by: str) -> DataFrame:
    """Each detector's missed share less the protector's (within ``by``); holds iff the interval lies above 0."""
    base = leaks.filter(F.col("detector") == protector).select(*by, F.col("missed").alias("m0"), F.col("total").alias("n0"))
    rest = leaks.filter(F.col("detector") != protector)
    rows = rest.join(base, list(by)) if by else rest.join(F.broadcast(base))  # one row
    gap, low, high = newcombe(F.col("missed"), F.col("total"), F.col("m0"), F.col("n0"))
    return rows.select("detector", *by, gap.alias("gap"), low.alias("ci_low"), high.alias("ci_high"), (low > 0).alias("holds"))


def mcnemar(subjects: DataFrame, a: str, b: str) -> DataFrame:
    from privlytics.functions.stats import binomial_two_sided

    pair = subjects.filter("decode_bearing").groupBy("doc_id", "country", "value").agg(F.max(F.when(F.col("detector") == a, F.col("detected"))).alias("x"), F.max(F.when(F.col("detector") == b, F.col("detected"))).alias("y")).filter("x is not null and y is not null")
    n = pair.agg(F.count_if(F.col("x") & F.col("y")).alias("n_both"), F.count_if(~F.col("x") & ~F.col("y")).alias("n_neither"), F.count_if(~F.col("x") & F.col("y")).alias("b"), F.count_if(F.col("x") & ~F.col("y")).alias("c"))
    chi = F.when(F.col("b") + F.col("c") > 0, (F.abs(F.col("b") - F.col("c")) - 1) ** 2 / (F.col("b") + F.col("c")).cast("double")).otherwise(0.0)
    return n.select("n_both", "n_neither", "b", "c", chi.alias("chi2_cc"), binomial_two_sided(F.col("b"), F.col("c")).alias("p_value"))
