"""Evaluation of detectors by named metrics, and the jobs of a suite."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from privlytics.operators import anonymization, detectors, metrics, subjects
from privlytics.sources.files import Spec, json_lines
from privlytics.sources.fixtures import SPANS


def _entities(rows: DataFrame) -> DataFrame:
    """Scores over labels that the gold has; predictions of other labels do not count."""
    gold = metrics.spans_of(rows, "gold")
    return metrics.entity_scores(gold, metrics.spans_of(rows, "pred").join(F.broadcast(gold.select("label").distinct()), "label", "left_semi"))  # labels of the taxonomy


def _redaction(rows: DataFrame) -> DataFrame:
    docs = rows.select("doc_id", "country", "gold").dropDuplicates(["doc_id"])
    return metrics.leak_rates(anonymization.survivors(subjects.quasi_identifier_subjects(docs), anonymization.anonymize(rows)), "detector")


def membership_inference(rows: DataFrame) -> DataFrame:
    """Needs a trained model's losses; it is named so that a spec asking for it fails loudly."""
    raise NotImplementedError("membership inference needs a target model")


#: Metrics of rows (detector, doc_id, country, text, gold, pred) by the task they belong to.
DETECTION: dict[str, Callable[[DataFrame], DataFrame]] = {
    "entity_f1": _entities,
    "entity_f2": _entities,
    "national_id_leakage": lambda rows: metrics.leak_rates(subjects.national_id_subjects(rows), "detector"),
    "name_leakage": lambda rows: metrics.leak_rates(subjects.person_subjects(rows), "detector"),
}
ANONYMIZATION: dict[str, Callable[[DataFrame], DataFrame]] = {
    "redaction_leakage": _redaction,
    "information_retention": lambda rows: anonymization.information_retention(rows.select("doc_id", "text", "gold").dropDuplicates(["doc_id"]), anonymization.anonymize(rows)),
    "structural_disruption": lambda rows: anonymization.structural_disruption(rows.select("doc_id", "text").dropDuplicates(["doc_id"]), anonymization.anonymize(rows)),
    "detection_recall": lambda rows: _entities(rows).select("detector", "recall", "f2"),
}
LEAKAGE: dict[str, Callable[[DataFrame], DataFrame]] = {
    "k_anonymity_violation": lambda rows: metrics.k_anonymity_violation(rows, subjects.residual_rows(rows)),
    "membership_inference": membership_inference,
}
ALL_METRICS = DETECTION | ANONYMIZATION | LEAKAGE


def track_drivers(rows: DataFrame) -> DataFrame:
    """All detectors of a track at once: f1, leak rate, missed and all ids that give something away, and what the missed ones give away."""
    told = metrics.leak_report(subjects.with_disclosed(subjects.national_id_subjects(rows)), "detector")
    leak = told.select("detector", "leak_rate", F.col("decode_bearing_missed").alias("missed"), F.col("decode_bearing_total").alias("total"), F.col("leaked_quasi_identifiers").alias("leaked_qi"))
    return _entities(rows).select("detector", "f1", "f2").join(leak, "detector", "left")


def evaluate(rows: DataFrame, names: tuple[str, ...]) -> dict[str, DataFrame]:
    """Results by metric; an unknown name raises KeyError before anything runs."""
    if unknown := [n for n in names if n not in ALL_METRICS]:
        raise KeyError(f"unknown metric {', '.join(unknown)}")
    return {n: ALL_METRICS[n](rows) for n in names}


def run_suite(spark: SparkSession, specs: list[Spec], found: list, load: Callable[[SparkSession, Spec], DataFrame]) -> tuple[dict[str, dict[str, DataFrame]], list[str]]:
    """(results by spec and metric, skipped specs): all detectors of a spec are one job. Only datasets that aren't there are skipped.

    ``load`` gives (doc_id, country, text, gold) of a spec. Anonymisation specs get the detection recall as well.
    """
    done, skipped = {}, []
    for spec in specs:
        try:
            docs = load(spark, spec)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            skipped.append(spec.name)
            continue
        names = (*spec.metrics, "detection_recall") if spec.task == "anonymization" else spec.metrics
        done[spec.name] = evaluate(detectors.detect_all(docs, found), tuple(dict.fromkeys(names)))
    return done, skipped


def load_lines(spark: SparkSession, spec: Spec) -> DataFrame:
    """(doc_id, country, text, gold) of the JSON lines that a spec's dataset names by ``path``; rows without a country are RO."""
    rows = json_lines(spark, spec.dataset["path"], "doc_id", "text", "spans", schema="doc_id long, country string, text string, spans array<struct<start:int,end:int,label:string>>")
    value = lambda s: F.substr(F.col("text"), s["start"] + 1, s["end"] - s["start"])
    gold = F.transform(F.coalesce("spans", F.array()), lambda s: F.struct(s["start"], s["end"], s["label"], value(s).alias("value")))
    return rows.select("doc_id", F.coalesce(F.upper("country"), F.lit("RO")).alias("country"), "text", gold.cast(SPANS).alias("gold"))


def suite_rows(spark: SparkSession, specs: list[Spec], found: list, load: Callable[[SparkSession, Spec], DataFrame] = load_lines) -> tuple[DataFrame | None, list[str]]:
    """(rows of a board, skipped specs): one row for each spec and detector, the detectors of a spec as one job; no rows without any data."""
    rows, skipped = None, []
    for spec in specs:
        try:
            docs = load(spark, spec)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            skipped.append(spec.name)
            continue
        scores = track_drivers(detectors.detect_all(docs, found)).withColumnRenamed("detector", "adapter")
        one = scores.select("adapter", F.col("adapter").alias("model_id"), F.lit(spec.name).alias("spec"), F.lit(spec.dataset.get("config", spec.name)).alias("config"), "f1", "f2", "leak_rate", "missed", "total", "leaked_qi")
        rows = one if rows is None else rows.unionByName(one)
    return rows, skipped
