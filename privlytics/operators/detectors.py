"""Detectors: a common surface, simple ones, and the scores of their spans."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from privlytics.functions.redaction import mask_spans
from privlytics.functions.tags import SPAN, entity_tags
from privlytics.functions.taxonomy import mapped_entities
from privlytics.functions.tokens import whitespace_tokens

from .anonymization import surrogate_maps


class Detector(Protocol):
    """(doc_id, text, ..) -> the same rows with ``pred``, an array of (start, end, label)."""

    name: str

    def detect(self, docs: DataFrame) -> DataFrame: ...


class Surface:
    """What every detector offers besides ``detect``."""

    name: str

    def detect(self, docs: DataFrame) -> DataFrame:
        raise NotImplementedError

    def predict_tags(self, docs: DataFrame) -> DataFrame:
        """``docs`` with ``tags``, one for each token."""
        found = self.detect(docs)
        return found.withColumn("tags", entity_tags(whitespace_tokens(F.col("text")), F.col("pred")))

    def anonymize(self, docs: DataFrame) -> DataFrame:
        return redact(self.detect(docs))

    def pseudonymize(self, docs: DataFrame) -> DataFrame:
        """``docs`` (doc_id, text, ..) with ``surrogates``, a map of the values found in each document; an empty one where there are none."""
        maps = surrogate_maps(mentions(self.detect(docs)))
        none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
        return docs.join(maps, "doc_id", "left").withColumn("surrogates", F.coalesce("surrogates", none))

    def classify(self, docs: DataFrame) -> DataFrame:
        raise NotImplementedError(f"{self.name} does not classify")

    def leakage_probe(self, docs: DataFrame) -> DataFrame:
        raise NotImplementedError(f"{self.name} is not probed for leakage")


class Expression(Surface):
    """A detector whose spans are an expression over ``text``, with labels of a scheme or harmonised ones."""

    def __init__(self, name: str, spans: Callable[[Column], Column], scheme: str | None = None):
        self.name, self._spans, self._scheme = name, spans, scheme

    def detect(self, docs: DataFrame) -> DataFrame:
        found = self._spans(F.col("text"))
        return docs.withColumn("pred", mapped_entities(found, self._scheme) if self._scheme else found.cast(f"array<{SPAN}>"))


class Batched(Surface):
    """A detector that a Python model backs: ``load()`` is called once for each task and maps a list of texts to lists of spans."""

    def __init__(self, name: str, load: Callable[[], Callable], scheme: str | None = None, batch: int = 32):
        self.name, self._load, self._scheme, self._batch = name, load, scheme, batch

    def detect(self, docs: DataFrame) -> DataFrame:
        load, size = self._load, self._batch

        @F.pandas_udf(f"array<{SPAN}>")
        def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for texts in batches:
                clean = texts.fillna("").tolist()
                found = [s for at in range(0, len(clean), size) for s in model(clean[at : at + size])]
                yield pd.Series([[{"start": int(a), "end": int(b), "label": c} for a, b, c in s] for s in found])

        found = docs.withColumn("pred", spans("text"))
        return found.withColumn("pred", mapped_entities(F.col("pred"), self._scheme)) if self._scheme else found


#: Finds nothing.
DUMMY = Expression("dummy", lambda text: F.array().cast(f"array<{SPAN}>"))


_BUILDERS: dict[str, Callable[[], Detector]] = {"dummy": lambda: DUMMY}


def register(name: str, builder: Callable[[], Detector]) -> None:
    """Make a detector known by name; it is built when it is asked for, so that its packages are needed only then."""
    _BUILDERS[name] = builder


def known() -> list[str]:
    return sorted(_BUILDERS)


def build(name: str) -> Detector:
    """A detector by name; an unknown one raises KeyError."""
    if name not in _BUILDERS:
        raise KeyError(f"unknown detector {name!r}, known: {', '.join(known())}")
    return _BUILDERS[name]()


def mentions(found: DataFrame) -> DataFrame:
    """(doc_id, pos, label, value) of predicted spans, with values as they stand in the text."""
    s = found.select("doc_id", "text", F.explode("pred").alias("s"))
    return s.select("doc_id", F.col("s.start").alias("pos"), "s.label", F.substr("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("value"))


def detect_all(docs: DataFrame, detectors: list) -> DataFrame:
    """Rows by detector: all detectors on one track in one job."""
    parts = [d.detect(docs).withColumn("detector", F.lit(d.name)) for d in detectors]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def redact(found: DataFrame) -> DataFrame:
    """Rows with ``redacted``, the text with predicted spans masked."""
    return found.withColumn("redacted", mask_spans(F.col("text"), F.col("pred")))


def span_scores(spans: Column, pieces: Column) -> Column:
    """Spans with ``score``: the mean over pieces (start, end, label, score) that touch the span under its label, 0 without any."""

    def scored(s: Column) -> Column:
        own = F.filter(pieces, lambda p: (p["start"] < s["end"]) & (p["end"] > s["start"]) & (p["label"] == s["label"]))
        total = F.aggregate(own, F.lit(0.0), lambda acc, p: acc + p["score"].cast("double"))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"), F.when(F.size(own) > 0, total / F.size(own)).otherwise(0.0).alias("score"))

    return F.transform(spans, scored)
