"""Subjects: what identifies a person in a document, once per document, detected only if every occurrence is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from privlytics.functions.bind import once
from privlytics.functions.national_id import DECODE_BEARING, disclosed, parse, parse_ro
from privlytics.functions.quasi import county_nuts2, dob_band
from privlytics.functions.tokens import blanks, strip, whitespace_tokens


def occurrences(rows: DataFrame) -> DataFrame:
    """One row for each gold span of (detector, doc_id, country, text, gold, pred): detected iff a token in it is predicted.

    Rows that have ``tokens`` (those of the text) are not split again for each detector.
    """
    tokens = F.col("tokens") if "tokens" in rows.columns else whitespace_tokens(F.col("text"))
    touch = lambda t, s: (t["s"] < s["end"]) & (t["e"] > s["start"])
    hit = F.filter(tokens, lambda t: F.exists("pred", lambda p: touch(t, p)))
    # one expression under the generator: as a column of its own the hits would be worked out again for each span
    found = once(hit, lambda h: F.transform("gold", lambda g: F.struct(g["label"].alias("label"), g["value"].alias("value"), F.exists(h, lambda t: touch(t, g)).alias("detected"))))
    return rows.select("detector", "doc_id", "country", F.explode(found).alias("g")).select("detector", "doc_id", "country", "g.label", "g.value", "g.detected")


def national_id_subjects(rows: DataFrame) -> DataFrame:
    """(detector, doc_id, country, value, detected, decode_bearing, sex, birth_date, place_code) of valid ids."""
    all_of = occurrences(rows).withColumn("value", strip(F.col("value"))).groupBy("detector", "doc_id", "country", "value").agg(F.bool_and("detected").alias("detected"))
    # a generator of one row: the long expression is evaluated once and not repeated in the filter and each field
    parsed = all_of.withColumn("id", F.explode_outer(F.array(parse(F.col("country"), F.col("value"))))).filter("id.valid")
    return parsed.select("detector", "doc_id", "country", "value", "detected", F.col("country").isin(*DECODE_BEARING).alias("decode_bearing"), "id.sex", "id.birth_date", "id.place_code")


def with_disclosed(subjects: DataFrame) -> DataFrame:
    """Subjects with ``qi``: how many quasi-identifiers the id gives away."""
    return subjects.withColumn("qi", disclosed(F.struct(F.lit(True).alias("valid"), "sex", "birth_date", "place_code"), F.col("country")))


def person_subjects(rows: DataFrame) -> DataFrame:
    value = F.trim(F.regexp_replace(blanks(F.col("value")), " +", " "))
    names = occurrences(rows).filter("label = 'PERSON'").withColumn("value", value).filter("value <> ''")
    return names.groupBy("detector", "doc_id", "value").agg(F.bool_and("detected").alias("detected"))


def quasi_identifier_subjects(docs: DataFrame) -> DataFrame:
    """(doc_id, country, value, sex, birth_date, place_code) of valid gold ids that disclose something; no predictions are needed."""
    one = docs.select("doc_id", "country", F.explode("gold").alias("g")).select("doc_id", "country", strip(F.col("g.value")).alias("value")).distinct()
    told = one.filter(F.col("country").isin(*DECODE_BEARING))
    parsed = told.withColumn("id", F.explode_outer(F.array(parse(F.col("country"), F.col("value"))))).filter("id.valid")
    return parsed.select("doc_id", "country", "value", "id.sex", "id.birth_date", "id.place_code")


def entity_subjects(spans: DataFrame) -> DataFrame:
    """Of occurrences (detector, doc_id, entity_id, identifier_type, detected): direct and quasi ones by entity."""
    kind = F.upper("identifier_type")
    known = spans.withColumn("identifier_type", kind).filter(F.col("identifier_type").isin("DIRECT", "QUASI") & F.col("entity_id").isNotNull())
    return known.groupBy("detector", "doc_id", "entity_id", "identifier_type").agg(F.bool_and("detected").alias("detected"))


def residual_rows(rows: DataFrame) -> DataFrame:
    """(detector, doc_id, value, dob_band, sex, nuts2) of national ids of which any occurrence survived."""
    found = occurrences(rows).filter("label = 'NATIONAL_ID'").withColumn("value", strip(F.col("value")))
    left = found.groupBy("detector", "doc_id", "value").agg(F.bool_or(~F.col("detected")).alias("survived")).filter("survived")
    parsed = left.withColumn("id", F.explode_outer(F.array(parse_ro(F.col("value"))))).filter("id.valid")
    return parsed.select("detector", "doc_id", "value", dob_band(F.col("id.birth_date")).alias("dob_band"), "id.sex", county_nuts2(F.col("id.place_code")).alias("nuts2"))
