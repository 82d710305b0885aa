"""Masking and what survives it, as expressions over one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tokens import SPACE, blanks

#: The mask sign and the words that count as masks.
MASK = "█"
MASK_WORDS = ("REDACTED", "MASK", "MASKED", "PII", "ANONYMIZED", "HIDDEN", "REMOVED")


def mask_spans(text: Column, spans: Column) -> Column:
    """``text`` with one sign for each run of overlapping or touching spans."""
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("any"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        joined = acc["any"] & (s["start"] <= acc["at"])
        gap = F.substr(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        out = F.when(joined, acc["out"]).otherwise(F.concat(acc["out"], gap, F.lit(MASK)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.lit(True).alias("any"), out.alias("out"))

    return F.aggregate(F.array_sort(spans), start, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text))))


def value_survives(redacted: Column, value: Column, k: int = 4) -> Column:
    """Whether ``k`` signs in a row of ``value`` (all, if fewer) are in ``redacted``; white space does not count."""
    hay, v = (F.regexp_replace(c, f"[{SPACE}]+", "") for c in (redacted, value))
    size = F.least(F.lit(k), F.length(v))
    windows = F.transform(F.sequence(F.lit(1), F.length(v) - size + 1), lambda i: F.substr(v, i.cast("int"), size))
    return F.when(F.length(v) > 0, F.exists(windows, lambda w: F.contains(hay, w))).otherwise(False)


def is_mask(token: Column) -> Column:
    core = F.regexp_replace(token, r"^[\[\](){}<>]+|[\[\](){}<>]+$", "")
    return F.upper(core).isin(*MASK_WORDS) | core.rlike(f"^{MASK}+$") | core.rlike(r"^[*#_xX-]{2,}$")


def words(text: Column) -> Column:
    return F.regexp_extract_all(blanks(text), F.lit("[^ ]+"), F.lit(0))
