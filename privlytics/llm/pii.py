"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust a score.

Kinds in order: email, ip, card (Luhn), phone, iban (mod 97), ssn. A proposal that fails its check is dropped. Scores
start from the kind's own value; a context word of the kind in the ``window`` code points before the span raises it,
and an example word lowers it. email, ip, card and phone are kept whatever their score; iban and ssn from ``threshold``
on. Everything is an expression over one row: no shuffle.

The patterns are written so that no text makes them slow: runs are possessive and start only where a run can start.

Cases: null text is empty. Empty text has no spans. Repeated rows each have their result. Columns of the input with the
names of new ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import regex_spans

# Patterns by kind. The possessive forms match what the plain ones match.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
# Score of a confirmed span, and words that make a kind more likely.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.4}
CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile"),
    "iban": ("iban", "account", "bank"),
    "ssn": ("ssn", "social", "security"),
}
EXAMPLE = ("example", "sample", "dummy", "test")
BASE = ("email", "ip", "card", "phone")
SPAN = "array<struct<start:int,end:int,rank:int,kind:string,score:double,value:string>>"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_ok(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(number)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: _luhn_digit(F.substr(number, i, F.lit(1)).cast("int"), F.pmod(n - i, F.lit(2)) == 1))
    return (n > 0) & (F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0)


def _luhn_digit(d: Column, doubled: Column) -> Column:
    return F.when(doubled, F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)).otherwise(d)


def mod97_ok(iban: Column) -> Column:
    """Whether an IBAN (spaces allowed) leaves 1 modulo 97, with letters as 10 to 35 and the first four moved behind."""
    plain = F.replace(iban, F.lit(" "), F.lit(""))
    moved = F.concat(F.substr(plain, F.lit(5), F.length(plain)), F.substr(plain, F.lit(1), F.lit(4)))
    chars = F.filter(F.split(moved, ""), lambda c: c != "")
    step = lambda a, c: F.when(c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(chars, F.lit(0), step) == 1


def _confirmed(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.substr(part(p), F.lit(1), F.lit(3)).cast("int") <= 255))
    if kind == "card":
        return F.length(digits(value)).between(12, 19) & luhn_ok(digits(value))
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    if kind == "iban":
        return F.length(F.replace(value, F.lit(" "), F.lit(""))).between(15, 34) & mod97_ok(value)
    if kind == "ssn":
        return ~F.substr(value, F.lit(1), F.lit(3)).isin("000", "666") & (F.substr(value, F.lit(1), F.lit(1)) != "9") & (F.substr(value, F.lit(5), F.lit(2)) != "00") & (F.substr(value, F.lit(8), F.lit(4)) != "0000")
    return F.lit(True)


def _possible(kind: str, text: Column) -> Column:
    """A cheap condition without which the kind's pattern matches nowhere."""
    if kind == "email":
        return F.contains(text, F.lit("@"))
    if kind == "phone":
        return F.contains(text, F.lit("+"))
    return F.regexp_like(text, F.lit({"ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "iban": r"[A-Z]{2}[0-9]{2}", "ssn": r"-[0-9]{2}-"}[kind]))


def _kind_spans(text: Column, kind: str, window: int) -> Column:
    found = F.when(_possible(kind, text), regex_spans(text, PATTERNS[kind])).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))

    def scored(s: Column) -> Column:
        before = F.lower(F.substr(text, F.greatest(s["start"] + 1 - window, F.lit(1)), F.least(F.lit(window), s["start"])))
        score = F.lit(SCORES[kind]) + F.when(before.rlike("|".join(CONTEXT[kind])), 0.2).otherwise(0.0) - F.when(before.rlike("|".join(EXAMPLE)), 0.2).otherwise(0.0)
        return F.struct(s["start"], s["end"], F.lit([*PATTERNS].index(kind)).alias("rank"), F.lit(kind).alias("kind"), F.least(F.lit(1.0), F.round(score, 2)).alias("score"), s["value"])

    return F.transform(F.filter(found, lambda s: _confirmed(kind, s["value"])), scored).cast(SPAN)


def find_pii(docs: DataFrame, text: str = "text", window: int = 40, threshold: float = 0.5) -> DataFrame:
    """``docs`` with ``pii``: spans sorted by start, then kind (``SPAN``)."""
    source = F.coalesce(F.col(text), F.lit(""))
    spans = F.concat(*[_kind_spans(source, kind, window) for kind in PATTERNS])
    kept = F.filter(spans, lambda s: s["kind"].isin(*BASE) | (s["score"] >= threshold))
    return docs.withColumn("pii", F.array_sort(kept))
