"""Secret scans with corpus-wide ownership frequency.

Base kinds (assign, access, hex) are found by their patterns and always kept. Further candidates (bearer: prefixed
service tokens; opaque: long mixed runs) are kept only if the corpus says that they are owner-specific. Candidate hashes
are aggregated over the whole corpus: in how many repositories (documents) and by how many owners (sources) each occurs.
A value seen with at least ``example_owners`` owners, or in at least ``example_repos`` repositories whoever owns them, is
an ``example``, copied widely; any other is ``live``.

Hashes are counted in two steps, by (hash, owner) and then by hash, so a value in a third of all rows is pre-aggregated
in every task; verdicts go back to the candidates by broadcast if they are few, else by (hash, salt).

Cases: null text is empty. Null repository or owner: counted as one more of each. Repeated rows: each has its result and
they count as one repository. Very long texts are read whole; the patterns are possessive, so their time grows with the
text. Columns of the input with the names of new ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, broadcast_if_small, materialize, regex_spans

# Patterns by kind, in order.
ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = {
    "assign": ASSIGN,
    "access": r"AKIA[A-Z0-9]{12,}+",
    "hex": r"[0-9a-f]{32,}+",
    "bearer": r"(?<![A-Za-z0-9_])(?:gh[pousr]_|sk-|xox[abp]-|AIza)[A-Za-z0-9_-]{20,}+",
    "opaque": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9a-z+/_-]*+[A-Z])(?=[0-9A-Z+/_-]*+[a-z])[A-Za-z0-9+/_-]{24,}+",
}
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
BASE = ("assign", "access", "hex")
SPAN = "array<struct<start:int,end:int,rank:int,kind:string,hash:bigint>>"
SALTS = 16


def _possible(kind: str, text: Column) -> Column:
    if kind == "assign":
        low = F.lower(text)
        out = F.contains(low, F.lit(KEYWORDS[0]))
        for word in KEYWORDS[1:]:
            out = out | F.contains(low, F.lit(word))
        return out
    if kind == "access":
        return F.contains(text, F.lit("AKIA"))
    if kind == "bearer":
        return F.contains(text, F.lit("_")) | F.contains(text, F.lit("-")) | F.contains(text, F.lit("AIza"))
    if kind == "hex":
        return F.regexp_like(text, F.lit("[0-9a-f]{32}"))
    return F.regexp_like(text, F.lit("[A-Za-z0-9+/_-]{24}"))


def candidates(text: Column) -> Column:
    """All candidate spans of a text, in the order of the kinds; ``hash``: of the value itself, without its keyword."""
    return F.concat(*(_kind_spans(text, kind, rank) for rank, kind in enumerate(PATTERNS)))


def _kind_spans(text: Column, kind: str, rank: int) -> Column:
    def value(s: Column) -> Column:
        return F.regexp_extract(s["value"], ASSIGN, 1) if kind == "assign" else s["value"]

    found = regex_spans(text, PATTERNS[kind])
    if kind == "assign":
        found = F.filter(found, lambda s: F.length(value(s)) >= 8)
    spans = F.transform(found, lambda s: F.struct(s["start"], s["end"], F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), F.xxhash64(value(s)).alias("hash")))
    return F.when(_possible(kind, text), spans.cast(SPAN)).otherwise(F.array().cast(SPAN))


def scan_secrets(docs: DataFrame, repo: str = "doc_id", owner: str = "source", text: str = "text", example_owners: int = 3, example_repos: int = 50) -> DataFrame:
    """(``repo``, row_hash, secrets): one row for each different (repository, text) with candidates.

    ``secrets``: array<struct<start,end,rank,kind,label>> sorted by start, then kind; label: live or example.
    Added kinds inside a span of a base kind, and added examples, are left out.
    """
    source = F.coalesce(F.col(text), F.lit(""))
    found = docs.select(F.col(repo).alias("repo"), F.col(owner).alias("owner"), F.xxhash64(source).alias("row_hash"), candidates(source).alias("spans")).filter(F.size("spans") > 0)
    found = materialize(found, "secret-candidates")
    spans = found.select("repo", "owner", "row_hash", F.explode("spans").alias("s"))
    by_owner = spans.select(F.col("s.hash").alias("hash"), "owner", "repo").groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one")).groupBy("hash", "owner").agg(F.count("*").alias("repos"))
    counts = by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))
    copied = (F.col("owners") >= example_owners) | (F.col("repos") >= example_repos)
    verdicts = materialize(counts.select("hash", "owners", "repos", F.when(copied, "example").otherwise("live").alias("label")), "secret-verdicts")
    spans = spans.withColumn("hash", F.col("s.hash"))
    if verdicts.count() * 64 <= BROADCAST_BYTES:
        labelled = spans.join(F.broadcast(verdicts.select("hash", "label")), "hash")
    else:
        salted = verdicts.select("hash", "label", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        labelled = spans.withColumn("salt", F.pmod(F.xxhash64("repo", "s.start"), F.lit(SALTS)).cast("int")).join(salted, ["hash", "salt"])
    one = F.struct(F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.rank").alias("rank"), F.col("s.kind").alias("kind"), "label")
    rows = labelled.groupBy("repo", "row_hash").agg(F.array_sort(F.collect_set(one)).alias("secrets"))
    base = lambda s: s["kind"].isin(*BASE)
    inside = lambda s: F.exists(F.filter("secrets", base), lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"]))
    return materialize(rows.withColumnRenamed("repo", repo), "secret-rows").withColumn("secrets", F.filter("secrets", lambda s: base(s) | ((s["label"] == "live") & ~inside(s))))


def join_secrets(docs: DataFrame, secrets: DataFrame, repo: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with their ``secrets`` (empty where there are none)."""
    found = broadcast_if_small(secrets.select(F.col(repo).alias("_repo"), F.col("row_hash").alias("_hash"), "secrets"), 48 + 48 * F.size("secrets"), 16 << 20)
    # the hash is a column before the join, so that texts are only moved where they are asked for
    base = docs.drop("secrets").withColumn("_mine", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    joined = base.join(found, base[repo].eqNullSafe(F.col("_repo")) & (F.col("_mine") == F.col("_hash")), "left")
    empty = F.array().cast("array<struct<start:int,end:int,rank:int,kind:string,label:string>>")
    return joined.drop("_repo", "_hash", "_mine").withColumn("secrets", F.coalesce("secrets", empty))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with sorted spans replaced; overlapping ones once."""
    walked = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, walked).otherwise(text)
