"""Corpus comparison: distances of distributions, hashes, diversity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _shares(counts: DataFrame) -> DataFrame:
    """(side, category, n) with sides a and b -> (category, p, q); empty sides are 0."""
    wide = counts.groupBy("category").agg(F.sum(F.when(F.col("side") == "a", F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("side") == "b", F.col("n")).otherwise(0)).alias("b"))
    total = wide.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    rate = lambda x, t: F.when(F.col(t) > 0, F.col(x) / F.col(t).cast("double")).otherwise(0.0)
    return wide.join(F.broadcast(total)).select("category", rate("a", "ta").alias("p"), rate("b", "tb").alias("q"))  # one row


def distances(counts: DataFrame) -> DataFrame:
    """Total variation and Jensen-Shannon distance (base 2)."""
    p, q = F.col("p"), F.col("q")
    m = (p + q) / 2
    part = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    return _shares(counts).agg((F.sum(F.abs(p - q)) / 2).alias("tv"), F.sqrt(F.greatest(F.lit(0.0), F.sum((part(p) + part(q)) / 2))).alias("js"))


def wasserstein(points: DataFrame) -> DataFrame:
    """W1 of two samples (side, x): counted by point first, so the ordered sweep sees each distinct value once."""
    by = points.groupBy("x").agg(F.count_if(F.col("side") == "a").alias("a"), F.count_if(F.col("side") == "b").alias("b"))
    order = Window.orderBy("x")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = by.select((F.lead("x").over(order) - F.col("x")).alias("dx"), (F.sum("a").over(upto) / F.sum("a").over(every).cast("double")).alias("f"), (F.sum("b").over(upto) / F.sum("b").over(every).cast("double")).alias("g"))
    return rows.agg(F.coalesce(F.sum(F.abs(F.col("f") - F.col("g")) * F.col("dx")), F.lit(0.0)).alias("w1"))


def content_hash(hashes: DataFrame, digits: int = 4) -> DataFrame:
    """One digest (corpus_hash) of hex hashes (h), whatever their order: by their first digits, the digest of the digests of each part's sorted hashes.

    16 ** digits parts, so that no task holds all hashes; the last step joins one digest of each part.
    """
    part = hashes.groupBy(F.substring("h", 1, digits).alias("part")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("digest"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "digest"))), lambda d: d["digest"]), "")
    return part.agg(F.sha2(joined, 256).alias("corpus_hash"))


def label_skeleton(text, spans):
    """Text with spans as [LABEL], digits as 0, white space collapsed, lower case; a span before the cursor is skipped."""
    walked = F.aggregate(
        F.array_sort(spans),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when((s["start"] < acc["at"]) | (s["start"] > F.length(text)), acc).otherwise(F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["label"], F.lit("]")).alias("out"))),
        lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text))),
    )
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(walked, "[0-9]", "0"), "[ \t\r\n]+", " ")))
