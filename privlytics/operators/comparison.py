"""Comparison of detectors: verdicts, frontiers, boards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dissociation(gaps: DataFrame, *by: str) -> DataFrame:
    """Whether any detector's gap holds, and how many do, of all."""
    return gaps.groupBy(*by).agg(F.count("*").alias("gaps"), F.count_if("holds").alias("holding"), F.bool_or("holds").alias("holds"))


def verdict(p: Column, alpha: float = 0.05) -> Column:
    return F.when(p < alpha, "significant").otherwise("not significant")


def bad_frontier(points: DataFrame) -> DataFrame:
    """Points (name, f1, leak) that no point of higher f1 matches or beats in leak; one ordered sweep instead of pairs."""
    levels = points.groupBy("f1").agg(F.min("leak").alias("least"))
    above = F.min("least").over(Window.orderBy(F.desc("f1")).rowsBetween(Window.unboundedPreceding, -1))
    beaten = levels.select("f1", above.alias("above"))
    return points.join(beaten, "f1").filter(F.col("above").isNull() | (F.col("above") > F.col("leak"))).select("name", "f1", "leak")


def contrasts(points: DataFrame) -> DataFrame:
    """(role, name): the leader in f1 among leakers, the lowest leak (ties: higher f1), the lowest leak above 0."""
    leaker = points.filter("leak > 0")
    best = lambda df, role, *order: df.orderBy(*order, "name").limit(1).select(F.lit(role).alias("role"), "name")
    return best(leaker, "f1 leader", F.desc("f1")).unionByName(best(points, "lowest leak", "leak", F.desc("f1"))).unionByName(best(leaker, "lowest leak above 0", "leak", F.desc("f1")))


def overlay(old: DataFrame, fresh: DataFrame, *key: str) -> DataFrame:
    """Old rows without those of fresh keys, and the fresh rows."""
    return old.join(fresh.select(*key).distinct(), list(key), "left_anti").unionByName(fresh)


def saturation(scores: DataFrame, limit: float = 0.999) -> DataFrame:
    """By adapter: least, greatest and mean score, and whether it saturates."""
    g = scores.groupBy("adapter").agg(F.min("score").alias("least"), F.max("score").alias("most"), F.round(F.avg("score"), 9).alias("mean"))
    return g.withColumn("saturates", F.col("most") >= limit)


def language_spread(scores: DataFrame, baseline: str = "dummy") -> DataFrame:
    """By language: least and greatest score of (adapter, language, score) and their distance, to four digits; the baseline does not count."""
    g = scores.filter(F.col("adapter") != baseline).groupBy("language").agg(F.min("score").alias("least"), F.max("score").alias("most"))
    return g.select("language", F.round("least", 4).alias("least"), F.round("most", 4).alias("most"), F.round(F.col("most") - F.col("least"), 4).alias("spread"))


def saturation_headline(scores: DataFrame, baseline: str = "dummy", limit: float = 0.999) -> DataFrame:
    """One row: the greatest score of any adapter but the baseline (null without any), and whether the track saturates."""
    g = scores.filter(F.col("adapter") != baseline).agg(F.max("score").alias("most"))
    full = F.coalesce(F.col("most") >= limit, F.lit(False))
    return g.select(F.round("most", 4).alias("most"), full.alias("saturates"), F.when(F.col("most") < limit, "not saturating").otherwise("still saturating").alias("verdict"))


def board(scores: DataFrame) -> DataFrame:
    """(adapter, rank, leak) in ascending order of leak; ties share a rank."""
    return scores.select("adapter", F.rank().over(Window.orderBy("leak")).alias("rank"), "leak")


#: The score to reproduce, how closely, and its provenance.
ANCHOR = {"anchor": 0.415, "tolerance": 0.02, "want_n": 1500, "want_version": "0.2.0"}


def reproduces(f1: Column, n: Column, version: Column, anchor: float = ANCHOR["anchor"], tolerance: float = ANCHOR["tolerance"], want_n: int = ANCHOR["want_n"], want_version: str = ANCHOR["want_version"]) -> Column:
    return F.coalesce((F.abs(f1 - anchor) <= tolerance) & (n == want_n) & (version == want_version), F.lit(False))


def summary(gaps: DataFrame, leaks: DataFrame, protector: str) -> DataFrame:
    """By family: gaps, those that hold, and the protector's counts, upper bound and rate (families in which it was not scored have nulls)."""
    base = leaks.filter(F.col("detector") == protector).select("family", "missed", "total", F.col("ci_high").alias("upper"), "leak_rate")
    return gaps.groupBy("family").agg(F.count("*").alias("gaps"), F.count_if("holds").alias("holding"), F.bool_or("holds").alias("holds")).join(base, "family", "left")


def consolidated(families: DataFrame) -> DataFrame:
    """One row over families: worst upper bound, summed counts, and whether all hold."""
    g = families.agg(F.max("upper").alias("worst_upper"), F.sum("missed").alias("missed"), F.sum("total").alias("total"), F.bool_and("holds").alias("holds"))
    return g.withColumn("leak_rate", F.when(F.col("total") > 0, F.col("missed") / F.col("total").cast("double")).otherwise(0.0))


def common_models(scored: DataFrame) -> DataFrame:
    """(detector, uniform) of detectors scored in every family; uniform iff no family has others."""
    families = scored.agg(F.count_distinct("family").alias("families"))
    each = scored.groupBy("detector").agg(F.count_distinct("family").alias("n")).join(F.broadcast(families))  # one row
    whole = each.agg(F.bool_and(F.col("n") == F.col("families")).alias("uniform"))
    return each.filter("n = families").select("detector").join(F.broadcast(whole))  # one row
