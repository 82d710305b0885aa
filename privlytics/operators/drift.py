"""Drift between two corpora, and whether a harder one spreads the scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from privlytics.functions.tokens import token_count

from .bootstrap import rate_gaps
from .corpus import distances, wasserstein

#: Clusters, points of the frontier, scale of the divergences.
BINS, GRID, SCALE = 25, 50, 5.0


def clusters(rows: DataFrame, bins: int = BINS, seed: int = 42) -> DataFrame:
    """(side, cluster) of rows (side, vec) by k-means over both sides."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    points = rows.select("side", array_to_vector(F.col("vec").cast("array<double>")).alias("features"))
    return KMeans(k=bins, seed=seed).fit(points).transform(points).select("side", F.col("prediction").alias("cluster"))


def frontier_area(assigned: DataFrame, grid: int = GRID, scale: float = SCALE) -> DataFrame:
    """Area (score) under the divergence frontier of the cluster shares of sides a and b: 1 for equal, near 0 for far apart.

    The frontier has clusters x grid rows, whatever the corpora's size.
    """
    n = assigned.groupBy("cluster").agg(F.count_if(F.col("side") == "a").alias("a"), F.count_if(F.col("side") == "b").alias("b"))
    total = n.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    shares = n.join(F.broadcast(total)).select((F.col("a") / F.col("ta").cast("double")).alias("p"), (F.col("b") / F.col("tb").cast("double")).alias("q"))  # one row
    mixed = shares.select("p", "q", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("g")).withColumn("r", F.greatest(F.col("g") / (grid - 1.0) * F.col("p") + (1 - F.col("g") / (grid - 1.0)) * F.col("q"), F.lit(1e-12)))
    kl = lambda x: F.sum(F.when(F.col(x) > 0, F.col(x) * F.log(F.col(x) / F.col("r"))).otherwise(0.0))
    curve = mixed.groupBy("g").agg(F.exp(-scale * kl("q")).alias("x"), F.exp(-scale * kl("p")).alias("y")).select("x", "y", "g")
    ends = curve.sparkSession.createDataFrame([(0.0, 1.0, -1), (1.0, 0.0, grid)], "x double, y double, g int")
    order = Window.orderBy("x", "g")  # grid + 2 rows
    steps = curve.unionByName(ends).select((F.lead("x").over(order) - F.col("x")).alias("dx"), ((F.lead("y").over(order) + F.col("y")) / 2).alias("h"))
    return steps.agg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.sum(F.col("dx") * F.col("h")))).alias("score"))


def normalized(vec: Column) -> Column:
    """A vector at length 1; one without length stays."""
    size = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))
    return F.when(size > 0, F.transform(vec, lambda v: v / size)).otherwise(F.transform(vec, lambda v: v.cast("double")))


def most_templated(diversity: DataFrame) -> DataFrame:
    """Of (language, side, unique_ratio, top_share, ttr) with sides a and b: how much more templated side a is, highest first by ``place``."""
    side = lambda c, s: F.max(F.when(F.col("side") == s, F.col(c)))
    d = diversity.groupBy("language").agg(*((side(c, "a") - side(c, "b")).alias(c) for c in ("unique_ratio", "top_share", "ttr")))
    scored = d.select("language", (-F.col("unique_ratio")).alias("unique_deficit"), F.col("top_share").alias("top_excess"), (-F.col("ttr")).alias("ttr_deficit"))
    scored = scored.withColumn("score", F.col("unique_deficit") + F.col("top_excess") + F.col("ttr_deficit"))
    return scored.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "language")))


def drift_pairs(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(name, detected_a, total_a, detected_b, total_b, f1_gap) of models with leak counts on both configs."""
    at = lambda config, s: rows.filter(F.col("config") == config).filter("detected is not null").select("name", F.col("detected").alias(f"detected_{s}"), F.col("total").alias(f"total_{s}"), F.col("f1").alias(f"f1_{s}"))
    return at(a, "a").join(at(b, "b"), "name").withColumn("f1_gap", F.col("f1_a") - F.col("f1_b")).drop("f1_a", "f1_b")


def matched_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs with both sides' counts brought to the smaller total, halves rounded to even."""
    n = F.least("total_a", "total_b")
    scaled = lambda s: F.when(F.col(f"total_{s}") > 0, F.bround(F.col(f"detected_{s}") / F.col(f"total_{s}").cast("double") * n).cast("long")).otherwise(F.lit(0).cast("long"))
    return pairs.select("name", scaled("a").alias("detected_a"), n.alias("total_a"), scaled("b").alias("detected_b"), n.alias("total_b"))


def drift_table(rows: DataFrame, a: str, b: str, metric: str = "detection_rate") -> DataFrame:
    pairs = drift_pairs(rows, a, b)
    return rate_gaps(pairs, metric).join(pairs.select("name", "f1_gap"), "name")


def description(docs: DataFrame) -> DataFrame:
    """Of (side, text, labels array<string>) with sides a and b, one row: how far labels and lengths in tokens lie apart. It tells of the corpora, not of models."""
    n_tokens = docs.select("side", token_count(F.col("text")).cast("long").alias("x"))
    labels = docs.select("side", F.explode("labels").alias("category")).groupBy("side", "category").agg(F.count("*").alias("n"))
    mean = lambda s: F.coalesce(F.avg(F.when(F.col("side") == s, F.col("x"))), F.lit(0.0)).alias(f"mean_tokens_{s}")
    means = n_tokens.agg(mean("a"), mean("b"))
    return distances(labels).join(F.broadcast(wasserstein(n_tokens).withColumnRenamed("w1", "w1_tokens"))).join(F.broadcast(means))  # one row each


def headline_text(row) -> str:
    """A row of ``headline`` as a sentence."""
    if not row["models"]:
        return "no models scored on both corpora"
    return f"the detection rate of national ids {row['direction']} by {abs(row['mean_gap']) * 100:.1f} pp on average across {row['models']} models (range {row['least'] * 100:+.1f} to {row['most'] * 100:+.1f} pp)"


def headline(gaps: DataFrame) -> DataFrame:
    """Mean, least and greatest gap over models, and whether side a overstates."""
    g = gaps.agg(F.count("gap").alias("models"), F.round(F.avg("gap"), 9).alias("mean_gap"), F.min("gap").alias("least"), F.max("gap").alias("most"))
    return g.withColumn("direction", F.when(F.col("mean_gap") > 0, "overstates").otherwise("understates"))


def desaturation(templated: DataFrame, diverse: DataFrame, limit: float = 0.999) -> DataFrame:
    """Of (name, f1, ci_high): the drop in f1 and whether the diverse set spreads the scores. A model that has one of them only is in ``desaturation_skips``."""
    both = templated.select("name", F.col("f1").alias("f1_templated")).join(diverse.select("name", F.col("f1").alias("f1_diverse"), "ci_high"), "name")
    drop = F.round(F.col("f1_templated") - F.col("f1_diverse"), 4)
    return both.select("name", "f1_templated", "f1_diverse", drop.alias("drop"), ((F.col("ci_high") < limit) & (F.col("f1_diverse") < F.col("f1_templated"))).alias("desaturates"))


def desaturation_skips(templated: DataFrame, diverse: DataFrame) -> DataFrame:
    """(name, skipped) of models that ``desaturation`` leaves out or cannot compare: which of the two results, or its f1, is missing."""
    at = lambda rows, s: rows.groupBy("name").agg(F.max("f1").alias(s))
    every = at(templated, "t").join(at(diverse, "d"), "name", "full")
    missing = F.concat_ws(", ", F.when(F.col("t").isNull(), "no templated result"), F.when(F.col("d").isNull(), "no diverse result"))
    return every.select("name", missing.alias("skipped")).filter("skipped <> ''")


def residual_bounds(rows: DataFrame) -> DataFrame:
    """Rows (detector, .., gold, pred) of two detectors: ``null`` finds nothing, ``perfect`` finds the gold."""
    kinds = F.array(F.struct(F.lit("null").alias("detector"), F.slice("gold", 1, 0).alias("pred")), F.struct(F.lit("perfect").alias("detector"), F.col("gold").alias("pred")))
    return rows.withColumn("d", F.explode(kinds)).select("*", "d.detector", "d.pred").drop("d")
