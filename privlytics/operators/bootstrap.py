"""Bootstrap intervals.

Rows that have the same counts are exchangeable, so resampling n rows is one multinomial draw over the distinct counts: the
documents are grouped once and never repeated for each replicate. Draws depend on the seed and the counts only, not on partitions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Seed, replicates, and the share outside the interval.
SEED = 20260603
REPLICATES = 10_000
ALPHA = 0.05


def _rng(seed: int, *key) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.sha256(repr((seed, *map(str, key))).encode()).digest()[:8], "big"))


def _bounds(x: np.ndarray, alpha: float, by_index: bool) -> tuple[float, float]:
    """Interpolated percentiles, or those at the indices int(q * B)."""
    if not by_index:
        return tuple(float(v) for v in np.quantile(x, [alpha / 2, 1 - alpha / 2]))
    x = np.sort(x)
    return float(x[int(alpha / 2 * len(x))]), float(x[min(len(x) - 1, int((1 - alpha / 2) * len(x)))])


def rate_gaps(pairs: DataFrame, metric: str = "leak_rate", seed: int = SEED, replicates: int = REPLICATES, alpha: float = ALPHA) -> DataFrame:
    """Gaps of two rates with intervals, for rows (name, detected_a, total_a, detected_b, total_b); an empty side has rate 0.

    Sums of Bernoulli draws are drawn as binomials, so the cost does not depend on the totals.
    """
    if metric not in ("leak_rate", "detection_rate"):
        raise ValueError(f"unknown metric {metric!r}")
    rate = (lambda d, t: d / t if t else d * 0.0) if metric == "detection_rate" else (lambda d, t: (t - d) / t if t else d * 0.0)

    def gaps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                rng = _rng(seed, r.name)
                sides = [(int(r.detected_a), int(r.total_a)), (int(r.detected_b), int(r.total_b))]
                a, b = (rate(rng.binomial(t, d / t if t else 0.0, replicates), t) for d, t in sides)
                low, high = _bounds(a - b, alpha, False)
                pa, pb = (float(rate(d, t)) for d, t in sides)
                out.append((r.name, pa, pb, pa - pb, low, high, low > 0 or high < 0))
            yield pd.DataFrame(out, columns=["name", "rate_a", "rate_b", "gap", "ci_low", "ci_high", "excludes_zero"])

    return pairs.select("name", "detected_a", "total_a", "detected_b", "total_b").mapInPandas(gaps, "name string, rate_a double, rate_b double, gap double, ci_low double, ci_high double, excludes_zero boolean")


def _resampled(rows: DataFrame, by: str, counts: list[str], statistic: Callable[[np.ndarray], np.ndarray], name: str, seed: int, replicates: int, alpha: float) -> DataFrame:
    """Intervals of a statistic of resampled sums; ``statistic`` maps (.., sums of counts) to values.

    One task holds a group's distinct counts, not its rows: these are as many as different combinations of small integers.
    """
    cells = rows.groupBy(by, *counts).agg(F.count("*").alias("n"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(counts)  # draws must not depend on the order of arrival
        x, n = pdf[counts].to_numpy(float), pdf["n"].to_numpy()
        rng = _rng(seed, pdf[by].iloc[0])
        chunk = max(1, 2_000_000 // len(n))
        values = np.concatenate([statistic(rng.multinomial(n.sum(), n / n.sum(), min(chunk, replicates - at)) @ x) for at in range(0, replicates, chunk)])
        low, high = _bounds(values, alpha, True)
        return pd.DataFrame([(pdf[by].iloc[0], int(n.sum()), float(statistic((n @ x)[None])[0]), low, high)], columns=[by, "n", name, "ci_low", "ci_high"])

    return cells.groupBy(by).applyInPandas(one, f"{by} string, n long, {name} double, ci_low double, ci_high double")


def _micro_f1(sums: np.ndarray) -> np.ndarray:
    tp, pred, gold = sums.T
    return np.divide(2 * tp, pred + gold, out=np.zeros(len(tp)), where=pred + gold > 0)


def f1_intervals(docs: DataFrame, by: str = "detector", seed: int = SEED, replicates: int = 1000, alpha: float = ALPHA) -> DataFrame:
    """Micro F1 of (by, tp, n_pred, n_gold), one row per document, with the interval over resampled documents."""
    return _resampled(docs, by, ["tp", "n_pred", "n_gold"], _micro_f1, "f1", seed, replicates, alpha)


def paired_gaps(a: DataFrame, b: DataFrame, key: list[str], by: str = "name", seed: int = SEED, replicates: int = REPLICATES, alpha: float = ALPHA) -> DataFrame:
    """Leak rate of a less that of b over the subjects that both have (by, key.., detected); significant iff the interval lies below 0."""
    both = a.select(by, *key, (~F.col("detected")).cast("int").alias("x")).join(b.select(by, *key, (~F.col("detected")).cast("int").alias("y")).hint("merge"), [by, *key])
    cells = both.select(by, "x", "y", F.lit(1).alias("one"))
    found = _resampled(cells, by, ["x", "y", "one"], lambda s: (s[:, 0] - s[:, 1]) / s[:, 2], "gap", seed, replicates, alpha)
    return found.withColumn("significant", F.col("ci_high") < 0)


def _poisson_weights(ids: np.ndarray, seed: int, replicates: int) -> np.ndarray:
    """(rows, replicates) counts of a Poisson of mean 1, from a hash of row id and replicate."""
    with np.errstate(over="ignore"):
        z = ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(replicates, dtype=np.uint64)[None] * np.uint64(0xD1B54A32D192ED03) + np.uint64(seed)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    cdf = np.cumsum([np.exp(-1.0) / f for f in np.cumprod([1.0, *range(1, 16)])])
    return np.searchsorted(cdf, (z >> np.uint64(11)) * 2.0**-53, side="right")


def centroid_intervals(rows: DataFrame, seed: int = SEED, replicates: int = 1000, alpha: float = ALPHA) -> DataFrame:
    """Cosine distance of the centroids of sides a and b of (id long, side, vec), with its interval: one row.

    Each row has a Poisson count in each replicate; only sums of replicates x dimensions for each partition are shuffled. As a centroid's
    direction does not depend on the number of rows, the counts need not add up to it. Replicate 0 has every row once.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {}
        for batch in batches:
            for side, part in batch.groupby("side"):
                ids, x = part["id"].to_numpy(), np.stack(part["vec"].to_numpy()).astype(float)
                for at in range(0, len(ids), 1024):
                    w = _poisson_weights(ids[at : at + 1024], seed, replicates + 1)
                    w[:, 0] = 1
                    sums[side] = sums.get(side, 0) + w.T @ x[at : at + 1024]
        for side, s in sums.items():
            yield pd.DataFrame({"side": side, "replicate": np.arange(replicates + 1), "sums": list(s)})

    parts = rows.filter("vec is not null").mapInPandas(partial, "side string, replicate int, sums array<double>")
    flat = parts.select("side", "replicate", F.posexplode("sums").alias("i", "v")).groupBy("replicate", "i").agg(F.sum(F.when(F.col("side") == "a", F.col("v"))).alias("a"), F.sum(F.when(F.col("side") == "b", F.col("v"))).alias("b"))
    norm = F.sqrt(F.sum(F.col("a") ** 2)) * F.sqrt(F.sum(F.col("b") ** 2))
    each = flat.groupBy("replicate").agg((1 - F.sum(F.col("a") * F.col("b")) / F.nullif(norm, F.lit(0.0))).alias("d"))
    drawn = F.when(F.col("replicate") > 0, F.col("d"))
    return each.agg(F.max(F.when(F.col("replicate") == 0, F.col("d"))).alias("point"), F.percentile(drawn, F.lit(alpha / 2)).alias("ci_low"), F.percentile(drawn, F.lit(1 - alpha / 2)).alias("ci_high"))
