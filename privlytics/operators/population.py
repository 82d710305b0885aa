"""Reference population: a joint distribution fitted to marginals, and how unique its cells make a person."""

from __future__ import annotations

import itertools
from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from privlytics.functions.stats import wilson


def fit_joint(axes: dict[str, list[str]], marginals: list[tuple[list[str], dict[tuple[str, ...], float]]], tolerance: float = 1e-10, sweeps: int = 1000) -> tuple[list[tuple], int]:
    """Iterative proportional fitting from a uniform seed: ([(category, .., p)], sweeps). The cells are the axes' product, whatever the data's size.

    A marginal without a positive total, and marginals that contradict each other, raise ValueError.
    """
    names = list(axes)
    shape = [len(axes[a]) for a in names]
    p = np.full(shape, 1 / np.prod(shape))
    targets = []
    for over, counts in marginals:
        keep = [names.index(a) for a in over]
        want = np.zeros([shape[k] for k in keep])
        for key, n in counts.items():
            want[tuple(axes[a].index(c) for a, c in zip(over, key, strict=True))] = n
        if want.sum() <= 0:
            raise ValueError(f"marginal over {over} has no counts")
        # to the axes' own order, and with ones for the axes that are summed over
        want = np.transpose(want / want.sum(), np.argsort(keep))
        targets.append((tuple(i for i in range(len(shape)) if i not in keep), want.reshape([n if i in keep else 1 for i, n in enumerate(shape)])))
    for sweep in range(1, sweeps + 1):
        for rest, want in targets:
            now = p.sum(axis=rest, keepdims=True)
            p = p * np.divide(want, now, out=np.zeros_like(want), where=now > 0)
        if max(np.abs(p.sum(axis=rest, keepdims=True) - want).max() for rest, want in targets) <= tolerance:
            p = p / p.sum()
            return [(*cell, float(x)) for cell, x in zip(itertools.product(*axes.values()), p.ravel(), strict=True)], sweep
    raise ValueError(f"no fit within {sweeps} sweeps")


@dataclass(frozen=True)
class Joint:
    """A fitted reference population of ``n`` people: ``cells`` are (category of each axis, .., p)."""

    axes: tuple[str, ...]
    cells: list[tuple]
    n: int
    placeholder: bool
    label: str
    sweeps: int

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.cells, ", ".join(f"`{a}` string" for a in self.axes) + ", p double")


def joint_from_spec(spec: Mapping, tolerance: float = 1e-10, sweeps: int = 1000) -> Joint:
    """The joint of a census spec (meta, axes, marginals with counts by ``a|b``); one that does not fit raises ValueError.

    Whatever is not marked as a real census is a placeholder.
    """
    meta = spec["meta"]
    axes = {a: [str(c) for c in spec["axes"][a]] for a in meta["axes"]}
    marginals = [(list(m["axes"]), {tuple(str(k).split("|")): float(n) for k, n in m["counts"].items()}) for m in spec["marginals"]]
    cells, took = fit_joint(axes, marginals, tolerance, sweeps)
    placeholder = bool(meta.get("placeholder")) or not meta.get("is_real_census")
    label = str(meta.get("label") or ("placeholder population: not real census data" if placeholder else ""))
    return Joint(tuple(axes), cells, int(meta["population_total"]), placeholder, label, took)


def read_spec(path: str) -> Joint:
    """The joint of a YAML file."""
    import yaml

    return joint_from_spec(yaml.safe_load(Path(path).read_text(encoding="utf-8")))


def entropy_bits(joint: DataFrame) -> DataFrame:
    return joint.filter("p > 0").agg((-F.sum(F.col("p") * F.log2("p"))).alias("bits"))


def uniqueness(p: Column, n: Column, known: Column) -> Column:
    """Chance that no other of n people shares the cell: null where an axis is missing, 1 for unseen cells."""
    seen = F.coalesce(p, F.lit(0.0))
    return F.when(known, F.when(seen <= 0, 1.0).otherwise(F.pow(1 - seen, F.greatest(n, F.lit(2)) - 1)))


def score_rows(rows: DataFrame, joint: DataFrame, axes: list[str], n: int) -> DataFrame:
    """``rows`` with ``xi``; the joint has one row for each cell of its axes."""
    known = F.lit(True)
    for a in axes:
        known = known & F.col(a).isNotNull()
    return rows.join(joint.select(*axes, "p"), axes, "left").withColumn("xi", uniqueness(F.col("p"), F.lit(n), known)).drop("p")


def purr(scored: DataFrame, tau: float = 0.95) -> DataFrame:
    """Share of scorable rows with xi of tau or more, its interval, and the mean of 1 - xi over these (0 where there are none)."""
    flagged = F.col("xi") >= tau
    g = scored.agg(F.count("xi").alias("scorable"), F.count_if(flagged).alias("flagged"), F.coalesce(F.round(F.avg(F.when(flagged, 1 - F.col("xi"))), 9), F.lit(0.0)).alias("kappa"))
    low, high = wilson(F.col("flagged"), F.col("scorable"))
    rate = F.when(F.col("scorable") > 0, F.col("flagged") / F.col("scorable").cast("double")).otherwise(0.0)
    return g.select("scorable", "flagged", rate.alias("purr"), F.round(low, 12).alias("ci_low"), F.round(high, 12).alias("ci_high"), "kappa")


def in_sample_uniqueness(rows: DataFrame, axes: list[str]) -> DataFrame:
    """Share of rows that are alone in their class; rows without any value do not count."""
    some = rows.filter(F.coalesce(*(F.col(a).cast("string") for a in axes)).isNotNull())
    sizes = some.groupBy(*axes).count()
    return sizes.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"), F.coalesce(F.count_if(F.col("count") == 1) / F.sum("count").cast("double"), F.lit(0.0)).alias("k1"))


def correctness(xi: Column) -> Column:
    return 1 - xi


def delta_purr(baseline: DataFrame, model: DataFrame, tau: float = 0.95) -> DataFrame:
    """Flagged share of the baseline's scored rows, that of the model's, and the difference."""
    both = purr(baseline, tau).select(F.col("purr").alias("baseline_purr")).join(F.broadcast(purr(model, tau).select(F.col("purr").alias("model_purr"))))  # one row each
    return both.withColumn("delta_purr", F.col("baseline_purr") - F.col("model_purr"))


def independent_uniqueness(rows: DataFrame, joint: DataFrame, axes: list[str], n: int) -> DataFrame:
    """``rows`` with ``xi_upper``: uniqueness as if the axes were independent, an upper bound only; null where an axis is missing."""
    p, known, out = F.lit(1.0), F.lit(True), rows
    for a in axes:
        one = joint.groupBy(a).agg(F.sum("p").alias(f"p__{a}"))  # at most the axis' categories
        out = out.join(one, a, "left")
        p, known = p * F.coalesce(F.col(f"p__{a}"), F.lit(0.0)), known & F.col(a).isNotNull()
    return out.withColumn("xi_upper", uniqueness(p, F.lit(n), known)).drop(*(f"p__{a}" for a in axes))


def status(placeholder: bool, label: str = "") -> dict[str, object]:
    """What a figure must carry: reference, and whether it may be reported at all."""
    return {"reference": label, "reported": not placeholder, "status": "placeholder population: not to be reported" if placeholder else "calibrated reference"}
