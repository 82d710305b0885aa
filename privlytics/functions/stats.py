"""Interval estimates and exact tests as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the quantile, as far as it is to be written out.
Z = 1.95996


def wilson(successes: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval; (0, 0) where n is not positive."""
    n = n.cast("double")
    p = successes / n
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, centre - half).otherwise(0.0), F.when(n > 0, centre + half).otherwise(0.0)


def newcombe(s1: Column, n1: Column, s2: Column, n2: Column) -> tuple[Column, Column, Column]:
    """(difference, low, high) of two proportions, from their Wilson intervals; all 0 where an arm is empty."""
    (l1, u1), (l2, u2) = wilson(s1, n1), wilson(s2, n2)
    p1, p2 = s1 / n1.cast("double"), s2 / n2.cast("double")
    full = (n1 > 0) & (n2 > 0)
    low = (p1 - p2) - F.sqrt((p1 - l1) ** 2 + (u2 - p2) ** 2)
    high = (p1 - p2) + F.sqrt((u1 - p1) ** 2 + (p2 - l2) ** 2)
    return tuple(F.when(full, c).otherwise(0.0) for c in (p1 - p2, low, high))


def binomial_two_sided(b: Column, c: Column) -> Column:
    """Exact two-sided p of b against c at even odds: twice the lower tail, 1 at most and where both are 0."""
    n, k = (b + c).cast("int"), F.least(b, c).cast("int")
    logs = F.aggregate(
        F.sequence(F.lit(0), k),
        F.struct(F.lit(0.0).alias("log"), F.lit(0.0).alias("sum")),
        lambda acc, i: F.struct(
            (acc["log"] + F.when(i > 0, F.log((n - i + 1) / F.greatest(i, F.lit(1)).cast("double"))).otherwise(0.0)).alias("log"),
            (acc["sum"] + F.exp(acc["log"] + F.when(i > 0, F.log((n - i + 1) / F.greatest(i, F.lit(1)).cast("double"))).otherwise(0.0) - n * F.log(F.lit(2.0)))).alias("sum"),
        ),
        lambda acc: acc["sum"],
    )
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * logs))
