"""Values that are worked out once for each row, whatever uses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value bound to a variable: an expression that names it thirty times holds it once, so plans stay small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
