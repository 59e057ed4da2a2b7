"""Column functions for scores: caps, bands, guarded ratios and half-even rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def capped(value: Column, weight: float, cap: float) -> Column:
    return F.least(value * F.lit(float(weight)), F.lit(float(cap)))


def clamp(value: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value))


def ratio(part: Column, whole: Column, missing: float | None = None) -> Column:
    """part / whole; ``missing`` (null unless given) where whole is 0 or null."""
    out = F.try_divide(part.cast("double"), whole.cast("double"))
    return out if missing is None else F.coalesce(out, F.lit(float(missing)))


def band(value: Column, bounds: list[tuple[float, str]], otherwise: str) -> Column:
    """The label of the first bound that the value reaches; bounds in falling order. Null stays null."""
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for bound, label in bounds:
        out = out.when(value >= bound, label)
    return out.otherwise(otherwise)


def compare(actual: Column, operator: Column, expected: Column) -> Column:
    """Whether actual meets expected by the operator in a column; null if actual is unknown."""
    return (
        F.when(operator == ">=", actual >= expected)
        .when(operator == "<=", actual <= expected)
        .when(operator == ">", actual > expected)
        .when(operator == "<", actual < expected)
        .when(operator == "==", actual == expected)
        .when(operator == "!=", actual != expected)
    )
