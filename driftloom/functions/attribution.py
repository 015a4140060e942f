"""Which feature drove an alarm: exact shares of a sum of martingales, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shares(logm: Column, undefined: str = "uniform") -> Column:
    """Percent of the summed wealth that each feature's log wealth in the array stands for.

    For an additive game the Shapley value is the feature's own part. If the
    largest entry isn't finite there is nothing to divide: ``undefined`` chooses
    equal shares (``uniform``) or zeros (``zero``).
    """
    if undefined not in ("uniform", "zero"):
        raise ValueError("undefined must be 'uniform' or 'zero'")
    top = F.array_max(logm)
    total = F.aggregate(F.transform(logm, lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x)
    infinite = top.isNull() | F.isnan(top) | (F.abs(top) == F.lit(float("inf")))
    blank = F.lit(100.0) / F.size(logm) if undefined == "uniform" else F.lit(0.0)
    return F.when(infinite, F.transform(logm, lambda _: blank)).otherwise(F.transform(logm, lambda x: F.lit(100.0) * F.exp(x - top) / total))


def driver(logm: Column) -> Column:
    """Index (from 0) of the feature with the largest share; the first of equals."""
    return (F.array_position(logm, F.array_max(logm)) - 1).cast("int")


def wealth(logm: Column) -> Column:
    """A log wealth on the linear scale."""
    return F.exp(logm)
