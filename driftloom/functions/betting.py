"""Betting functions on p-values, as column builders, and the log-martingale arithmetic around them.

A betting function maps p in [0, 1] to a non-negative wealth factor g(p) with
integral 1. Each builder returns a function from a column to a column, so a bet
stays inside the generated code; the same object bets on numpy arrays where a
kernel needs it.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: p-values are clipped from below here; the beta bet also from above.
P_FLOOR = 1e-10
#: Wealth factors and accumulated wealth don't fall under this.
LOG_FLOOR = math.log(1e-300)


@dataclass(frozen=True)
class Bet:
    """A betting function in both forms, and what to compare it by."""

    name: str
    params: tuple[float, ...]
    column: Callable[[Column], Column]
    array: Callable[[np.ndarray], np.ndarray]

    def __call__(self, p: Column) -> Column:
        return self.column(p)


def _clip(p: Column) -> Column:
    # Null stays null: greatest and least would skip it.
    return F.when(p.isNotNull(), F.greatest(F.lit(P_FLOOR), F.least(F.lit(1.0), p)))


def power(epsilon: float = 0.7) -> Bet:
    """``epsilon * p ** (epsilon - 1)``, for epsilon strictly between 0 and 1."""
    if not 0.0 < epsilon < 1.0:
        raise ValueError(f"epsilon must lie strictly between 0 and 1, not {epsilon}")
    return Bet(
        "power",
        (epsilon,),
        lambda p: F.lit(epsilon) * F.pow(_clip(p), F.lit(epsilon - 1.0)),
        lambda p: epsilon * np.clip(p, P_FLOOR, 1.0) ** (epsilon - 1.0),
    )


def mixture(weights: tuple[float, ...], epsilons: tuple[float, ...]) -> Bet:
    """A convex combination of power bets; the weights add up to 1."""
    if len(weights) != len(epsilons) or not weights:
        raise ValueError("weights and epsilons must have the same length, at least 1")
    if min(weights) < 0:
        raise ValueError("weights must not be negative")
    if abs(sum(weights) - 1.0) > 1e-9:
        raise ValueError(f"weights must add up to 1, not {sum(weights)}")
    bets = [power(e) for e in epsilons]

    def column(p: Column) -> Column:
        out = F.lit(weights[0]) * bets[0].column(p)
        for w, b in zip(weights[1:], bets[1:]):
            out = out + F.lit(w) * b.column(p)
        return out

    return Bet("mixture", (*weights, *epsilons), column, lambda p: sum(w * b.array(p) for w, b in zip(weights, bets)))


def beta(a: float, b: float) -> Bet:
    """The density of Beta(a, b)."""
    if a <= 0 or b <= 0:
        raise ValueError("both parameters must be positive")
    log_norm = math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)

    def column(p: Column) -> Column:
        q = F.when(p.isNotNull(), F.greatest(F.lit(P_FLOOR), F.least(F.lit(1.0 - P_FLOOR), p)))
        return F.exp(F.lit(a - 1.0) * F.log(q) + F.lit(b - 1.0) * F.log1p(-q) - F.lit(log_norm))

    def array(p: np.ndarray) -> np.ndarray:
        q = np.clip(p, P_FLOOR, 1.0 - P_FLOOR)
        return np.exp((a - 1.0) * np.log(q) + (b - 1.0) * np.log1p(-q) - log_norm)

    return Bet("beta", (a, b), column, array)


def default() -> Bet:
    """Power bets of 0.7, 0.8 and 0.9 in equal parts."""
    return mixture((1 / 3, 1 / 3, 1 / 3), (0.7, 0.8, 0.9))


def custom(name: str, column: Callable[[Column], Column], array: Callable[[np.ndarray], np.ndarray]) -> Bet:
    """A betting function of one's own; ``calibration`` tells whether it is one."""
    return Bet(name, (), column, array)


def calibration(bet: Bet, knots: int = 10_001) -> float:
    """The integral of the bet over [0, 1]; 1 for a fair one.

    Substituting p = u ** 4 tames the pole at 0; the rest is the trapezoid rule.
    """
    u = np.linspace(0.0, 1.0, knots)
    y = bet.array(u**4) * 4.0 * u**3
    return float(np.sum((y[1:] + y[:-1]) * np.diff(u)) / 2.0)


def log_bet(g: Column) -> Column:
    """``ln(max(g, 1e-300))``; null for null."""
    return F.when(g.isNotNull(), F.log(F.greatest(g, F.lit(1e-300))))


def log_sum_exp(values: Column) -> Column:
    """``ln(sum(exp(x)))`` over an array, safe against overflow; the maximum itself if that isn't finite."""
    top = F.array_max(values)
    total = F.aggregate(F.transform(values, lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x)
    infinite = (top == F.lit(float("inf"))) | (top == F.lit(float("-inf")))
    return F.when(infinite, top).otherwise(top + F.log(total))
