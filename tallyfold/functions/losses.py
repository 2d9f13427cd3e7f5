"""Losses as aggregates over rows, and their gradients as projections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import EPSILON


def _inside(p: Column) -> Column:
    return F.greatest(F.lit(EPSILON), F.least(F.lit(1 - EPSILON), p))


def bce(y: Column, p: Column) -> Column:
    """Binary cross-entropy of one column, a mean over rows."""
    q = _inside(p)
    return F.sum(-(y * F.ln(q) + (1 - y) * F.ln(1 - q))) / F.count(F.lit(1))


def bce_gradient(y: Column, p: Column, rows: Column) -> Column:
    q = _inside(p)
    return (q - y) / (q * (1 - q) * rows)


def cce(targets: list[Column], predicted: list[Column]) -> Column:
    """Categorical cross-entropy: cells with a positive target only, over the rows."""
    cells = [F.when(t > 0, -t * F.ln(_inside(p))).otherwise(0.0) for t, p in zip(targets, predicted, strict=True)]
    return F.sum(sum(cells[1:], cells[0])) / F.count(F.lit(1))


def half_mse(y: Column, p: Column) -> Column:
    """Half of the mean squared error, as the training loss has it."""
    return F.sum((p - y) * (p - y)) / (2 * F.count(F.lit(1)))


def difference_gradient(y: Column, p: Column, rows: Column) -> Column:
    """Of categorical cross-entropy after softmax, and of the half squared error."""
    return (p - y) / rows


def focal_gradient(y: Column, p: Column, rows: Column, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    """Slope of the focal loss in p; a target of 0 has the mirrored rule with weight 1 - alpha."""
    q = _inside(p)
    one = alpha * (gamma * F.pow(1 - q, F.lit(gamma - 1)) * F.ln(q) - F.pow(1 - q, F.lit(gamma)) / q)
    zero = (1 - alpha) * (F.pow(q, F.lit(gamma)) / (1 - q) - gamma * F.pow(q, F.lit(gamma - 1)) * F.ln(1 - q))
    return F.when(y > 0, one).otherwise(zero) / rows


def focal(y: Column, p: Column, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    q = _inside(p)
    return F.sum(F.when(y > 0, -alpha * F.pow(1 - q, F.lit(gamma)) * F.ln(q)).otherwise(0.0)) / F.count(F.lit(1))
