"""Guarded scalar expressions and activations: Column -> Column, all inside whole-stage code generation."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The guard against division by zero, the exponent range, the configured value range.
EPSILON, EXP_RANGE, VALUE_RANGE = 1e-8, 250.0, (-1e10, 1e10)


def num(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def clamp(x: Column, low: float = VALUE_RANGE[0], high: float = VALUE_RANGE[1]) -> Column:
    """To [low, high]; NaN passes through (Spark orders NaN above all numbers, so it is tested first)."""
    return F.when(F.isnan(x), x).when(x < low, F.lit(low)).when(x > high, F.lit(high)).otherwise(x)


def safe_div(x: Column, y: Column, eps: float = EPSILON) -> Column:
    """x / y, a divisor within eps of 0 replaced by eps with its sign."""
    return x / F.when(F.abs(y) < eps, F.when(y >= 0, F.lit(eps)).otherwise(F.lit(-eps))).otherwise(y)


def safe_sqrt(x: Column) -> Column:
    return F.when(x < 0, F.lit(0.0)).otherwise(F.sqrt(x))


def safe_exp(x: Column) -> Column:
    return F.exp(clamp(x, -EXP_RANGE, EXP_RANGE))


def safe_log(x: Column, eps: float = EPSILON) -> Column:
    return F.ln(F.greatest(x, F.lit(eps)))


def dead_sign(x: Column, eps: float = EPSILON) -> Column:
    return F.when(x > eps, 1.0).when(x < -eps, -1.0).otherwise(0.0)


def is_finite(x: Column) -> Column:
    return ~(F.isnan(x) | (F.abs(x) == math.inf))


def round_to(x: Column, places: int) -> Column:
    """Half away from zero after binary scaling by a power of ten."""
    k = float(10**places)
    return F.signum(x) * F.floor(F.abs(x * k) + 0.5) / k


def sigmoid(x: Column) -> Column:
    return 1 / (1 + safe_exp(-x))


def relu(x: Column) -> Column:
    return F.when(x > 0, x).otherwise(0.0)


def leaky_relu(x: Column, alpha: float = 0.01) -> Column:
    return F.when(x > 0, x).otherwise(alpha * x)


def elu(x: Column, alpha: float = 1.0) -> Column:
    return F.when(x > 0, x).otherwise(alpha * (safe_exp(x) - 1))


def swish(x: Column) -> Column:
    return x * sigmoid(x)


def gelu(x: Column) -> Column:
    return 0.5 * x * (1 + F.tanh(math.sqrt(2 / math.pi) * (x + 0.044715 * x * x * x)))


def linear(x: Column) -> Column:
    return x


def _swish_slope(x: Column) -> Column:
    return sigmoid(x) + x * sigmoid(x) * (1 - sigmoid(x))


def _gelu_slope(x: Column) -> Column:
    c = math.sqrt(2 / math.pi)
    t = F.tanh(c * (x + 0.044715 * x * x * x))
    return 0.5 * (1 + t) + 0.5 * x * (1 - t * t) * c * (1 + 3 * 0.044715 * x * x)


Scalar = Callable[[Column], Column]


class Activations:
    """Activations by name, each with its derivative; users register their own."""

    def __init__(self):
        one, zero = F.lit, lambda: F.lit(0.0)
        self._known: dict[str, tuple[Scalar, Scalar]] = {
            "relu": (relu, lambda x: F.when(x > 0, 1.0).otherwise(0.0)),
            "leaky_relu": (leaky_relu, lambda x: F.when(x > 0, 1.0).otherwise(0.01)),
            "elu": (elu, lambda x: F.when(x > 0, 1.0).otherwise(safe_exp(x))),
            "swish": (swish, _swish_slope),
            "gelu": (gelu, _gelu_slope),
            "sigmoid": (sigmoid, lambda x: sigmoid(x) * (1 - sigmoid(x))),
            "tanh": (F.tanh, lambda x: 1 - F.tanh(x) * F.tanh(x)),
            "linear": (linear, lambda x: one(1.0) + x * zero()),
            "softmax": (linear, lambda x: one(1.0) + x * zero()),  # of one element; a row goes to softmax_row
        }

    def register(self, name: str, value: Scalar, slope: Scalar) -> None:
        self._known[name] = (value, slope)

    def names(self) -> list[str]:
        return sorted(self._known)

    def get(self, name: str) -> tuple[Scalar, Scalar]:
        if name not in self._known:
            raise KeyError(f"unknown activation {name!r}; known: {self.names()}")
        return self._known[name]

    def apply(self, name: str, x: Column) -> Column:
        return self.get(name)[0](x)

    def slope(self, name: str, x: Column, gradient: Column | float = 1.0) -> Column:
        return num(gradient) * self.get(name)[1](x)


def softmax_row(values: Column) -> Column:
    """Of an array, shifted by its maximum; an empty one stays empty."""
    e = F.transform(values, lambda v: F.exp(v - F.array_max(values)))
    return F.get(F.transform(F.array(e), lambda w: F.transform(w, lambda v: v / F.aggregate(w, F.lit(0.0), lambda a, b: a + b))), 0)


def log_sum_exp(values: Column) -> Column:
    """Of an array, shifted by its maximum; of an empty one minus infinity."""
    top = F.array_max(values)
    return F.when(F.size(values) == 0, F.lit(-math.inf)).otherwise(top + F.ln(F.aggregate(values, F.lit(0.0), lambda a, v: a + F.exp(v - top))))
