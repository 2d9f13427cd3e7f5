"""Layers besides the dense one, over rows (row_id, values).

Statistics over rows are one aggregate and the layer a projection; layers of a single row are array expressions.  Only
recurrent, convolution and attention layers, whose weights are dense matrices, run in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .networks import VALUE
from .stats import require

Weights = dict[str, np.ndarray]


def initial(shape: tuple[int, int], kind: str = "xavier_uniform", seed: int = 42) -> np.ndarray:
    """Weights (inputs, outputs); an unknown ``kind`` is xavier_uniform."""
    rng, (n, m) = np.random.default_rng(seed), shape
    if kind == "zeros":
        return np.zeros(shape)
    if kind == "random_normal":
        return rng.normal(0, 0.01, shape)
    fan = n if kind.startswith("he") else (n + m) / 2
    scale = np.sqrt((2.0 if kind.startswith("he") else 1.0) / fan)
    return rng.normal(0, scale, shape) if kind.endswith("_normal") else rng.uniform(-1, 1, shape) * scale * np.sqrt(3)


def dropout_mask(key: Column, j: Column, rate: float, seed: int) -> Column:
    """1 / (1 - rate) where a cell stays, else 0: the first 32 bits of an md5 of seed, row and column decide."""
    require(0 <= rate < 1, "a dropout rate is in [0, 1)")
    u = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(seed), key, j)), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    return F.when(u >= rate, F.lit(1 / (1 - rate))).otherwise(F.lit(0.0))


def dropout(a: DataFrame, rate: float, seed: int = 42, training: bool = True) -> DataFrame:
    """Inverted dropout.  The mask depends on row and column alone, so the backward pass is this on the gradients."""
    require(0 <= rate < 1, "a dropout rate is in [0, 1)")
    if not training or rate == 0:
        return a
    return a.withColumn("values", F.transform("values", lambda v, j: v * dropout_mask(F.col("row_id"), j, rate, seed)))


@dataclass
class BatchNorm:
    """Mean and population variance of each position over all rows; running ones with ``momentum``."""

    momentum: float = 0.9
    epsilon: float = 1e-5
    mean: list[float] | None = None
    var: list[float] | None = None

    def fit(self, a: DataFrame) -> BatchNorm:
        """One more batch: moments of (position, value), combined before the shuffle."""
        cells = a.select(F.posexplode("values").alias("j", "v"))
        found = sorted(cells.groupBy("j").agg(F.avg("v").alias("m"), F.var_pop("v").alias("s")).collect())  # one row a position
        m, s = [r["m"] for r in found], [r["s"] for r in found]
        if self.mean is None:
            self.mean, self.var = m, s
        else:
            require(len(m) == len(self.mean), f"{len(self.mean)} positions were fitted, not {len(m)}")
            self.mean = [self.momentum * x + (1 - self.momentum) * y for x, y in zip(self.mean, m, strict=True)]
            self.var = [self.momentum * x + (1 - self.momentum) * y for x, y in zip(self.var, s, strict=True)]
        return self

    def transform(self, a: DataFrame, gamma: float = 1.0, beta: float = 0.0) -> DataFrame:
        require(self.mean is not None, "fit comes first")
        m, d = (F.array(*map(F.lit, x)) for x in (self.mean, [float(np.sqrt(v + self.epsilon)) for v in self.var]))
        return a.withColumn("values", F.transform("values", lambda v, j: (v - F.get(m, j)) / F.get(d, j) * gamma + beta))


def layer_norm(a: DataFrame, gamma: float = 1.0, beta: float = 0.0, epsilon: float = 1e-5) -> DataFrame:
    """Each row less its mean, over its population deviation."""

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)

    n = F.size("values")
    centred = a.withColumn("_m", total(F.col("values")) / n).withColumn("values", F.transform("values", lambda v: v - F.col("_m")))
    scaled = centred.withColumn("_m", F.sqrt(total(F.transform("values", lambda v: v * v)) / n + epsilon))
    return scaled.withColumn("values", F.transform("values", lambda v: v / F.col("_m") * gamma + beta)).drop("_m")


def max_pool(a: DataFrame, size: int = 2) -> DataFrame:
    """Maximum of each ``size`` neighbours; a shorter rest at the end is left out."""
    require(size > 0, "a pool has a size")
    starts = F.when(F.size("values") >= size, F.sequence(F.lit(0), F.floor(F.size("values") / size).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return a.withColumn("values", F.transform(starts, lambda k: F.array_max(F.slice("values", k * size + 1, F.lit(size)))))


def max_pool2d(a: DataFrame, height: int, width: int, size: int = 2) -> DataFrame:
    """Maximum of each square of an image kept row by row; rests at the right and bottom are left out."""
    h, w = height // size, width // size
    require(h > 0 and w > 0, "the image is smaller than the pool")
    cells = [[(y * size + i) * width + x * size + j for i in range(size) for j in range(size)] for y in range(h) for x in range(w)]
    at = F.array(*(F.array(*map(F.lit, c)) for c in cells))
    return a.withColumn("values", F.transform(at, lambda c: F.array_max(F.transform(c, lambda k: F.get("values", k)))))


def mapped(a: DataFrame, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``f`` on the matrix of each Arrow batch; other columns stay.  Rows must be equally long."""
    at = a.columns.index("values")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                out = f(np.stack(b["values"].to_numpy()).astype(float))
                yield b.drop(columns="values").assign(values=list(out))[list(b.columns)]

    kinds = [f"`{c}` {'array<double>' if k == at else t}" for k, (c, t) in enumerate(a.dtypes)]
    return a.mapInPandas(run, ", ".join(kinds))


def convolve2d(x: np.ndarray, kernels: np.ndarray, bias: np.ndarray, height: int, width: int, stride: int = 1, pad: int = 0) -> np.ndarray:
    """(rows, filters * out_h * out_w) from rows of (channels, height, width); ``kernels`` is (filters, channels, k, k)."""
    channels, k = kernels.shape[1], kernels.shape[2]
    image = np.pad(x.reshape(len(x), channels, height, width), ((0, 0), (0, 0), (pad, pad), (pad, pad)))
    windows = np.lib.stride_tricks.sliding_window_view(image, (k, k), axis=(2, 3))[:, :, ::stride, ::stride]
    return (np.einsum("nchwij,fcij->nfhw", windows, kernels) + bias[None, :, None, None]).reshape(len(x), -1)


def conv2d(a: DataFrame, kernels: np.ndarray, bias: np.ndarray, height: int, width: int, stride: int = 1, pad: int = 0, activation: str = "linear") -> DataFrame:
    require(stride > 0 and min(height, width) + 2 * pad >= kernels.shape[2], "the kernel does not fit the image")
    return mapped(a, lambda x: VALUE[activation](convolve2d(x, kernels, bias, height, width, stride, pad)))


def gates(units: int, width: int, count: int, seed: int = 42) -> Weights:
    """Weights of ``count`` gates: w for the inputs, u for the state, b (zero)."""
    return {"w": initial((width, count * units), seed=seed), "u": initial((units, count * units), seed=seed + 1), "b": np.zeros(count * units)}


def lstm_steps(x: np.ndarray, p: Weights) -> np.ndarray:
    """Last state of (rows, steps, width); gates stand in the order input, forget, cell, output."""
    units = len(p["u"])
    h = c = np.zeros((len(x), units))
    for t in range(x.shape[1]):
        i, f, g, o = np.split(x[:, t] @ p["w"] + h @ p["u"] + p["b"], 4, axis=1)
        c = VALUE["sigmoid"](f) * c + VALUE["sigmoid"](i) * np.tanh(g)
        h = VALUE["sigmoid"](o) * np.tanh(c)
    return h


def gru_steps(x: np.ndarray, p: Weights) -> np.ndarray:
    """Last state of (rows, steps, width); gates stand in the order update, reset, candidate."""
    n = len(p["u"])
    h = np.zeros((len(x), n))
    for t in range(x.shape[1]):
        a, s = x[:, t] @ p["w"] + p["b"], h @ p["u"][:, : 2 * n]
        z, r = VALUE["sigmoid"](a[:, :n] + s[:, :n]), VALUE["sigmoid"](a[:, n : 2 * n] + s[:, n:])
        h = (1 - z) * np.tanh(a[:, 2 * n :] + (r * h) @ p["u"][:, 2 * n :]) + z * h
    return h


def recurrent(a: DataFrame, steps: int, p: Weights, kind: str = "lstm") -> DataFrame:
    """A row's ``values`` are ``steps`` vectors one after another; the result is the last state."""
    f = {"lstm": lstm_steps, "gru": gru_steps}[kind]
    return mapped(a, lambda x: f(x.reshape(len(x), steps, -1), p))


def attention(x: np.ndarray, p: Weights, heads: int) -> np.ndarray:
    """Scaled dot-product self-attention of (rows, steps, width) with weights q, k, v, o."""
    rows, steps, width = x.shape
    require(width % heads == 0, "the width is a multiple of the heads")
    q, k, v = ((x @ p[n]).reshape(rows, steps, heads, -1).transpose(0, 2, 1, 3) for n in "qkv")
    s = q @ k.transpose(0, 1, 3, 2) / np.sqrt(width // heads)
    e = np.exp(s - s.max(-1, keepdims=True))
    return ((e / e.sum(-1, keepdims=True)) @ v).transpose(0, 2, 1, 3).reshape(rows, steps, width) @ p["o"]


def normal_rows(x: np.ndarray, epsilon: float = 1e-5) -> np.ndarray:
    return (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + epsilon)


def transformer_weights(width: int, hidden: int, seed: int = 42) -> Weights:
    own = {n: initial((width, width), seed=seed + k) for k, n in enumerate("qkvo")}
    return own | {"up": initial((width, hidden), "he_normal", seed + 4), "down": initial((hidden, width), seed=seed + 5)}


def transformer_block(x: np.ndarray, p: Weights, heads: int) -> np.ndarray:
    """Attention, then two dense layers, each added to its input and normalised."""
    x = normal_rows(x + attention(x, p, heads))
    return normal_rows(x + VALUE["relu"](x @ p["up"]) @ p["down"])


def transformer(a: DataFrame, steps: int, blocks: list[Weights], heads: int = 1) -> DataFrame:
    """A row is one sequence of ``steps`` vectors, bounded by what a row holds; all blocks run on it in turn."""

    def f(x: np.ndarray) -> np.ndarray:
        out = x.reshape(len(x), steps, -1)
        for p in blocks:
            out = transformer_block(out, p, heads)
        return out.reshape(len(x), -1)

    return mapped(a, f)


def chain(a: DataFrame, *layers: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A functional model: layers applied in turn, one lazy plan."""
    for f in layers:
        a = f(a)
    return a
