"""Dense networks: layers, optimizers, schedules and a training loop of partial gradients.

An epoch is a pass of ``mapInPandas`` that returns one gradient a batch of rows; the driver adds them up and steps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checks import check_training
from .prep import batches, split
from .stats import require
from .tables import written
from .training import Callback, train

#: Gradients of partitions that the driver adds up itself.
FEW = 64
VALUE: dict[str, Callable] = {
    "relu": lambda z: np.maximum(z, 0),
    "sigmoid": lambda z: 1 / (1 + np.exp(-np.clip(z, -250, 250))),
    "tanh": np.tanh,
    "linear": lambda z: z,
    "softmax": lambda z: (e := np.exp(z - z.max(1, keepdims=True))) / e.sum(1, keepdims=True),
}
SLOPE: dict[str, Callable] = {
    "relu": lambda z, a: (z > 0).astype(float),
    "sigmoid": lambda z, a: a * (1 - a),
    "tanh": lambda z, a: 1 - a * a,
    "linear": lambda z, a: np.ones_like(z),
    "softmax": lambda z, a: np.ones_like(z),  # with categorical cross-entropy: the gradient is p - t
}


@dataclass
class SGD:
    rate: float = 0.01
    momentum: float = 0.0
    nesterov: bool = False
    decay: float = 0.0
    _v: dict = field(default_factory=dict)

    def __post_init__(self):
        require(self.rate > 0 and 0 <= self.momentum < 1 and self.decay >= 0 and (self.momentum > 0 or not self.nesterov), "options of SGD out of range")

    def step(self, name, w, g):
        g = g + self.decay * w
        v = self._v[name] = self.momentum * self._v.get(name, 0) + g
        return w - self.rate * (g + self.momentum * v if self.nesterov else v)


@dataclass
class RMSprop:
    rate: float = 0.001
    rho: float = 0.9
    eps: float = 1e-8
    centred: bool = False
    momentum: float = 0.0
    decay: float = 0.0
    _s: dict = field(default_factory=dict)
    _m: dict = field(default_factory=dict)
    _v: dict = field(default_factory=dict)

    def __post_init__(self):
        require(self.rate > 0 and 0 <= self.rho < 1 and 0 <= self.momentum < 1 and self.eps > 0 and self.decay >= 0, "options of RMSprop out of range")

    def step(self, name, w, g):
        g = g + self.decay * w
        s = self._s[name] = self.rho * self._s.get(name, 0) + (1 - self.rho) * g * g
        m = self._m[name] = self.rho * self._m.get(name, 0) + (1 - self.rho) * g if self.centred else 0.0
        v = self._v[name] = self.momentum * self._v.get(name, 0) + g / (np.sqrt(np.maximum(s - np.square(m), 0)) + self.eps)
        return w - self.rate * v


@dataclass
class Adam:
    rate: float = 0.001
    beta1: float = 0.9
    beta2: float = 0.999
    eps: float = 1e-8
    decay: float = 0.0
    amsgrad: bool = False
    #: Weight decay apart from the gradient (AdamW), instead of added to it.
    decoupled: bool = False
    _t: dict = field(default_factory=dict)

    def __post_init__(self):
        require(0 <= self.beta1 <= 0.999 and 0 <= self.beta2 <= 0.999, "betas must be in [0, 0.999]")

    def step(self, name, w, g):
        g = g if self.decoupled else g + self.decay * w
        t, m, v, top = self._t.get(name, (0, 0.0, 0.0, 0.0))
        t, m, v = t + 1, self.beta1 * m + (1 - self.beta1) * g, self.beta2 * v + (1 - self.beta2) * g * g
        top = np.maximum(top, v) if self.amsgrad else v
        self._t[name] = (t, m, v, top)
        out = w - self.rate * (m / (1 - self.beta1**t)) / (np.sqrt(top / (1 - self.beta2**t)) + self.eps)
        out = out - self.rate * self.decay * w if self.decoupled else out
        require(bool(np.isfinite(out).all()), "a weight is not finite")
        return out


def set_rate(optimizer, rate: float) -> None:
    require(rate > 0, "a learning rate is positive")
    optimizer.rate = rate


def clipped(grads: dict, most: float) -> dict:
    """Scaled down together so that their global norm is at most ``most``."""
    norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
    return {k: g * (most / norm) for k, g in grads.items()} if norm > most else grads


def step_decay(rate: float, epoch: int, drop: float = 0.5, every: int = 10) -> float:
    return rate * drop ** (epoch // every)


@dataclass
class EarlyStopping:
    patience: int = 5
    least: float = 0.0
    best: float = np.inf
    waited: int = 0

    def __call__(self, loss: float) -> bool:
        if loss < self.best - self.least:
            self.best, self.waited = loss, 0
        else:
            self.waited += 1
        return self.waited >= self.patience


@dataclass
class Sequential:
    """Dense layers (units, activation); losses: bce, cce, mse (half)."""

    layers: list[tuple[int, str]]
    loss: str = "mse"
    seed: int = 42
    weights: dict = field(default_factory=dict)
    history: list = field(default_factory=list)

    def build(self, width: int) -> Sequential:
        rng = np.random.default_rng(self.seed)
        for k, (units, name) in enumerate(self.layers):
            require(name in VALUE, f"unknown activation {name!r}")
            scale = np.sqrt((2.0 if name == "relu" else 1.0) / width)
            self.weights[f"w{k}"], self.weights[f"b{k}"] = rng.normal(0, scale, (width, units)), np.zeros(units)
            width = units
        return self

    def forward(self, x: np.ndarray, weights: dict | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        weights, out = weights or self.weights, []
        for k, (_, name) in enumerate(self.layers):
            z = x @ weights[f"w{k}"] + weights[f"b{k}"]
            x = VALUE[name](z)
            out.append((z, x))
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray, weights: dict) -> tuple[float, dict]:
        """(sum of losses, sums of gradients) over the rows."""
        passes = self.forward(x, weights)
        p = passes[-1][1]
        q = np.clip(p, 1e-8, 1 - 1e-8)
        if self.loss == "bce":
            loss, d = -(y * np.log(q) + (1 - y) * np.log(1 - q)).sum(), (q - y) / (q * (1 - q))
        elif self.loss == "cce":
            loss, d = -(y * np.log(q)).sum(), p - y
        else:
            loss, d = ((p - y) ** 2).sum() / 2, p - y
        out = {}
        for k in range(len(self.layers) - 1, -1, -1):
            z, a = passes[k]
            d = d * SLOPE[self.layers[k][1]](z, a)
            below = passes[k - 1][1] if k else x
            out[f"w{k}"], out[f"b{k}"] = below.T @ d, d.sum(0)
            d = d @ weights[f"w{k}"].T
        return float(loss), out

    def add(self, units: int, activation: str) -> Sequential:
        """A layer more, before the weights are built."""
        require(not self.weights, "the weights are built already")
        require(units > 0 and activation in VALUE, f"no such layer: {units}, {activation!r}")
        self.layers.append((units, activation))
        return self

    def compile(self, optimizer, loss: str) -> Sequential:
        require(bool(self.layers), "a model needs a layer")
        require(loss in ("bce", "cce", "mse"), f"unknown loss {loss!r}")
        self.optimizer, self.loss = optimizer, loss
        return self

    def step(self, rows: DataFrame, optimizer, clip: float = 0.0) -> float:
        """One update by the mean gradient of ``rows``; their mean loss before it."""
        loss, grads = self.mean_gradient(rows)
        grads = clipped(grads, clip) if clip else grads
        self.weights = {k: optimizer.step(k, w, grads[k]) for k, w in self.weights.items()}
        return loss

    def mean_gradient(self, rows: DataFrame) -> tuple[float, dict]:
        """Partitions sum their gradients, beyond FEW 16 groups of them theirs, and the driver those: its share doesn't grow."""
        import pickle

        features, targets, weights, own = self.features, self.targets, self.weights, Sequential(self.layers, self.loss)

        def summed(bodies) -> dict:
            total: dict = {}
            for body in bodies:
                for k, v in pickle.loads(body).items():
                    total[k] = total.get(k, 0) + v
            return total

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            n, loss, total = 0, 0.0, None
            for b in batches:
                one, g = own.gradients(b[features].to_numpy(float), b[targets].to_numpy(float), weights)
                n, loss = n + len(b), loss + one
                total = g if total is None else {k: total[k] + v for k, v in g.items()}
            if n:
                yield pd.DataFrame({"n": [n], "loss": [loss], "body": [pickle.dumps(total)]})

        def group(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"n": [int(pdf["n"].sum())], "loss": [float(pdf["loss"].sum())], "body": [pickle.dumps(summed(pdf["body"]))]})

        schema = "n long, loss double, body binary"
        parts = rows.select(*features, *targets).mapInPandas(part, schema)
        if parts.rdd.getNumPartitions() > FEW:
            parts = parts.groupBy(F.pmod(F.spark_partition_id(), F.lit(16)).alias("_g")).applyInPandas(group, schema)
        found = parts.collect()  # FEW rows at most
        n = sum(r["n"] for r in found)
        require(n > 0, "no row to learn from")
        return sum(r["loss"] for r in found) / n, {k: v / n for k, v in summed(r["body"] for r in found).items()}

    def mean_loss(self, rows: DataFrame) -> float:
        return self.mean_gradient(rows)[0]

    def fit(
        self, df: DataFrame, features: list[str], targets: list[str], epochs: int = 10, optimizer=None, stop: Callable[[float], bool] | None = None, clip: float = 0.0,
        key: str | None = None, batch_size: int | None = None, validation: float = 0.0, callbacks: tuple = (),
    ) -> Sequential:
        """Epochs of one full-batch step, or with ``batch_size`` of a step a batch of rows in the order of ``key``.

        ``validation`` keeps the last share by ``key`` for a loss after each epoch (``val_loss``), which then decides on stopping.
        A step is a job, so batches should be large; ``callbacks`` get the losses as in training.train.
        """
        check_training({"epochs": epochs, "validation": validation} | ({"batch_size": batch_size} if batch_size is not None else {}))
        require(key is not None or not (batch_size or validation), "batches and validation need a key")
        optimizer = optimizer or getattr(self, "optimizer", None) or Adam()
        self.features, self.targets = features, targets
        if not self.weights:
            self.build(len(features))
        held = None
        if validation:
            df = written(split(df, key, validation))
            df, held = df.where(~F.col("is_test")), df.where("is_test")
        parts = [df]
        if batch_size:
            dealt = written(batches(df.select(key, *features, *targets), key, batch_size))
            parts = [dealt.where(F.col("batch") == k) for k in range(-(-dealt.count() // batch_size))]
        self.val_history: list[float] = []

        def epoch(_: int) -> dict[str, float]:
            losses = []
            for k, rows in enumerate(parts):
                for c in callbacks:
                    c.batch_begin(k)
                losses.append(self.step(rows, optimizer, clip))
                for c in callbacks:
                    c.batch_end(k, {"loss": losses[-1]})
            self.history.append(sum(losses) / len(losses))
            logs = {"loss": self.history[-1]}
            if held is not None:
                self.val_history.append(self.mean_loss(held))
                logs["val_loss"] = self.val_history[-1]
            return logs

        class Stop(Callback):
            def epoch_end(self, _: int, logs: dict[str, float]) -> bool:
                return bool(stop and stop(logs.get("val_loss", logs["loss"])))

        train(epoch, epochs, [*callbacks, Stop()])
        return self

    def easy_fit(self, df: DataFrame, key: str, features: list[str], targets: list[str]) -> Sequential:
        """Ten epochs, batches of a tenth of the rows (four at least)."""
        return self.fit(df, features, targets, epochs=10, key=key, batch_size=max(4, -(-df.count() // 10)))

    def predict(self, df: DataFrame, prefix: str = "p") -> DataFrame:
        weights, own, features = self.weights, Sequential(self.layers, self.loss), self.features
        units = self.layers[-1][0]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = own.forward(b[features].to_numpy(float), weights)[-1][1]
                yield b.assign(**{f"{prefix}{k}": out[:, k] for k in range(units)})

        return df.mapInPandas(run, ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes), *(f"{prefix}{k} double" for k in range(units))]))

    def save(self, spark, path: str) -> None:
        """Weights as a table (name, i, j, value)."""
        rows = [(k, i, j, float(v)) for k, w in self.weights.items() for (i, j), v in np.ndenumerate(np.atleast_2d(w))]
        spark.createDataFrame(rows, "name string, i int, j int, value double").write.mode("overwrite").parquet(path)

    def load(self, spark, path: str) -> Sequential:
        pdf = spark.read.parquet(path).toPandas()
        for name, part in pdf.groupby("name"):
            w = part.pivot(index="i", columns="j", values="value").to_numpy()
            self.weights[name] = w if name.startswith("w") else w[0]
        return self
